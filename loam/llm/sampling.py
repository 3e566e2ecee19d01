"""Bounded samples that models start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_hash(docs: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Of the first ``max_rows`` documents by the hash of their id those that fit, one
    after the other, into ``max_bytes`` of text.

    Rows with a null id or text are left out; of rows that repeat id and text one counts
    and one comes; a text that would go over the total is passed over.  Only ids, sizes
    and hashes of these rows come to the driver.
    """
    own = F.xxhash64("text").alias("__text")
    sized = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.octet_length("text").alias("bytes"), own).distinct()
    chosen, left = [], max_bytes
    for r in sized.orderBy(F.xxhash64("doc_id"), "doc_id", "bytes", "__text").limit(max_rows).collect():
        if r["bytes"] <= left:
            left -= r["bytes"]
            chosen.append((r["doc_id"], r["__text"]))
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, __text long")
    found = docs.withColumn("__text", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "__text"], "left_semi")
    return found.dropDuplicates(["doc_id", "__text"]).drop("__text")
