"""Merges of duplicates as an append-only ledger, and the records that it leaves at a time.

The ledger has a row for each record that a merge absorbs, and one for each rollback;
nothing in it changes.  What is in force at a time is replayed from it, so a merge can be
taken back without touching any other, and made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.dedup import detail_score

MERGE, ROLLBACK = "merge", "rollback"
LEDGER = "event long, at long, action string, survivor long, absorbed long, content string, importance double, accesses long, accessed long"

# What is kept of each type of record, and of those without one.
STRATEGIES = {"CONSTRAINT": "combine", "LESSON": "newest", "PREFERENCE": "newest", "FACT": "detailed", "EVENT": "newest", "TASK": "newest"}
DEFAULT_STRATEGY = "detailed"


def default_strategy(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv])[kind], F.lit(DEFAULT_STRATEGY))


def merge_events(members: DataFrame, at: int, strategy: Column | None = None, first_event: int = 0) -> DataFrame:
    """Ledger rows that merge clusters of two records or more.

    ``members``: (cluster, id, text, kind, created, observed, importance, accesses, accessed),
    each id in one cluster.  The event is ``first_event`` plus the cluster.  ``strategy``
    names for each record's cluster what is kept, by default what the kind of its
    smallest id asks for: ``newest`` by observed else created time, ``oldest`` by created
    time, ``detailed`` or ``combine`` by the detail of the text, ``important`` by importance;
    of equals the smaller id.  The survivor takes the text of the record kept, the largest
    importance, all accesses and the latest one.  Records with a null cluster or id
    merge with none.
    """
    rows = members.where("cluster is not null and id is not null")
    none = F.lit(None).cast("double")
    rank = {
        "newest": F.coalesce("observed", "created").cast("double"),
        "oldest": -F.col("created").cast("double"),
        "detailed": detail_score(F.coalesce("text", F.lit(""))).cast("double"),
        "important": F.col("importance").cast("double"),
    }
    best = lambda by: F.max_by(F.struct("id", "text"), F.struct(F.coalesce(by, none), -F.col("id")))
    picked = rows.groupBy("cluster").agg(
        F.count("*").alias("members"),
        F.min_by(default_strategy(F.col("kind")) if strategy is None else strategy, "id").alias("strategy"),
        F.max("importance").alias("m_importance"),
        F.sum("accesses").alias("m_accesses"),
        F.max("accessed").alias("m_accessed"),
        *[best(by).alias(name) for name, by in rank.items()],
    )
    kept = F.coalesce(*[F.when(F.col("strategy") == name, F.col(name)) for name in rank], F.col("detailed"))
    events = picked.where("members > 1").select("cluster", kept.alias("kept"), "m_importance", "m_accesses", "m_accessed")
    out = rows.select("cluster", "id").join(events, "cluster").where(F.col("id") != F.col("kept.id"))
    return out.select(
        (F.lit(first_event) + F.col("cluster")).cast("long").alias("event"),
        F.lit(at).cast("long").alias("at"),
        F.lit(MERGE).alias("action"),
        F.col("kept.id").cast("long").alias("survivor"),
        F.col("id").cast("long").alias("absorbed"),
        F.col("kept.text").alias("content"),
        F.col("m_importance").cast("double").alias("importance"),
        F.col("m_accesses").cast("long").alias("accesses"),
        F.col("m_accessed").cast("long").alias("accessed"),
    )


def rollbacks(events: DataFrame, at: int) -> DataFrame:
    """Ledger rows that take back events (event), whether or not they are in force."""
    row = events.select(F.col("event").cast("long").alias("event")).distinct().withColumn("at", F.lit(at).cast("long")).withColumn("action", F.lit(ROLLBACK))
    empty = {"survivor": "long", "absorbed": "long", "content": "string", "importance": "double", "accesses": "long", "accessed": "long"}
    return row.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()])


def in_force(ledger: DataFrame, at: int | None = None) -> DataFrame:
    """The merge rows that stand at a time (all of the ledger by default): made by then, and
    not taken back between their own time and that one.  Rows that repeat count once."""
    seen = (ledger if at is None else ledger.where(F.col("at") <= at)).distinct()
    back = seen.where(F.col("action") == ROLLBACK).groupBy("event").agg(F.max("at").alias("back"))
    return seen.where(F.col("action") == MERGE).join(back, "event", "left").where("back is null or back < at").drop("back")


def records_at(records: DataFrame, ledger: DataFrame, at: int | None = None) -> DataFrame:
    """Records (id, text, importance, accesses, accessed) as the ledger leaves them, with
    ``live`` and ``superseded_by``.

    A record that merges in force absorb is superseded by the survivor of the latest.  A
    survivor has the text of its latest merge, the largest importance of its own and of its
    merges, and the accesses of its latest; it may be superseded itself.  A record with a
    null id stays as it is.
    """
    held = in_force(ledger, at)
    gone = held.groupBy(F.col("absorbed").alias("id")).agg(F.max_by("survivor", F.struct("at", "event")).alias("superseded_by"))
    latest = F.struct("at", "event")
    kept = held.groupBy(F.col("survivor").alias("id")).agg(
        F.max_by(F.struct("content", "accesses", "accessed"), latest).alias("m"), F.max("importance").alias("m_importance"), F.lit(True).alias("merged")
    )
    found = records.join(gone, "id", "left").join(kept, "id", "left")
    pick = lambda own, new: F.when(F.col("merged"), F.col(new)).otherwise(F.col(own)).alias(own)
    return found.select(
        "id",
        pick("text", "m.content"),
        F.greatest("importance", "m_importance").alias("importance"),
        pick("accesses", "m.accesses"),
        pick("accessed", "m.accessed"),
        F.col("superseded_by").isNull().alias("live"),
        "superseded_by",
    )
