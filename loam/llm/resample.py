"""Importance resampling: of all documents those that resemble a target, by hashed n-grams.

A table of word positions (``posexplode``) gives the runs of each order: ``lead`` over a
document's positions brings the following words beside each word.  Runs are hashed into
buckets and counted, over the documents and over the target; the gain of a bucket is the
floored log of how much likelier it is in the target.  Gains, of which there are as many
as buckets, are joined back to the runs and averaged by document.  Gumbel noise that
hangs on the id alone turns the best scores into a draw without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.storage import Scratch

BUCKETS = 10_000
#: Gains are broadcast: a row of two numbers for each bucket.
MOST_BUCKETS = 1_000_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Runs of digits, letters a to z after lower-casing A to Z, and characters beyond ASCII."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def _positions(texts: DataFrame) -> DataFrame:
    """``(doc_id, mark, pos, word)``; a text without words has one row with null pos.
    ``mark``, a hash of the text, tells apart texts that repeat an id."""
    return texts.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.posexplode_outer(plain_words(F.col("text"))).alias("pos", "word"))


def hashed_runs(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """``(doc_id, mark, pos, words, bucket, copies)``: the bucket of each run of 1 to
    ``order`` words, ``words`` of them from ``pos`` on, in ``copies`` equal rows."""
    positions = _positions(texts)
    if order == 1:
        runs = positions.select("doc_id", "mark", "pos", F.lit(1).alias("words"), F.col("word").alias("run"), F.lit(1).cast("long").alias("copies"))
    else:
        # Rows that repeat id and text would interleave their words: each position is kept once, with its count.
        own = positions.repartition("doc_id", "mark").groupBy("doc_id", "mark", "pos", "word").agg(F.count("*").alias("copies"))
        along = Window.partitionBy("doc_id", "mark").orderBy("pos")
        wide = own.select("*", *[F.lead("word", k).over(along).alias(f"next{k}") for k in range(1, order)])
        run = [F.struct(F.lit(k + 1).alias("words"), F.concat_ws(" ", "word", *[f"next{i}" for i in range(1, k + 1)]).alias("run")) for k in range(order)]
        whole = [F.lit(True), *[F.col(f"next{k}").isNotNull() for k in range(1, order)]]
        held = F.filter(F.array(*[F.when(ok, r) for ok, r in zip(whole, run, strict=True)]), lambda r: r.isNotNull())
        runs = wide.select("doc_id", "mark", "pos", "copies", F.explode(held).alias("r")).select("doc_id", "mark", "pos", "r.words", F.when(F.col("pos").isNotNull(), F.col("r.run")).alias("run"), "copies")
    return runs.select("doc_id", "mark", "pos", "words", (F.crc32(F.col("run").cast("binary")) % buckets).cast("int").alias("bucket"), "copies")


def _counts(texts: DataFrame, order: int, buckets: int, name: str) -> DataFrame:
    return hashed_runs(texts, order, buckets).where("bucket is not null").groupBy("bucket").agg(F.sum("copies").alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of every bucket: floor of 1000 times the natural log of its share
    of the target's runs over its share of the documents', each count plus one."""
    found = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for texts, name in ((docs, "s"), (target, "t")):
        found = found.join(_counts(texts, order, buckets, name), "bucket", "left")
    found = found.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    total = lambda c: F.sum(c).over(Window.partitionBy())  # noqa: E731  as many rows as buckets
    ratio = (F.col("t") + 1) * (total("s") + buckets) / ((F.col("s") + 1) * (total("t") + buckets))
    return found.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def importance_weights(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, mark)``, a row per row of ``docs``.

    ``weight``: the mean gain of a document's runs, floored; 0 without words, as for null
    and empty texts, which count for nothing.  ``score``: the weight plus noise of the
    id; null where the id is null, though that text counts.  Texts are read whole,
    of any length; repeated rows count and come as often as they are; texts that repeat an
    id are documents of their own, with the same noise.  Of ``target`` only ``text`` is
    read, of ``docs`` ``doc_id`` and ``text``; further columns are ignored; an empty
    target or table gives counts of 0.
    """
    if not 0 < buckets <= MOST_BUCKETS or order < 1:
        raise ValueError(f"one to {MOST_BUCKETS} buckets and runs of one word or more, please")
    texts = docs.select("doc_id", "text")
    gains = bucket_gains(texts, target.select(F.lit(0).alias("doc_id"), "text"), order, buckets)
    runs = hashed_runs(texts, order, buckets).join(F.broadcast(gains), "bucket", "left")
    first = (F.col("pos").isNull() | (F.col("pos") == 0)) & (F.col("words") == 1)
    n, total = F.col("n_features"), F.col("total")
    own = runs.groupBy("doc_id", "mark").agg(
        F.sum(F.when(first, F.col("copies"))).alias("rows"),
        F.sum(F.when(F.col("pos").isNotNull(), F.col("copies")).otherwise(0)).alias("n_features"),
        F.sum(F.when(F.col("pos").isNotNull() & (F.col("words") == 1), F.col("copies")).otherwise(0)).alias("n_words"),
        F.coalesce(F.sum(F.col("gain") * F.col("copies")), F.lit(0)).alias("total"),
    )
    weight = F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = own.withColumn("weight", weight).withColumn("score", F.col("weight") + noise)
    each = scored.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", (F.col("n_words") / F.col("rows")).cast("long").alias("n_words"), (n / F.col("rows")).cast("long").alias("n_features"), "weight", "score", "mark")


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, order: int = 1, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``importance_weights`` with ``rank``: 1, 2, 3 ... by falling score for the best
    ``percent`` of the documents with ``min_words`` words or more, null for the others.

    Ties go to the smaller id, then to the longer text; rows with a null id are neither
    drawn nor counted.  Scores are whole numbers within some ten thousand of 0, so a
    count of each score tells which are drawn and how many come before them; only
    documents of one score are then numbered among themselves.
    """
    scored = Scratch(docs.sparkSession, "resample").keep(importance_weights(docs, target, order, buckets, seed), "scored")
    able = scored.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words))
    before, offsets = 0, []
    counts = sorted(able.groupBy("score").count().collect(), reverse=True)
    left = sum(n for _, n in counts) * percent // 100
    for score, n in counts:
        if before >= left:
            break
        offsets.append((score, before))
        before += n
    places = docs.sparkSession.createDataFrame(offsets, "score long, before long")
    within = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", F.desc("n_features"), "mark"))
    ranked = able.join(F.broadcast(places), "score").withColumn("rank", F.col("before") + within)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= left, F.col("rank"))).select(*scored.columns, "rank")
    low = offsets[-1][0] if offsets else None
    drawn = F.lit(False) if low is None else F.coalesce(F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words) & (F.col("score") >= low), F.lit(False))
    return ranked.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; equal rows of one id come
    together."""
    ranked = importance_resample(docs, target, **options).where("rank is not null").select("doc_id", "mark")
    return docs.join(ranked, (docs["doc_id"].cast("long") == ranked["doc_id"]) & (F.xxhash64(docs["text"]) == ranked["mark"]), "left_semi")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of distinct words, byte by byte and bit by bit.
OP12_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), words AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), buckets AS (
  SELECT w, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1),
      lambda i: (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i]) - 1)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 10000 AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words))
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 't')::DOUBLE AS t FROM words JOIN buckets USING (w) GROUP BY bucket
), totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM documents LEFT JOIN weights ON doc_id = id
), ranked AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= able * 10 // 100 THEN r END AS rank FROM ranked
"""

QUERIES = {"op12_resample": op12_resample}
ORACLE_SQL = {"op12_resample": OP12_SQL}
