"""Benchmark decontamination: short test items found inside long documents.

Size-partitioned MinHash containment search, with DataFrame functions only.
An item of m distinct shingles is contained at threshold t if at most
floor((1 - t) * m) of them are missing.  So any floor((1 - t) * m) + 1 of its
shingles include one that a document holding the item has.  Items are
partitioned by that size: each keeps as many of its smallest hashes as its class
needs.  A document of any length that shares one of them is a candidate, and no
item is missed.  Candidates are verified by their exact shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.columns import named
from loam.llm.storage import Scratch

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Bytes of item text up to which the item sketches are sent to all executors.
#: Beyond, shingle hashes are shuffled to meet the sketches instead.
BROADCAST_BYTES = 16 << 20
#: Candidates up to which they are sent to the texts.  Beyond, texts are shuffled.
BROADCAST_PAIRS = 250_000


def normal_words(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def _spans(words: Column, k: int, make) -> Column:
    """``make`` of each run of k words, or of all words if there are fewer.

    The words are bound once, as a lambda variable: an expression named inside a
    lambda would be evaluated again for each run.
    """
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: make(F.concat_ws(" ", F.slice(w, i, k))))
    return F.element_at(F.transform(F.array(words), runs), 1)


def shingles(words: Column, k: int | Column) -> Column:
    """The distinct shingles of a text, space-joined; none of a text without words."""
    return F.filter(F.array_distinct(_spans(words, k, lambda s: s)), lambda s: s != "")


def allowed_missing(count: Column, threshold: float) -> Column:
    """How many of ``count`` shingles a document may lack."""
    return F.floor(F.round(count * (1.0 - threshold), 6)).cast("int")


def item_sketches(benchmark: DataFrame, k: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``(item_id, k, item_shingles, sketch)``: the smallest hashes of each item, as many
    as its size class needs.  An item of fewer words than ``k`` is one shingle of all its
    words; items without words are left out."""
    words = benchmark.where("item_id is not null").select("item_id", normal_words(F.col("text")).alias("w")).where("size(w) > 0")
    items = words.withColumn("k", F.least(F.lit(k), F.size("w"))).select("item_id", "k", shingles(F.col("w"), F.col("k")).alias("item_shingles"))
    hashes = F.array_sort(F.array_distinct(F.transform("item_shingles", lambda s: F.xxhash64(s))))
    # The largest number that may be missing in the class of sizes 2^c to 2^(c + 1) - 1, at most the item's own size.
    size = F.size("item_shingles")
    top = F.pow(F.lit(2), F.floor(F.log2(size)) + 1).cast("int") - 1
    keep = F.least(allowed_missing(top, threshold) + 1, F.greatest(size, F.lit(1)))
    return items.select("item_id", "k", "item_shingles", F.slice(hashes, F.lit(1), keep).alias("sketch"))


def shingle_hashes(words: Column, lengths: list[int]) -> Column:
    """Hashes of a text's shingles of these lengths, repeats included.  A text without
    words has that of the empty shingle, which is in no sketch."""
    if len(lengths) == 1:
        return _spans(words, lengths[0], F.xxhash64)
    of_each = lambda w: F.flatten(F.array(*[_spans(w, k, F.xxhash64) for k in lengths]))
    return F.element_at(F.transform(F.array(words), of_each), 1)


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    broadcast_bytes: int = BROADCAST_BYTES,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """``(doc_id, item_id, containment)`` for every item of which a document has at
    least ``threshold`` of the distinct shingles.

    Words are runs of letters and digits, lower-cased.  An item with fewer words
    than a shingle is found wherever its words follow each other.  Null and empty
    texts match nothing; a document or item with a null id gives no rows; repeated rows
    give one result, and rows of one id are judged each by its own text; texts of any
    length are searched whole; a containment of just the threshold counts; empty tables
    give none; further columns are ignored.
    """
    sketches = item_sketches(benchmark, k, threshold)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    lengths = sorted(r["k"] for r in sketches.select("k").distinct().collect())  # k or less
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, containment double")
    hashed = texts.select("doc_id", F.explode(shingle_hashes(normal_words(F.col("text")), lengths)).alias("hash"))
    keyed = sketches.select("item_id", F.explode("sketch").alias("hash"))
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        keyed = F.broadcast(keyed)
    else:
        hashed = hashed.distinct()
    candidates = Scratch(docs.sparkSession, "decontam").keep(hashed.join(keyed, "hash").select("doc_id", "item_id").distinct(), "candidates")
    few = candidates.count() <= broadcast_pairs
    pairs = texts.join(F.broadcast(candidates) if few else candidates, "doc_id").join(sketches.select("item_id", "k", "item_shingles"), "item_id")
    found = F.size(F.array_intersect("item_shingles", shingles(normal_words(F.col("text")), F.col("k")))) / F.size("item_shingles")
    return pairs.select("doc_id", "item_id", found.alias("containment")).where(F.col("containment") >= threshold).distinct()


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.  Rows with a null
    id or text stay; of rows that repeat an id none stays if any holds an item."""
    scratch = Scratch(docs.sparkSession, "contaminated")
    found = scratch.keep(contained_items(docs, benchmark, **options).select("doc_id").distinct(), "found")
    few = found.count() <= BROADCAST_PAIRS
    return docs.join(F.broadcast(found) if few else found, "doc_id", "left_anti").select(*named(docs.columns))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM item_shingles))
), sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, count(*) / any_value(n)::DOUBLE AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id
HAVING count(*) / any_value(n)::DOUBLE >= 0.8
"""

QUERIES = {"op10_decontam": op10_decontam}
ORACLE_SQL = {"op10_decontam": OP10_SQL}
