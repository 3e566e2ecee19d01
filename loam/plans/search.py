"""Vector search and its filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.vectors import block_search, cell_join, cosine_distance, cosine_similarity, l2_normalize, top_per_key, valid_vector
from loam.registry import Registry
from loam.sources.tables import shared_path, table
from loam.sources.vectors import VectorStore

REGISTRY = Registry()

#: Oracle form of the search of every 100th vector.
HITS = """
WITH hits AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id, r.label,
    list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s
  FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
)
"""


def _hits(spark, sf_dir, k=None, min_score=None, rows=None, group=None):
    """Hits of the queries; ``k`` and the query itself, with ``group`` in each value of
    that column of the rows."""
    e = table(spark, sf_dir, "embeddings")
    found = block_search(e.where("vec_id % 100 = 0"), e if rows is None else rows, "vec_id", "embedding", min_score, None if k is None else k + 1, group)
    return found.where("query_id <> id")


@REGISTRY.query(HITS + """
SELECT query_id, id, round(s, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM hits) WHERE rank <= 10""")
def recall_topk(spark, sf_dir):
    """The ten nearest vectors of each query."""
    found = top_per_key(_hits(spark, sf_dir, k=10), ["query_id"], [F.desc("score"), F.asc("id")], 10, "rank")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@REGISTRY.query(HITS + """
SELECT query_id, id, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM hits WHERE label IN (1, 3, 5)) WHERE rank <= 5""")
def recall_topk_filtered(spark, sf_dir):
    """Filters are applied before the search, so five hits survive."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3, 5))
    found = top_per_key(_hits(spark, sf_dir, 5, rows=rows), ["query_id"], [F.desc("score"), F.asc("id")], 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@REGISTRY.query(HITS + """
SELECT query_id, id, model, round(s, 6) AS score, rank FROM (
  SELECT *, 'm' || (label % 3) AS model, row_number() OVER (PARTITION BY query_id, label % 3 ORDER BY s DESC, id) AS rank FROM hits) WHERE rank <= 10""")
def topk_per_model_rank(spark, sf_dir):
    """Ranks from 1 within each model."""
    rows = table(spark, sf_dir, "embeddings").withColumn("model", F.concat(F.lit("m"), F.col("label") % 3))
    found = top_per_key(_hits(spark, sf_dir, 10, rows=rows, group="model"), ["query_id", "model"], [F.desc("score"), F.asc("id")], 10, "rank")
    return found.select("query_id", "id", "model", F.round("score", 6).alias("score"), "rank")


@REGISTRY.query(HITS + "SELECT query_id, id, round(s, 6) AS score FROM hits WHERE s >= 0.35")
def similarity_filter(spark, sf_dir):
    """All rows at or over a similarity."""
    return _hits(spark, sf_dir, min_score=0.35).select("query_id", "id", F.round("score", 6).alias("score"))


@REGISTRY.query(HITS + """
SELECT query_id, id, round(s, 6) AS score FROM (
  SELECT *, max(s) OVER (PARTITION BY query_id) AS top FROM hits WHERE s >= 0.2) WHERE s >= 0.7 * top""")
def relative_floor(spark, sf_dir):
    """Hits of at least 0.7 times their query's best score."""
    found = _hits(spark, sf_dir, min_score=0.2)
    best = found.groupBy("query_id").agg(F.max("score").alias("top"))
    kept = found.join(best, "query_id").where(F.col("score") >= 0.7 * F.col("top"))
    return kept.select("query_id", "id", F.round("score", 6).alias("score"))


@REGISTRY.query(HITS + "SELECT query_id, id, round(greatest(0.0, least(1.0, s)), 6) AS score FROM hits")
def clamped_similarity(spark, sf_dir):
    """Similarity within 0 and 1."""
    return _hits(spark, sf_dir).select("query_id", "id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")), 6).alias("score"))


@REGISTRY.query("""
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], [1.0::DOUBLE] || list_transform(range(1, 64), lambda i: 0.0::DOUBLE)), 6) AS similarity,
  round(1 - list_cosine_similarity(embedding::DOUBLE[], [1.0::DOUBLE] || list_transform(range(1, 64), lambda i: 0.0::DOUBLE)), 6) AS distance,
  round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first_normalized, true AS valid
FROM embeddings""")
def cosine_functions(spark, sf_dir):
    """Similarity and distance to the first axis, the unit vector, validity."""
    e, v = table(spark, sf_dir, "embeddings"), F.col("embedding")
    axis = F.array(*[F.lit(1.0 if k == 0 else 0.0) for k in range(64)])
    return e.select(
        "vec_id",
        F.round(cosine_similarity(v, axis), 6).alias("similarity"),
        F.round(cosine_distance(v, axis), 6).alias("distance"),
        F.round(F.element_at(l2_normalize(v), 1), 6).alias("first_normalized"),
        valid_vector(v).alias("valid"),
    )


@REGISTRY.query("""
SELECT label, pos::INT AS pos, round(avg(x), 6) AS mean FROM (
  SELECT label, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, pos""")
def centroid(spark, sf_dir):
    """Mean of each component per label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@REGISTRY.query("""
WITH latest AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings)
SELECT label, vec_id FROM latest WHERE r = 1""")
def latest_upsert(spark, sf_dir):
    """The last version of each key wins."""
    return top_per_key(table(spark, sf_dir, "embeddings"), ["label"], [F.desc("vec_id")], 1).select("label", "vec_id")


@REGISTRY.query("SELECT count(*) AS vectors, count(*) FILTER (len(embedding) > 0) AS valid FROM embeddings")
def valid_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.count("*").alias("vectors"), F.count_if(valid_vector(F.col("embedding"))).alias("valid"))


@REGISTRY.query("""
WITH a AS (SELECT vec_id AS id, 'table' AS origin FROM embeddings WHERE label < 5)
SELECT id, origin FROM a UNION ALL SELECT vec_id, 'inline' FROM embeddings WHERE vec_id NOT IN (SELECT id FROM a)""")
def fallback_union(spark, sf_dir):
    """Rows without an entry in the vector table come from the inline column."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    first = e.where("label < 5").select("id", F.lit("table").alias("origin"))
    return first.unionByName(e.join(first, "id", "left_anti").select("id", F.lit("inline").alias("origin")))


@REGISTRY.query("""
WITH p AS (SELECT a.vec_id AS id1, b.vec_id AS id2, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT id1, id2, round(s, 6) AS score FROM p WHERE s >= 0.35""")
def near_dup_pairs(spark, sf_dir, newest=None):
    """Unordered pairs over a threshold; ``newest`` limits them to so many newest rows."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows if newest is None else rows.orderBy(F.desc("vec_id")).limit(newest)
    return similar_pairs(rows, 0.35).select("id1", "id2", F.round("score", 6).alias("score"))


def similar_pairs(rows, threshold, id_col="vec_id", vector_col="embedding"):
    """``(id1, id2, score)`` with id1 < id2, of any number of rows."""
    return cell_join(rows, id_col, vector_col, threshold)


@REGISTRY.query(HITS + """
SELECT query_id, id, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM hits WHERE s > 0.25) WHERE r <= 20""")
def neighbours_topn(spark, sf_dir):
    """At most 20 neighbours over a similarity for each source row."""
    found = _hits(spark, sf_dir, min_score=0.25).where("score > 0.25")
    return top_per_key(found, ["query_id"], [F.desc("score"), F.asc("id")], 20).select("query_id", "id", F.round("score", 6).alias("score"))


@REGISTRY.query(HITS + """
SELECT query_id, round(max(s), 6) AS best,
  CASE WHEN max(s) >= 0.45 THEN 'merged' WHEN max(s) >= 0.4 THEN 'reinforced' WHEN max(s) >= 0.35 THEN 'review' ELSE 'create' END AS action
FROM hits GROUP BY query_id""")
def write_dedup_action(spark, sf_dir):
    """What to do with a new row by its nearest neighbour."""
    best = _hits(spark, sf_dir, k=1).groupBy("query_id").agg(F.max("score").alias("s"))
    return best.select("query_id", F.round("s", 6).alias("best"), dedup_action(F.col("s"), 0.45, 0.40, 0.35).alias("action"))


def dedup_action(score, merged=0.93, reinforced=0.85, review=0.78):
    """The write-time decision; rows under review are created too."""
    return F.when(score >= merged, "merged").when(score >= reinforced, "reinforced").when(score >= review, "review").otherwise("create")


@REGISTRY.query("""
SELECT vec_id AS id, 'm' || (label % 3) AS model, round(CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS updated FROM embeddings""")
def vector_sink(spark, sf_dir):
    """Vectors written by id and model, a third of them once more, that batch delivered
    twice; what the store then holds."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("m"), F.col("label") % 3).alias("model"), F.col("embedding").alias("vector"), F.lit(1).alias("updated"))
    again = rows.where("id % 3 = 0").withColumn("vector", F.transform("vector", lambda x: -x)).withColumn("updated", F.lit(2))
    store = VectorStore(spark, shared_path(spark, "vectors"))
    for batch, some in enumerate((rows, again)):
        store.upsert(some, "embeddings", batch)
    store.upsert(again, "embeddings", 1)
    return store.read().select("id", "model", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"), "updated")
