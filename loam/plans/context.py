"""Contexts within a budget, and what changes a ranking after the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.vectors import top_per_key
from loam.operators import budget, fusion
from loam.plans.ranking import LISTS, _lists
from loam.plans.search import HITS, _hits
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()

#: Tokens of a context, and shares of its layers.
MAX_TOKENS = 400
LAYER_SHARES = {"IDENTITY": 0.44, "PROJECT": 0.33, "SESSION": 0.22}
#: Candidates of a layer.
CANDIDATES = 200
#: Multipliers of layers and of durability.
LAYER_MULTIPLIERS = {"IDENTITY": 1.15, "PROJECT": 1.05, "SESSION": 1.0, "TASK": 1.05, "INSIGHT": 1.1}
DURABLE, EPHEMERAL = 1.5, 0.6


def _turns(spark, sf_dir):
    """Turns as records: roles stand for layers, words tell rules and sensitive content."""
    layer = F.when(F.col("role") == "system", "IDENTITY").when(F.col("role") == "user", "PROJECT").otherwise("SESSION")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        layer.alias("layer"),
        budget.tokens_of(F.col("text")).alias("tokens"),
        F.coalesce(F.col("text").rlike(r"(?i)\b(password|secret|token)\b"), F.lit(False)).alias("critical"),
        F.coalesce(F.col("text").rlike(r"(?i)\b(must|never|always|that)\b"), F.lit(False)).alias("constraint"),
    )


@REGISTRY.query()
def layer_context(spark, sf_dir):
    """What each layer of a conversation keeps and what its budget evicts."""

    def choose(rows):
        layer = rows[0]["layer"]
        own = int(MAX_TOKENS * LAYER_SHARES[layer])
        kept = budget.layer_selection(rows, own, min(200, own // 4) if layer == "IDENTITY" else 0)
        return {p: "kept" for p in kept}

    found = budget.select_per_key(_turns(spark, sf_dir), ["conv_id", "layer"], [F.asc("turn")], CANDIDATES, choose)
    return found.select("conv_id", "layer", "turn", "tokens", F.coalesce("section", F.lit("evicted")).alias("state"))


@REGISTRY.query()
def scoped_context(spark, sf_dir):
    """Sections of a conversation's context: critical, task and background."""
    scored = _turns(spark, sf_dir).withColumns(
        {"score": 1 / (1 + F.col("turn")), "boost": F.when(F.col("layer") == "IDENTITY", 0.3).otherwise(0.0) + F.when(F.col("turn") >= 6, 0.2).otherwise(0.0)}
    )
    found = budget.select_per_key(scored, ["conv_id"], [F.asc("turn")], CANDIDATES, lambda rows: budget.scoped_selection(rows, MAX_TOKENS))
    return found.where("section IS NOT NULL").select("conv_id", "turn", "tokens", "section")


@REGISTRY.query("""
WITH d AS (SELECT source, lang, coalesce(toxic, 0) = 1 AS deleted, coalesce(quality, 0) = 1 AS consolidated FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'total' AS kind, '' AS name, count(*) AS n FROM d UNION ALL SELECT 'active', '', count(*) FILTER (NOT deleted) FROM d UNION ALL SELECT 'deleted', '', count(*) FILTER (deleted) FROM d
UNION ALL SELECT 'consolidated', '', count(*) FILTER (consolidated) FROM d UNION ALL SELECT 'layer', source, count(*) FROM d WHERE NOT deleted GROUP BY source
UNION ALL SELECT 'type', lang, count(*) FROM d WHERE NOT deleted AND lang IS NOT NULL GROUP BY lang""")
def storage_stats(spark, sf_dir):
    """Totals and two distributions of what is not deleted, from one grouped pass."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    deleted, consolidated = F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.coalesce(F.col("quality"), F.lit(0)) == 1
    per = d.groupBy("source", "lang").agg(F.count("*").alias("total"), F.count_if(~deleted).alias("active"), F.count_if(deleted).alias("deleted"), F.count_if(consolidated).alias("consolidated"))
    kinds = ["total", "active", "deleted", "consolidated"]
    totals = [F.struct(F.lit(k).alias("kind"), F.lit("").alias("name"), F.col(k).alias("n")) for k in kinds]
    spread = [F.struct(F.lit("layer").alias("kind"), F.col("source").alias("name"), F.col("active").alias("n")), F.struct(F.lit("type").alias("kind"), F.col("lang").alias("name"), F.col("active").alias("n"))]
    listed = per.select(F.explode(F.array(*totals, *spread)).alias("x")).select("x.kind", "x.name", "x.n")
    found = listed.groupBy("kind", "name").agg(F.sum("n").alias("n"))
    return found.where("kind NOT IN ('layer', 'type') OR n > 0").where("kind <> 'type' OR name IS NOT NULL")


@REGISTRY.query(LISTS + """
, f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS r FROM lists GROUP BY 1, 2), m AS (SELECT query_id, max(r) AS top FROM f GROUP BY 1)
, b AS (SELECT query_id, id, (r / top * 0.85 + coalesce(0.3 + 0.6 * quality, 0.5) * 0.15) * CASE toxic WHEN 1 THEN 0.15 ELSE 1.0 END AS x FROM f JOIN m USING (query_id) LEFT JOIN labels ON doc_id = id)
SELECT query_id, id, round(x, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 6) DESC, id) AS n FROM b) WHERE n <= 10""")
def post_rerank_blend(spark, sf_dir):
    """Fused ranks over the query's best, blended with importance and sentiment."""
    fused = fusion.weighted_rrf(_lists(spark, sf_dir), F.lit(1.0))
    top = fused.groupBy("query_id").agg(F.max("fused").alias("top"))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    importance = F.coalesce(0.3 + 0.6 * F.col("quality"), F.lit(0.5))
    blended = (F.col("fused") / F.col("top") * 0.85 + importance * 0.15) * F.when(F.col("toxic") == 1, 0.15).otherwise(1.0)
    found = fused.join(top, "query_id").join(labels, "id", "left").select("query_id", "id", F.round(blended, 6).alias("score"))
    return top_per_key(found, ["query_id"], [F.desc("score"), F.asc("id")], 10)


@REGISTRY.query(HITS + """
, t AS (SELECT query_id, id, label, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM hits) WHERE r <= 25)
SELECT query_id, id, round(s * CASE label % 5 WHEN 0 THEN 1.15 WHEN 1 THEN 1.05 WHEN 2 THEN 1.0 WHEN 3 THEN 1.05 ELSE 1.1 END * CASE quality WHEN 1 THEN 1.5 WHEN 0 THEN 0.6 ELSE 1.0 END, 6)::DOUBLE AS score
FROM t LEFT JOIN labels ON doc_id = id""")
def recall_multipliers(spark, sf_dir):
    """Scores times what the row's layer and its durability are worth."""
    layers = F.create_map(*[F.lit(x) for k, v in enumerate(LAYER_MULTIPLIERS.values()) for x in (k, v)])
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), layers[F.col("label") % 5].alias("layer"))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    durability = F.when(F.col("quality") == 1, DURABLE).when(F.col("quality") == 0, EPHEMERAL).otherwise(1.0)
    best = top_per_key(_hits(spark, sf_dir, k=25), ["query_id"], [F.desc("score"), F.asc("id")], 25)
    found = best.join(rows, "id").join(labels, "id", "left")
    return found.select("query_id", "id", F.round(F.col("score") * F.col("layer") * durability, 6).alias("score"))


@REGISTRY.query(HITS + """
, t AS (SELECT query_id, id, label, s, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM hits) WHERE r <= 25)
, x AS (SELECT query_id, r, id AS via, unnest(CASE WHEN label % 4 = 0 THEN range(id + 1, id + 4) ELSE [id] END) AS id, label % 4 = 0 AS made FROM t)
, y AS (SELECT x.*, row_number() OVER (PARTITION BY query_id, x.id ORDER BY r) AS n FROM x JOIN embeddings ON vec_id = x.id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY r, id) AS rank, CASE WHEN made THEN via END AS resolved_from FROM y WHERE n = 1""")
def derivative_resolution(spark, sf_dir):
    """Consolidated hits give way to their sources, three at most; the first place of a
    row counts."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    best = top_per_key(_hits(spark, sf_dir, k=25), ["query_id"], [F.desc("score"), F.asc("id")], 25, "r").join(rows, "id")
    made = F.col("label") % 4 == 0
    sources = F.when(made, F.sequence(F.col("id") + 1, F.col("id") + 3)).otherwise(F.array("id"))
    listed = best.select("query_id", "r", F.when(made, F.col("id")).alias("resolved_from"), F.explode(sources).alias("id"))
    known = listed.join(rows.select("id"), "id", "left_semi")
    once = top_per_key(known, ["query_id", "id"], [F.asc("r")], 1)
    return top_per_key(once, ["query_id"], [F.asc("r"), F.asc("id")], 75, "rank").select("query_id", "id", "rank", "resolved_from")


@REGISTRY.query(HITS + """
SELECT query_id, id, round(s, 6) AS score FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r
  FROM hits h JOIN embeddings q ON q.vec_id = query_id WHERE h.label <> q.label) WHERE r <= 10""")
def hits_of_other_groups(spark, sf_dir):
    """The nearest rows of other files than the query's own, here of other labels."""
    e = table(spark, sf_dir, "embeddings")
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    found = _hits(spark, sf_dir, k=10, rows=e, group="label").join(own, "query_id").where("label <> own")
    return top_per_key(found, ["query_id"], [F.desc("score"), F.asc("id")], 10).select("query_id", "id", F.round("score", 6).alias("score"))
