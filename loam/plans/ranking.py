"""Fusion, blending and lexical ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions.lexical import tfidf_top, tokens
from loam.functions.vectors import top_per_key
from loam.operators import fusion
from loam.plans.search import HITS, _hits
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()

LISTS = HITS + """, lists AS (
  SELECT * FROM (SELECT query_id, id, 'm' || (label % 3) AS source, s AS score,
    row_number() OVER (PARTITION BY query_id, label % 3 ORDER BY s DESC, id) AS rank FROM hits) WHERE rank <= 25
), pairs AS (
  SELECT * FROM (SELECT query_id, id, CASE label % 2 WHEN 0 THEN 'original' ELSE 'rules' END AS source, s AS score,
    row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY s DESC, id) AS rank FROM hits) WHERE rank <= 25
  UNION ALL
  SELECT * FROM (SELECT query_id, id, 'llm' AS source, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM hits) WHERE rank <= 25
)
"""


def _ranked(spark, sf_dir, source, k=25):
    """Ranks of the best ``k`` of each source; no other pair leaves a task."""
    rows = table(spark, sf_dir, "embeddings").withColumn("source", source)
    return top_per_key(_hits(spark, sf_dir, k, rows=rows, group="source"), ["query_id", "source"], [F.desc("score"), F.asc("id")], k, "rank")


def _lists(spark, sf_dir):
    return _ranked(spark, sf_dir, F.concat(F.lit("m"), F.col("label") % 3))


def _pairs(spark, sf_dir):
    one = _ranked(spark, sf_dir, F.when(F.col("label") % 2 == 0, "original").otherwise("rules"))
    return one.unionByName(_ranked(spark, sf_dir, F.lit("llm")))


def _rounded(df, *more):
    return df.select("query_id", "id", F.round("fused", 6).alias("fused"), *more)


@REGISTRY.query(LISTS + """
SELECT query_id, id, round(sum(CASE source WHEN 'm0' THEN 1.0 WHEN 'm1' THEN 0.8 ELSE 0.7 END / (60 + rank)) * CASE WHEN count(*) > 1 THEN 1 + 0.1 * count(*) / 3 ELSE 1.0 END, 6) AS fused
FROM lists GROUP BY query_id, id""")
def rrf_ensemble(spark, sf_dir):
    weight = F.when(F.col("source") == "m0", 1.0).when(F.col("source") == "m1", 0.8).otherwise(0.7)
    return _rounded(fusion.consensus_rrf(_lists(spark, sf_dir), weight, 0.1, 3))


@REGISTRY.query(LISTS + """
, v AS (SELECT * FROM pairs WHERE source = 'original'), t AS (SELECT * FROM pairs WHERE source = 'llm')
SELECT query_id, id, round(coalesce(0.6 / (60 + v.rank), 0) + coalesce(0.4 / (60 + t.rank), 0), 6) AS fused,
  CASE WHEN t.rank IS NULL THEN 'vector_only' ELSE 'rrf' END AS origin
FROM v FULL JOIN t USING (query_id, id)""")
def rrf_hybrid(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return _rounded(fusion.hybrid_rrf(p.where("source = 'original'"), p.where("source = 'llm'")), "origin")


@REGISTRY.query(LISTS + """
, f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS f, avg(score) AS m, min(rank) AS best_rank, count(*) AS lists FROM pairs GROUP BY query_id, id)
SELECT query_id, id, round(f / max(f) OVER (PARTITION BY query_id), 6) AS fused, round(m, 6) AS mean_score, best_rank, lists FROM f""")
def fusion_rrf(spark, sf_dir):
    return _rounded(fusion.fuse_rrf(_pairs(spark, sf_dir)), F.round("mean_score", 6).alias("mean_score"), "best_rank", "lists")


@REGISTRY.query(LISTS + "SELECT query_id, id, round(0.4 * count(*) / 3 + 0.6 * max(score), 6) AS fused, count(*) AS lists FROM pairs GROUP BY query_id, id")
def fusion_frequency(spark, sf_dir):
    return _rounded(fusion.fuse_frequency(_pairs(spark, sf_dir), 3), "lists")


@REGISTRY.query(LISTS + """
, f AS (SELECT query_id, id, sum(CASE source WHEN 'original' THEN 2.0 WHEN 'rules' THEN 1.0 ELSE 0.8 END / (60 + rank)) AS f FROM pairs GROUP BY query_id, id)
SELECT query_id, id, round(f / max(f) OVER (PARTITION BY query_id), 6) AS fused FROM f""")
def fusion_weighted(spark, sf_dir):
    return _rounded(fusion.fuse_weighted(_pairs(spark, sf_dir), {"original": 2.0, "rules": 1.0, "llm": 0.8}))


@REGISTRY.query(LISTS + "SELECT query_id, id, round(least(1.0, max(score) + least(0.1, 0.02 * count(*))), 6) AS fused, count(*) AS lists FROM pairs GROUP BY query_id, id")
def fusion_max(spark, sf_dir):
    return _rounded(fusion.fuse_max(_pairs(spark, sf_dir)), "lists")


@REGISTRY.query(LISTS + """
SELECT query_id, id, round(max(x), 6) AS fused FROM (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM pairs WINDOW w AS (PARTITION BY query_id, source)) GROUP BY query_id, id""")
def fusion_minmax(spark, sf_dir):
    return _rounded(fusion.fuse_minmax(_pairs(spark, sf_dir)))


@REGISTRY.query(LISTS + """
SELECT query_id, id, string_agg(source || ':' || rank, ',' ORDER BY source) AS ranks, count(*) AS lists, round(sum(1.0 / (60 + rank)), 6) AS fused, round(max(score), 6) AS best
FROM lists GROUP BY query_id, id""")
def code_rrf(spark, sf_dir):
    """Unweighted, with the best score over models and the rank in each."""
    found = _lists(spark, sf_dir).groupBy("query_id", "id").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "source", F.col("rank").cast("string")))), ",").alias("ranks"),
        F.count("*").alias("lists"),
        F.round(F.sum(fusion.reciprocal_rank(F.col("rank"))), 6).alias("fused"),
        F.round(F.max("score"), 6).alias("best"),
    )
    return found


@REGISTRY.query(HITS + """
, m AS (SELECT h.query_id, h.id, s, coalesce(0.3 + 0.6 * quality, 0.5) AS importance, coalesce(toxic, 0) AS toxic FROM hits h LEFT JOIN labels l ON l.doc_id = h.id)
SELECT query_id, id, round((s * 0.85 + importance * 0.15) * (CASE WHEN importance < 0.35 THEN 0.4 ELSE 1.0 END) * (CASE toxic WHEN 1 THEN 0.15 ELSE 1.0 END), 6) AS score FROM m""")
def importance_multiplier_blend(spark, sf_dir):
    # Quality, 0 or 1, and toxicity come with a hit as one number; without a label it is null.
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (2 * F.col("quality") + F.coalesce("toxic", F.lit(0))).alias("marks"))
    rows = table(spark, sf_dir, "embeddings").join(marks, "vec_id", "left")
    importance = F.coalesce(0.3 + 0.6 * F.floor(F.col("marks") / 2), F.lit(0.5))
    sentiment = F.when(F.col("marks") % 2 == 1, 0.15).otherwise(1.0)
    found = _hits(spark, sf_dir, rows=rows, group="marks")
    return found.select("query_id", "id", F.round(fusion.blend(F.col("score"), importance, sentiment), 6).alias("score"))


USERS = """
WITH u AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS retrieved, count(*) FILTER (event_type = 'click') AS used,
  count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error') AS net, date_diff('day', max(ts)::DATE, DATE '2024-03-01') AS days FROM events GROUP BY user_id)
"""


def _users(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind.isin("view", "click")).alias("retrieved"),
        F.count_if(kind == "click").alias("used"),
        (F.count_if(kind == "purchase") - F.count_if(kind == "error")).alias("net"),
        F.datediff(F.lit("2024-03-01").cast("date"), F.max("ts").cast("date")).alias("days"),
    )


@REGISTRY.query(USERS + """
SELECT user_id, CASE WHEN days <= 7 THEN 1.0::DOUBLE WHEN days <= 30 THEN 0.9 WHEN days <= 90 THEN 0.75 WHEN retrieved / greatest(days, 1) > 0.1 THEN 0.8 ELSE 0.6 END AS weight FROM u""")
def recency_tier(spark, sf_dir):
    return _users(spark, sf_dir).select("user_id", fusion.recency_tier(F.lit(False), F.col("days"), F.col("retrieved")).alias("weight"))


@REGISTRY.query(USERS + """
, x AS (SELECT *, CASE WHEN retrieved < 3 THEN 0 ELSE (2 * used + retrieved) * exp(-ln(2) / 14 * days) END AS x FROM u)
SELECT user_id, round(x / (x + 10), 6) AS usage, round(0.5 * 0.85 + least(1.0, x / (x + 10) * CASE WHEN net > 0 THEN 1.5 WHEN net < 0 THEN 0.5 ELSE 1 END) * 0.15, 6) AS blended FROM x""")
def usage_signal(spark, sf_dir):
    usage = fusion.usage_signal(F.col("retrieved"), F.col("used"), F.col("days"))
    return _users(spark, sf_dir).select("user_id", F.round(usage, 6).alias("usage"), F.round(fusion.usage_blend(F.lit(0.5), usage, F.col("net")), 6).alias("blended"))


@REGISTRY.query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank FROM events)
SELECT user_id, event_id, rank, round((1.0::DOUBLE / (60 + rank)) / sum(1.0::DOUBLE / (60 + rank)) OVER (PARTITION BY user_id), 6) AS propensity FROM r""")
def propensity(spark, sf_dir):
    """How likely each of a user's events, by value, is to be looked at."""
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(order) - 1).cast("long").alias("rank"))
    return ranked.withColumn("propensity", F.round(fusion.propensity_among(F.col("rank"), Window.partitionBy("user_id")), 6))


TOKENS = """
WITH tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents),
q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS w FROM benchmark),
tf AS (SELECT doc_id, w, count(*) AS tf FROM tok GROUP BY doc_id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), n AS (SELECT count(*) AS n FROM documents)
"""


@REGISTRY.query(TOKENS + """
, s AS (SELECT item_id, doc_id, sum((1 + ln(tf)) * ln(1 + n / (1 + df))) AS s FROM q JOIN tf USING (w) JOIN df USING (w), n GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(s, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 3) DESC, doc_id) AS r FROM s) WHERE r <= 10""")
def tfidf_search(spark, sf_dir):
    """Ten best documents per question by (1 + ln tf) * ln(1 + N / (1 + df))."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return tfidf_top(docs, "doc_id", "text", items, "item_id", "text", 10)


@REGISTRY.query("""
SELECT doc_id, substr(text, greatest(strpos(lower(text), 'the') - 40, 1), 120) AS snippet FROM documents WHERE strpos(lower(text), 'the') > 0""")
def snippet(spark, sf_dir):
    """Text from 40 characters before the first hit."""
    at = F.locate("the", F.lower("text"))
    return table(spark, sf_dir, "documents").where(at > 0).select("doc_id", F.substring("text", F.greatest(at - 40, F.lit(1)), F.lit(120)).alias("snippet"))


@REGISTRY.query("""
WITH w AS (SELECT item_id, string_split(text, ' ') AS w, text FROM benchmark),
s AS (SELECT item_id, (CASE WHEN len(w) <= 3 THEN 2 ELSE 0 END + 2 * len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]{2,}$')))
  + len(list_filter(w[2:], lambda x: regexp_matches(x, '^[A-Z][a-z]+'))) + CASE WHEN regexp_matches(text, '"[^"]+"') THEN 3 ELSE 0 END) / (len(w) + 1) AS k FROM w)
SELECT item_id, round(least(1.0, k), 6) AS keywordness, round(greatest(0.2, 0.6 - 0.3 * least(1.0, k)), 6) AS vector_weight, round(least(0.8, 0.4 + 0.3 * least(1.0, k)), 6) AS text_weight FROM s""")
def query_keywordness(spark, sf_dir):
    """How much a query looks like keywords, and the weights that follow."""
    w = F.split("text", " ", -1)
    points = (
        F.when(F.size(w) <= 3, 2).otherwise(0)
        + 2 * F.size(F.filter(w, lambda x: x.rlike("^[A-Z]{2,}$")))
        + F.size(F.filter(F.slice(w, F.lit(2), F.size(w)), lambda x: x.rlike("^[A-Z][a-z]+")))
        + F.when(F.col("text").rlike('"[^"]+"'), 3).otherwise(0)
    )
    k = F.least(F.lit(1.0), points / (F.size(w) + 1))
    return table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.round(k, 6).alias("keywordness"),
        F.round(F.greatest(F.lit(0.2), 0.6 - 0.3 * k), 6).alias("vector_weight"),
        F.round(F.least(F.lit(0.8), 0.4 + 0.3 * k), 6).alias("text_weight"),
    )


@REGISTRY.query("""
WITH r AS (SELECT user_id, event_id, value, sum(1) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS n,
  sum(length(props)) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)
SELECT user_id, event_id, used::BIGINT AS used FROM r WHERE used <= 100 OR n = 1""")
def budget_prefix(spark, sf_dir):
    """Rows in order of value while their sizes fit a budget; the first always."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").withColumn("used", F.sum(F.length("props")).over(w)).withColumn("n", F.count("*").over(w))
    return e.where("used <= 100 OR n = 1").select("user_id", "event_id", "used")
