"""Scans, predicates, pages, semi and anti joins, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions.vectors import top_per_key
from loam.operators import filters
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()


@REGISTRY.query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 500 AND n_chars <= 3000 AND source NOT IN ('src1') AND text IS NOT NULL AND text ILIKE '%the%'")
def scan_filter_builder(spark, sf_dir):
    f = {"lang": ["en", "de"], "n_chars__min": 500, "n_chars__max": 3000, "source__not_in": ["src1"], "text__null": False, "text__ilike": "the"}
    return table(spark, sf_dir, "documents").where(filters.build(f)).select("doc_id")


@REGISTRY.query("""
SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (toxic IS NOT DISTINCT FROM 1) AND (quality IS NULL OR quality = 1)""")
def live_rows(spark, sf_dir):
    """Liveness: an unknown flag keeps a row, a known one decides."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    none = F.lit(None).cast("long")
    return d.where(filters.live(none, none, F.when(F.col("quality") == 0, F.col("doc_id")), ~F.col("toxic").eqNullSafe(1))).select("doc_id")


@REGISTRY.query("SELECT doc_id, ceil((SELECT count(*) FROM documents) / 50)::BIGINT AS pages FROM documents ORDER BY doc_id DESC LIMIT 50 OFFSET 100")
def page_offset(spark, sf_dir):
    """The third page of 50, and how many pages there are."""
    d = table(spark, sf_dir, "documents")
    return d.orderBy(F.desc("doc_id")).offset(100).limit(50).select("doc_id", F.ceil(F.lit(d.count()) / 50).alias("pages"))


@REGISTRY.query("""
SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type = 'view' THEN ts + INTERVAL 1 DAY END, ts) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'""")
def time_range(spark, sf_dir):
    """By the time observed, or else the time created."""
    observed = F.when(F.col("event_type") == "view", F.col("ts") + F.expr("interval 1 day"))
    at = filters.effective_time(observed, F.col("ts"))
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where(at.between(stamp("2024-01-10"), stamp("2024-01-12"))).select("event_id")


@REGISTRY.query("SELECT doc_id FROM documents WHERE text ILIKE '%idiot%' OR text ILIKE '%scum%' OR text ILIKE '%trash%'")
def ilike_any(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where(t.ilike("%idiot%") | t.ilike("%scum%") | t.ilike("%trash%")).select("doc_id")


@REGISTRY.query("SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^a-z0-9]+'), ['the', 'that', 'for'])")
def token_match(spark, sf_dir):
    """Documents that have every one of some tokens."""
    words = F.split(F.lower("text"), "[^a-z0-9]+", -1)
    wanted = F.array(*map(F.lit, ("the", "that", "for")))
    return table(spark, sf_dir, "documents").where(F.size(F.array_except(wanted, words)) == 0).select("doc_id")


@REGISTRY.query("""
WITH t AS (SELECT doc_id, [lang, source] AS tags FROM documents)
SELECT doc_id, list_has_all(tags, ['en', 'src3']) AS has_all, list_has_any(tags, ['de', 'src3']) AS has_any FROM t WHERE list_has_all(tags, ['en', 'src3']) OR list_has_any(tags, ['de', 'src3'])""")
def tags_all_any(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    t = t.select("doc_id", filters.build({"tags__all_of": ["en", "src3"]}).alias("has_all"), filters.build({"tags__any_of": ["de", "src3"]}).alias("has_any"))
    return t.where("has_all OR has_any")


@REGISTRY.query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT BETWEEN 3 AND 9")
def json_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").where(k.between(3, 9)).select("event_id", k.alias("k"))


@REGISTRY.query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def pool_semi_join(spark, sf_dir):
    pool = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    o = table(spark, sf_dir, "orders")
    return o.join(pool, o["o_custkey"] == pool["c_custkey"], "left_semi").select("o_orderkey")


@REGISTRY.query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_unprocessed(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@REGISTRY.query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')""")
def stale_anti_join(spark, sf_dir):
    """Rows that no log entry has touched since."""
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(recent, "c_custkey", "left_anti").select("c_custkey")


@REGISTRY.query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(0.3 + 0.6 * quality, 0.2) >= 0.3 AND coalesce(toxic, 0) = 0")
def context_prefilter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where((F.coalesce(0.3 + 0.6 * F.col("quality"), F.lit(0.2)) >= 0.3) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


SUBSCRIPTIONS = [(1, "en", 1000), (2, None, 3000), (3, "fr", None)]


@REGISTRY.query("""
WITH s(id, lang, least) AS (VALUES (1, 'en', 1000), (2, NULL, 3000), (3, 'fr', NULL))
SELECT s.id::BIGINT AS subscription, doc_id FROM documents d JOIN s ON (s.lang IS NULL OR s.lang = d.lang) AND (s.least IS NULL OR d.n_chars >= s.least)""")
def subscription_match(spark, sf_dir):
    """Events against a handful of subscriptions; an absent field passes."""
    s = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(lang).cast("string").alias("lang"), F.lit(n).cast("long").alias("least")) for i, lang, n in SUBSCRIPTIONS])
    passes = lambda x: (x["lang"].isNull() | (x["lang"] == F.col("lang"))) & (x["least"].isNull() | (F.col("n_chars") >= x["least"]))
    return table(spark, sf_dir, "documents").select(F.explode(F.filter(s, passes)).alias("s"), "doc_id").select(F.col("s.id").alias("subscription"), "doc_id")


@REGISTRY.query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://[^/]*/fr/.*$') AND NOT regexp_matches(url, '^https?://[^/]*/[^/]*/[^/]*#top$')")
def glob_filter(spark, sf_dir):
    """Paths of the French pages, without those that end in an anchor."""
    keep = filters.glob(F.col("url"), ["http://*/fr/**", "https://*/fr/**"], ["http://*/*/*#top", "https://*/*/*#top"])
    return table(spark, sf_dir, "pages").where(keep).select("page_id")


@REGISTRY.query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 OR 's' || conv_id = 's17'")
def session_filter(spark, sf_dir):
    """By id or by the external id."""
    c = table(spark, sf_dir, "conversations")
    return c.where((F.col("conv_id") == 3) | (F.concat(F.lit("s"), F.col("conv_id")) == "s17")).select("conv_id", "turn", "role")


@REGISTRY.query("SELECT lang AS key, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r <= 3")
def best_per_key(spark, sf_dir):
    found = top_per_key(table(spark, sf_dir, "documents"), ["lang"], [F.desc_nulls_last("n_chars"), F.asc("doc_id")], 3)
    return found.select(F.col("lang").alias("key"), "doc_id", "n_chars")


@REGISTRY.query("SELECT user_id, event_id, round(value / max(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def max_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.groupBy("user_id").agg(F.max("value").alias("top"))
    return e.join(top, "user_id").select("user_id", "event_id", F.round(F.col("value") / F.col("top"), 6).alias("share"))


@REGISTRY.query("SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def distinct_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'error'").select("user_id").union(e.where("event_type = 'purchase'").select("user_id")).distinct()


@REGISTRY.query("SELECT o_custkey AS parent, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def latest_child(spark, sf_dir):
    """The last order of each customer."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("parent")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@REGISTRY.query("""
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def zero_fill_counts(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@REGISTRY.query("""
SELECT d.doc_id FROM documents d LEFT JOIN (SELECT vec_id, count(DISTINCT label % 3) AS k FROM embeddings GROUP BY 1) e ON e.vec_id = d.doc_id WHERE coalesce(k, 0) < 1""")
def missing_models(spark, sf_dir):
    """Rows with fewer models than wanted, also those with none."""
    k = table(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.countDistinct(F.col("label") % 3).alias("k"))
    return table(spark, sf_dir, "documents").join(k, "doc_id", "left").where(F.coalesce("k", F.lit(0)) < 1).select("doc_id")


@REGISTRY.query("""
WITH l AS (SELECT doc_id, n_chars % 7 AS level, row_number() OVER (PARTITION BY source ORDER BY n_chars % 7 DESC, n_chars DESC, doc_id) AS r, source FROM documents) SELECT source, doc_id, level FROM l WHERE r = 1""")
def multi_level_dedup(spark, sf_dir):
    """One result per source, of the higher level first."""
    d = table(spark, sf_dir, "documents").withColumn("level", F.col("n_chars") % 7)
    return top_per_key(d, ["source"], [F.desc("level"), F.desc("n_chars"), F.asc("doc_id")], 1).select("source", "doc_id", "level")


@REGISTRY.query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT user_id, event_id FROM r WHERE r <= 20 - user_id % 10""")
def import_quota(spark, sf_dir):
    """As many rows per user as the quota leaves."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w))
    return e.where(F.col("r") <= 20 - F.col("user_id") % 10).select("user_id", "event_id")


@REGISTRY.query("""
SELECT o_custkey AS customer, count(*) AS orders, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey""")
def export_nested(spark, sf_dir):
    """Children nested in their parent, in order."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer"))
    return o.agg(F.count("*").alias("orders"), F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
