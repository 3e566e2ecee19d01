"""Recall branches: boosts, merges, windows, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.vectors import top_per_key
from loam.operators import dedup, fusion, greedy
from loam.operators.communities import louvain, weighted_pairs
from loam.plans.ranking import tokens
from loam.plans.search import HITS, _hits, similar_pairs
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


def _score(df, column="score"):
    return df.select("query_id", "id", F.round(column, 6).alias("score"))


@REGISTRY.query(HITS + "SELECT query_id, id, round(s * CASE WHEN label = query_id % 10 THEN 1.3 ELSE 1.0 END, 6) AS score, round(least(1.0, s * 1.5), 6) AS delegated FROM hits")
def agent_boost(spark, sf_dir):
    """Rows of one's own agent gain; a delegator's up to 1."""
    own = F.when(F.col("label") == F.col("query_id") % 10, 1.3).otherwise(1.0)
    found = _hits(spark, sf_dir, group="label")
    return found.select("query_id", "id", F.round(F.col("score") * own, 6).alias("score"), F.round(F.least(F.lit(1.0), F.col("score") * 1.5), 6).alias("delegated"))


@REGISTRY.query(HITS + """
, i AS (SELECT h.query_id, h.id, s + 0.3 * (0.6 + 0.4 * quality) AS x FROM hits h JOIN labels l ON l.doc_id = h.id WHERE quality = 1 AND s > 0.1)
SELECT query_id, id, round(x, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS r FROM i) WHERE r <= 25""")
def insight_surfacing(spark, sf_dir):
    """Important rows over a low similarity, by similarity and importance; 25 at most."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"), "quality")
    rows = table(spark, sf_dir, "embeddings").join(good, "vec_id")
    found = _hits(spark, sf_dir, min_score=0.1, rows=rows, group="quality").where("score > 0.1").withColumn("score", F.col("score") + 0.3 * (0.6 + 0.4 * F.col("quality")))
    return _score(top_per_key(found, ["query_id"], [F.desc("score"), F.asc("id")], 25))


@REGISTRY.query(HITS + """
, t AS (SELECT query_id, id, s, CASE WHEN label < 3 THEN 1.0 WHEN label < 5 THEN 0.7 ELSE 0.0 END AS rel FROM hits)
SELECT query_id, id, round(0.3 * greatest(s, 0.1) + 0.5 * rel + 0.2 * 0.5, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, s DESC, id) AS r FROM t WHERE rel > 0) WHERE r <= 120""")
def temporal_blend(spark, sf_dir):
    """Semantic, temporal and importance shares for rows near a time window."""
    rel = F.when(F.col("label") < 3, 1.0).when(F.col("label") < 5, 0.7).otherwise(0.0)
    rows = table(spark, sf_dir, "embeddings").withColumn("rel", rel).where("rel > 0")
    found = _hits(spark, sf_dir, 120, rows=rows, group="rel")
    found = top_per_key(found, ["query_id"], [F.desc("rel"), F.desc("score"), F.asc("id")], 120)
    return _score(found.withColumn("score", 0.3 * F.greatest(F.col("score"), F.lit(0.1)) + 0.5 * F.col("rel") + 0.2 * 0.5))


@REGISTRY.query("""
WITH q AS (SELECT item_id, TIMESTAMP '2024-01-02' + INTERVAL 1 HOUR * item_id AS a, TIMESTAMP '2024-01-02 00:10:00' + INTERVAL 1 HOUR * item_id AS b FROM benchmark)
, l AS (SELECT item_id, unnest(range(0, 4)) AS level, a, b FROM q), w AS (SELECT item_id, level, a - (b - a) * (2 ** level - 1)::INT AS lo, b AS hi FROM l)
, c AS (SELECT item_id, level, count(event_id) AS n FROM w LEFT JOIN events ON ts BETWEEN lo AND hi GROUP BY item_id, level)
SELECT item_id, coalesce(min(level) FILTER (n >= 5), 3)::BIGINT AS level, coalesce(min(n) FILTER (n >= 5), max(n)) AS n FROM c GROUP BY item_id""")
def window_expansion(spark, sf_dir):
    """The least of four widths of a time window that finds five events, all counted in
    one pass over the events."""
    hour = F.unix_micros(F.lit("2024-01-02").cast("timestamp"))
    q = table(spark, sf_dir, "benchmark").select("item_id", (hour + F.col("item_id") * 3_600_000_000).alias("a"))
    level = q.select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("level"), "a")
    width = F.lit(600_000_000)
    w = level.select("item_id", "level", (F.col("a") - width * (F.pow(F.lit(2), "level") - 1).cast("long")).alias("lo"), (F.col("a") + width).alias("hi"))
    # Events meet windows by hour: a window of up to 80 minutes touches at most three hours.
    hours = w.withColumn("h", F.explode(F.sequence(F.floor(F.col("lo") / 3_600_000_000), F.floor(F.col("hi") / 3_600_000_000))))
    e = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withColumn("h", F.floor(F.col("t") / 3_600_000_000))
    n = hours.join(e, "h").where("t BETWEEN lo AND hi").groupBy("item_id", "level").agg(F.count("*").alias("n"))
    c = w.join(n, ["item_id", "level"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= 5
    return c.groupBy("item_id").agg(
        F.coalesce(F.min(F.when(enough, F.col("level"))), F.lit(3)).alias("level"), F.coalesce(F.min(F.when(enough, F.col("n"))), F.max("n")).alias("n")
    )


@REGISTRY.query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1")
def first_mention(spark, sf_dir):
    """The earliest by effective time."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return top_per_key(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], 1).select("user_id", "event_id")


@REGISTRY.query(HITS + """SELECT query_id, h.id, round(s, 6) AS score FROM hits h JOIN documents d ON d.doc_id = h.id WHERE s > 0.1 AND (text ILIKE '%idiot%' OR source = 'src3')""")
def failure_search(spark, sf_dir):
    """Hits that a keyword or a field marks."""
    marked = _docs(spark, sf_dir).where(F.col("text").ilike("%idiot%") | (F.col("source") == "src3")).select(F.col("id").alias("vec_id"))
    rows = table(spark, sf_dir, "embeddings").join(marked, "vec_id", "left_semi")
    return _score(_hits(spark, sf_dir, min_score=0.1, rows=rows).where("score > 0.1"))


@REGISTRY.query(HITS + "SELECT query_id, id, round(s, 6) AS score FROM hits WHERE s > 0.3 AND label IN (0, 1, 2, 3)")
def contradiction_candidates(spark, sf_dir):
    """Neighbours of some types over a similarity, the row itself left out."""
    rows = table(spark, sf_dir, "embeddings").where("label IN (0, 1, 2, 3)")
    return _score(_hits(spark, sf_dir, min_score=0.3, rows=rows).where("score > 0.3"))


@REGISTRY.query(HITS + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r1 FROM hits), r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (id * 7919) % 1009, id) AS r2 FROM r WHERE r1 <= 10)
SELECT query_id, id, round(1.0 / (60 + r1) + 1.0 / (60 + CASE WHEN r2 <= 5 THEN r2 ELSE 11 END), 6)::DOUBLE AS score FROM r2""")
def rerank_fusion(spark, sf_dir):
    """Ranks of two rerankers fused; a rank that one lacks counts as n + 1."""
    one = top_per_key(_hits(spark, sf_dir, k=10), ["query_id"], [F.desc("score"), F.asc("id")], 10, "r1")
    two = top_per_key(one, ["query_id"], [F.asc((F.col("id") * 7919) % 1009), F.asc("id")], 5, "r2").select("query_id", "id", "r2")
    rank = fusion.reciprocal_rank
    found = one.join(two, ["query_id", "id"], "left").withColumn("score", rank(F.col("r1")) + rank(F.coalesce("r2", F.lit(11))))
    return _score(found)


@REGISTRY.query("""
WITH g AS (SELECT c_custkey AS id, c_nationkey AS k, list_distinct(list_transform(range(1, greatest(length(c_name) - 1, 2)), lambda i: substr(lower(c_name), i, 3))) AS x FROM customer)
SELECT a.id AS id1, b.id AS id2, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))), 6) AS similarity FROM g a JOIN g b ON a.k = b.k AND a.id < b.id
WHERE len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) >= 0.85""")
def trigram_match(spark, sf_dir):
    """Names of one scope that share enough trigrams."""
    name = F.lower("c_name")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: F.substring(name, i, F.lit(3))))
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), grams.alias("x"))
    found = dedup.similar_sets(g, 0.85)
    return found.select("id1", "id2", F.round("s", 6).alias("similarity"))


@REGISTRY.query("""
WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM documents), c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('good', 'like', 'love', 'great'))) AS p,
 len(list_filter(w, lambda x: x IN ('idiot', 'scum', 'trash', 'pathetic', 'stupid'))) AS n FROM w)
SELECT doc_id, CASE WHEN p = 0 AND n = 0 THEN 'neutral' WHEN p >= n THEN 'positive' ELSE 'negative' END AS polarity, CASE WHEN p = 0 AND n = 0 THEN 0.75 WHEN p >= n THEN 1.0 ELSE 0.15 END::DOUBLE AS penalty FROM c""")
def sentiment_penalty(spark, sf_dir):
    """Polarity by word counts, ties positive, and its weight for a positive query."""
    w = tokens(F.col("text"))
    count = lambda *words: F.size(F.filter(w, lambda x: x.isin(*words)))
    p, n = count("good", "like", "love", "great"), count("idiot", "scum", "trash", "pathetic", "stupid")
    kind = F.when((p == 0) & (n == 0), "neutral").when(p >= n, "positive").otherwise("negative")
    d = table(spark, sf_dir, "documents").select("doc_id", kind.alias("polarity"))
    weight = F.when(F.col("polarity") == "neutral", 0.75).when(F.col("polarity") == "positive", 1.0).otherwise(0.15)
    return d.withColumn("penalty", weight)


@REGISTRY.query("""
WITH m AS (SELECT source, lang, count(*) AS w FROM documents GROUP BY 1, 2), b AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents)
SELECT source, lang, doc_id, round(w * n_chars / 1000.0 * greatest(0.1, 1 - 30 / 90.0), 6)::DOUBLE AS salience FROM m JOIN b USING (lang) WHERE r = 1""")
def entity_radiation(spark, sf_dir):
    """The best memory of each neighbouring entity, by edge weight, score and age."""
    d = table(spark, sf_dir, "documents")
    edges = d.groupBy("source", "lang").agg(F.count("*").alias("w"))
    best = top_per_key(d, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 1).select("lang", "doc_id", "n_chars")
    salience = F.col("w") * F.col("n_chars") / 1000.0 * F.greatest(F.lit(0.1), F.lit(1 - 30 / 90.0))
    return edges.join(best, "lang").select("source", "lang", "doc_id", F.round(salience, 6).alias("salience"))


@REGISTRY.query("""
WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS day, list(event_id ORDER BY event_id) AS ids, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 95 GROUP BY 1) SELECT day, n, ids[1] AS first, ids[-1] AS last FROM t""")
def trace_timeline(spark, sf_dir):
    """Hits of a topic by day."""
    hits = table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 95").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return hits.agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@REGISTRY.query("""
SELECT p_type AS class, CASE WHEN p_size >= 45 THEN 'auto' WHEN p_size >= 30 AND p_brand NOT LIKE '%1' THEN 'merge' WHEN p_size >= 30 THEN 'queue' ELSE 'keep' END AS policy, count(*) AS n FROM part GROUP BY 1, 2""")
def resolution_policy(spark, sf_dir):
    """What becomes of a pair by class and confidence; critical ones are queued."""
    sure, likely, critical = F.col("p_size") >= 45, F.col("p_size") >= 30, F.col("p_brand").like("%1")
    policy = F.when(sure, "auto").when(likely & ~critical, "merge").when(likely, "queue").otherwise("keep")
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("class"), policy.alias("policy")).agg(F.count("*").alias("n"))


@REGISTRY.query()
def greedy_dedup(spark, sf_dir):
    """Of similar pairs in order, the row with the lower score goes."""
    score = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (0.3 + 0.6 * F.col("quality")).alias("score"))
    rows = table(spark, sf_dir, "embeddings").join(score, "vec_id", "left")
    return greedy.drop_similar(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "score"), 0.35)


@REGISTRY.query()
def greedy_clusters(spark, sf_dir):
    """Seed clusters of at least three, per label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return greedy.seed_clusters(e, "label", 0.2, 3)


@REGISTRY.query()
def communities(spark, sf_dir):
    """Communities of parts, suppliers, nations and regions: an edge weighs as many line
    items as make it, and similar vectors of parts tie them a little."""
    from loam.plans.graphs import _edges

    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.lit(1_000_000_000) + F.col("l_suppkey")).alias("dst"))
    rest = _edges(spark, sf_dir).where("src >= 1000000000")
    soft = similar_pairs(table(spark, sf_dir, "embeddings"), 0.35).select(F.col("id1").alias("src"), F.col("id2").alias("dst"))
    return louvain(weighted_pairs(items.unionByName(rest), soft))


@REGISTRY.query()
def recall_pipeline(spark, sf_dir):
    """Search, fuse the models' lists, blend with importance, keep what is near the best."""
    from loam.plans.ranking import _lists

    fused = fusion.fuse_weighted(_lists(spark, sf_dir), {"m0": 1.0, "m1": 0.8, "m2": 0.7})
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    importance = F.coalesce(0.3 + 0.6 * F.col("quality"), F.lit(0.5))
    sentiment = F.when(F.col("toxic") == 1, 0.15).otherwise(1.0)
    scored = fused.join(labels, "id", "left").withColumn("score", fusion.blend(F.col("fused"), importance, sentiment))
    best = scored.groupBy("query_id").agg(F.max("score").alias("top"))
    kept = scored.join(best, "query_id").where(F.col("score") >= 0.7 * F.col("top"))
    return top_per_key(kept, ["query_id"], [F.desc("score"), F.asc("id")], 10, "rank").select("query_id", "id", F.round("score", 6).alias("score"), "rank")
