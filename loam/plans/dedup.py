"""Duplicates, merging and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.lexical import tokens
from loam.operators import dedup, graph, merges
from loam.registry import Registry
from loam.sources.tables import checkpointed, table

REGISTRY = Registry()


@REGISTRY.query("""
WITH h AS (SELECT doc_id, sha256(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS hash FROM documents)
SELECT hash, min(doc_id) AS kept, count(*) AS copies FROM h GROUP BY hash""")
def exact_dedup(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select("doc_id", dedup.content_hash(F.col("text")).alias("hash"))
    return h.groupBy("hash").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


@REGISTRY.query("""
WITH n AS (SELECT c_custkey AS id, c_name AS t, c_nationkey AS b FROM customer)
SELECT x.id AS id1, y.id AS id2, round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)), 6) AS similarity
FROM n x JOIN n y ON x.b = y.b AND x.id < y.id WHERE 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= 0.94""")
def levenshtein_pairs(spark, sf_dir):
    found = dedup.close_texts(table(spark, sf_dir, "customer"), "c_custkey", "c_name", 0.94, F.col("c_nationkey"))
    return found.withColumn("similarity", F.round("similarity", 6))


#: Near copies: texts of a language whose distinct words have a Jaccard similarity of 0.7; equal texts once.
COPIES = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, source, n_chars, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS x
  FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))))
), w AS (SELECT doc_id, lang, len(x) AS n, unnest(x) AS e FROM d),
p AS (
  SELECT id1, id2, c / (n1 + n2 - c)::DOUBLE AS s FROM (
    SELECT a.doc_id AS id1, b.doc_id AS id2, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS c
    FROM w a JOIN w b ON a.e = b.e AND a.lang = b.lang AND a.doc_id < b.doc_id GROUP BY 1, 2)
  WHERE c / (n1 + n2 - c)::DOUBLE >= 0.7)
"""


def _copies(spark, sf_dir):
    """The documents of COPIES with their words, and the pairs (id1, id2, s)."""
    d = table(spark, sf_dir, "documents")
    firsts = d.groupBy(dedup.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    kept = checkpointed(d.join(firsts, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("lang").alias("k"), "text", "source", "n_chars", F.array_distinct(tokens(F.col("text"))).alias("x")))
    return kept, checkpointed(dedup.similar_sets(kept.where("size(x) > 0").select("id", "k", "x"), 0.7))


@REGISTRY.query(COPIES + """
, bidi AS (SELECT id1 AS a, id2 AS b FROM p UNION SELECT id2, id1 FROM p),
reach AS (SELECT a, b FROM bidi UNION SELECT r.a, x.b FROM reach r JOIN bidi x ON r.b = x.a),
comp AS (SELECT a AS doc_id, least(a, min(b)) AS cluster FROM reach GROUP BY a),
safe AS (SELECT cluster, coalesce(toxic, 0) = 1 AS by_type, d.n_chars % 97 = 0 AS pin, len(list_filter(['allergy','allergic','allergies','medication','medicine','drug','medical','health','diagnosis','emergency','epipen','anaphylaxis',
  'danger','dangerous','warning','never','must not','do not','critical','fatal','lethal','password','secret','confidential','ssn','social security'], lambda k: contains(lower(text), k))) > 0 AS word
  FROM comp JOIN d USING (doc_id) LEFT JOIN labels USING (doc_id)),
flags AS (SELECT cluster, count(*) AS members, bool_or(by_type OR word) AS protected, bool_or(by_type OR pin) AS review FROM safe GROUP BY cluster),
sims AS (SELECT cluster, min(s) AS least FROM p JOIN comp ON comp.doc_id = id1 GROUP BY cluster)
SELECT cluster, members, round(least, 6) AS least, CASE WHEN protected THEN 'skip' WHEN least >= 0.88 AND NOT review THEN 'auto' WHEN least >= 0.82 AND NOT review THEN 'auto_resolve' WHEN least >= 0.80 THEN 'merge' ELSE 'queue' END AS action
FROM flags JOIN sims USING (cluster)""")
def dedup_decision(spark, sf_dir):
    """What becomes of each cluster of near copies, by its least similarity and the safety of
    its members: toxic texts stand for the protected type, odd lengths for pins."""
    docs, pairs = _copies(spark, sf_dir)
    comp = checkpointed(graph.components(pairs.select(F.col("id1").alias("src"), F.col("id2").alias("dst"))))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic", "quality")
    kind, never = F.when(F.col("toxic") == 1, "CONSTRAINT"), F.lit(None).cast("timestamp")
    careful = dedup.safety(F.col("text"), kind, 0.3 + 0.6 * F.col("quality"), never, F.lit("2024-03-01").cast("timestamp"), F.col("n_chars") % 97 == 0)
    rows = comp.withColumnRenamed("node", "id").join(docs.drop("x", "k"), "id").join(labels, "id", "left").select("component", careful.alias("c"))
    flags = rows.groupBy("component").agg(F.count("*").alias("members"), F.bool_or("c.protected").alias("protected"), F.bool_or("c.review").alias("review"))
    least = pairs.join(comp, pairs["id1"] == comp["node"]).groupBy("component").agg(F.min("s").alias("least"))
    action = dedup.cluster_action(F.col("least"), F.col("protected"), F.col("review"))
    return flags.join(least, "component").select(F.col("component").alias("cluster"), "members", F.round("least", 6).alias("least"), action.alias("action"))


@REGISTRY.query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) SELECT source, doc_id AS id FROM r WHERE r = 1""")
def merge_survivor(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("detail"), F.lit(0).alias("created"), F.lit(0).alias("importance"))
    return dedup.survivor(d, "source", "detailed").select("source", "id")


@REGISTRY.query("""
SELECT doc_id, round(least(100.0, least(30.0, length(text) / 20) + least(25.0, len(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))))
 + least(15.0, len(regexp_extract_all(text, '[0-9]+')) * 3.0) + least(20.0, len(regexp_extract_all(text, '[A-Z][a-z]+')) * 2.0) + least(10.0, len(regexp_extract_all(text, '[.,;:!?]')) * 0.5))::DOUBLE, 6) AS detail FROM documents""")
def detail_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(dedup.detail_score(F.col("text")), 6).alias("detail"))


@REGISTRY.query("SELECT source, max(n_chars) AS importance, sum(n_chars)::BIGINT AS accesses, max(doc_id) AS latest, count(*) AS members FROM documents GROUP BY source")
def merged_metadata(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.max("n_chars").alias("importance"), F.sum("n_chars").alias("accesses"), F.max("doc_id").alias("latest"), F.count("*").alias("members")
    )


@REGISTRY.query("""
WITH a AS (SELECT md5(text) AS h, max(doc_id) AS id FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1), b AS (SELECT md5(text) AS h, max(doc_id) AS id FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1)
SELECT CASE WHEN b.h IS NULL THEN 'local_only' WHEN a.h IS NULL THEN 'cloud_only' ELSE 'shared' END AS side, count(*) AS n FROM a FULL JOIN b ON a.h = b.h GROUP BY 1""")
def reconcile(spark, sf_dir):
    """What either side alone has, and both, by hash; equal hashes are one."""
    d = table(spark, sf_dir, "documents").withColumn("h", F.md5("text"))
    side = lambda cond, name: d.where(cond).groupBy("h").agg(F.max("doc_id").alias(name))
    both = side("doc_id % 3 <> 0", "a").join(side("doc_id % 3 <> 1", "b"), "h", "full_outer")
    return both.groupBy(F.when(F.col("b").isNull(), "local_only").when(F.col("a").isNull(), "cloud_only").otherwise("shared").alias("side")).agg(F.count("*").alias("n"))


@REGISTRY.query(COPIES + """
, f AS (SELECT doc_id, source, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: regexp_matches(w, '^[a-z]{4,}$'))) AS f FROM d)
SELECT id1, id2, round(s, 6) AS similarity, round(0.7 * s + 0.2 * len(list_intersect(a.f, b.f)) / greatest(len(a.f), len(b.f), 1)
  + 0.1 * CASE (a.source = 'src1')::INT + (b.source = 'src1')::INT WHEN 2 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.5 END, 6)::DOUBLE AS score
FROM p JOIN f a ON a.doc_id = id1 JOIN f b ON b.doc_id = id2""")
def pair_score(spark, sf_dir):
    """Similarity, words in common and authority of each pair of near copies; one source
    stands for explicit statements."""
    docs, pairs = _copies(spark, sf_dir)
    source = F.when(F.col("source") == "src1", dedup.EXPLICIT).otherwise(F.col("source"))
    side = lambda k: docs.select(F.col("id").alias(f"id{k}"), F.col("text").alias(f"t{k}"), source.alias(f"o{k}"))
    both = pairs.join(side(1), "id1").join(side(2), "id2")
    score = dedup.pair_score(F.col("s"), *map(F.col, ("t1", "t2", "o1", "o2")))
    return both.select("id1", "id2", F.round("s", 6).alias("similarity"), F.round(score, 6).alias("score"))


@REGISTRY.query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS used, round(least(1.0, 0.3 + 0.05 * count(*) FILTER (event_type = 'view')), 6)::DOUBLE AS importance FROM events GROUP BY user_id""")
def reinforce(spark, sf_dir):
    """Each hit counts once more and lifts importance by 0.05, up to 1."""
    hits = F.count_if(F.col("event_type") == "view")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(hits.alias("used"), F.round(F.least(F.lit(1.0), 0.3 + 0.05 * hits), 6).alias("importance"))


@REGISTRY.query(r"""
WITH d AS (SELECT doc_id, n_chars, sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS h FROM documents),
c AS (SELECT h, min(doc_id) AS event, max(doc_id) AS newest, sum(n_chars)::BIGINT AS accesses FROM d GROUP BY h HAVING count(*) > 1),
e AS (SELECT h, accesses, CASE WHEN event % 3 <> 0 THEN newest WHEN event % 6 = 0 THEN event END AS survivor FROM c)
SELECT doc_id, survivor IS NULL OR survivor = doc_id AS live, CASE WHEN survivor <> doc_id THEN survivor END AS superseded_by, CASE WHEN survivor = doc_id THEN accesses ELSE n_chars END AS accesses
FROM d LEFT JOIN e USING (h)""")
def merge_rollback(spark, sf_dir):
    """Equal texts merged into the newest; every third merge is rolled back, and every sixth
    made again into the oldest; the records that this ledger leaves."""
    d = table(spark, sf_dir, "documents").withColumn("h", dedup.content_hash(F.col("text")))
    cluster = d.groupBy("h").agg(F.min("doc_id").alias("cluster"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = d.join(cluster, "h").select(
        "cluster", F.col("doc_id").alias("id"), "text", none("string").alias("kind"), F.col("doc_id").alias("created"), none("long").alias("observed"),
        F.lit(0.5).alias("importance"), F.col("n_chars").alias("accesses"), none("long").alias("accessed"),
    )
    first = merges.merge_events(rows, 1, F.lit("newest"))
    back = merges.rollbacks(first.where("event % 3 = 0").select("event"), 2)
    again = merges.merge_events(rows.where("cluster % 6 = 0"), 3, F.lit("oldest"), 1_000_000_000_000)
    found = merges.records_at(rows, checkpointed(first.unionByName(back).unionByName(again)))
    return found.select(F.col("id").alias("doc_id"), "live", "superseded_by", "accesses")


@REGISTRY.query("""
SELECT count(*) AS total, count(DISTINCT md5(text)) AS distinct_texts, round(count(*) / count(DISTINCT md5(text)), 6) AS compression FROM documents""")
def dedup_stats(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("total"), F.count("*").alias("distinct_texts"), F.round(F.sum("c") / F.count("*"), 6).alias("compression"))
