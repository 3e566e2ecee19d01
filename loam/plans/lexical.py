"""Search by words: in fields, nearly spelled, and as a rescue for what vectors miss."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.lexical import lexical_search as search_fields
from loam.functions.vectors import top_per_key
from loam.operators import rescue
from loam.plans.search import HITS, _hits
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()

#: Oracle form of the search of all documents by questions ``asked (item_id, text)``.
FIELDED = """
, f AS (
  SELECT doc_id, 'content' AS field, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents
  UNION ALL
  SELECT doc_id, 'tags', list_filter(regexp_split_to_array(lower(concat_ws(' ', lang, source)), '[^a-z0-9]+'), lambda w: w <> '') FROM documents
), stats AS (
  SELECT field, CASE field WHEN 'content' THEN 3.0::DOUBLE ELSE 1.0 END AS boost, count(*) AS n, avg(len(ws)) AS mean FROM f WHERE len(ws) > 0 GROUP BY field
), tf AS (
  SELECT field, doc_id, term, any_value(size) AS size, count(*) AS tf FROM (SELECT field, doc_id, len(ws) AS size, unnest(ws) AS term FROM f) GROUP BY field, doc_id, term
), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY field, term),
q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS w FROM asked),
qw AS (SELECT DISTINCT w, CASE WHEN length(w) <= 2 THEN 0 WHEN length(w) <= 5 THEN 1 ELSE 2 END AS e FROM q),
near AS (
  SELECT w, term, levenshtein(w, term) AS d FROM qw JOIN (SELECT DISTINCT term FROM df) ON abs(length(w) - length(term)) <= e AND levenshtein(w, term) <= e
), stand AS (
  SELECT item_id, w, field, term, (1 - d / least(length(w), length(term))::DOUBLE) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) AS x
  FROM q JOIN near USING (w) JOIN df USING (term) JOIN stats USING (field)
), best AS (
  SELECT item_id, field, doc_id, w, max(x * (tf * 2.2::DOUBLE / (tf + 1.2 * (0.25 + 0.75 * size / mean)))) AS x FROM stand JOIN tf USING (field, term) JOIN stats USING (field) GROUP BY item_id, field, doc_id, w
), lexical AS (
  SELECT item_id, doc_id, s, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS r FROM (
    SELECT item_id, doc_id, round(max(s), 6) AS s FROM (SELECT item_id, doc_id, any_value(boost) * sum(x) AS s FROM best JOIN stats USING (field) GROUP BY item_id, doc_id, field) GROUP BY item_id, doc_id)
  WHERE s > 0
)
"""


def _fields(docs):
    return {"content": (F.col("text"), 3.0), "tags": (F.concat_ws(" ", "lang", "source"), 1.0)}


def _questions(spark, sf_dir):
    """The question of every 100th vector: the benchmark item of that number."""
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 100).alias("query_id"), "text")
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    return items.join(asked, "query_id", "left_semi")


@REGISTRY.query("WITH asked AS (SELECT item_id, text FROM benchmark)" + FIELDED + """
SELECT item_id, doc_id, round(s / max(s) OVER (PARTITION BY item_id), 6) AS score FROM lexical WHERE r <= 20""")
def lexical_search(spark, sf_dir):
    """Twenty best documents per question over two fields, the better field counts; words
    may differ by one edit or two."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search_fields(docs, "doc_id", _fields(docs), items, "item_id", "text", 20)


@REGISTRY.query(HITS.rstrip() + """
, asked AS (SELECT vec_id AS item_id, b.text FROM embeddings JOIN benchmark b ON b.item_id * 100 = vec_id WHERE vec_id % 100 = 0)""" + FIELDED + """
, v AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM hits),
terms AS (
  SELECT item_id AS query_id, unnest(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] ELSE '' END), lambda w: w <> '')[1:8]) AS term FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 4
      AND NOT list_contains(['about','does','doing','have','mine','need','tell','that','this','what','when','where','which','whose','with','your'], w)) AS l FROM asked)
), rescued AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, id DESC) AS r FROM (
    SELECT DISTINCT query_id, d.doc_id AS id, coalesce(0.3 + 0.6 * quality, 0.5) AS importance
    FROM terms JOIN documents d ON contains(lower(d.text), term) LEFT JOIN labels l ON l.doc_id = d.doc_id)
), every AS (
  SELECT query_id, id, s, false AS rescued FROM v WHERE r <= 50
  UNION ALL SELECT item_id, doc_id, 1.25, true FROM lexical WHERE r <= 100
  UNION ALL SELECT query_id, id, 1.1, true FROM rescued WHERE r <= 20
)
SELECT query_id, id, round(max(s), 6) AS score, bool_or(rescued) AS rescued FROM every GROUP BY query_id, id""")
def lexical_rescue(spark, sf_dir):
    """Vector hits, lifted to fixed scores or joined by what a question's words find: the
    first hundred by fields, and twenty important rows that contain one of its terms."""
    docs, asked = table(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    hits = top_per_key(_hits(spark, sf_dir, k=50), ["query_id"], [F.desc("score"), F.asc("id")], 50)
    full = search_fields(docs, "doc_id", _fields(docs), asked, "query_id", "text", rescue.FULL_TEXT_ROWS).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))
    importance = F.coalesce(0.3 + 0.6 * F.col("quality"), F.lit(0.5)).alias("importance")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), "text", importance)
    found = rescue.rows_with_terms(rows, asked.select("query_id", rescue.rescue_terms(F.col("text")).alias("terms")), ["importance", "id"])
    found = rescue.best_rows(found, [F.desc("importance"), F.desc("id")])
    merged = rescue.inject(hits, [(full, rescue.FULL_TEXT_SCORE), (found, rescue.RESCUE_SCORE)])
    return merged.select("query_id", "id", F.round("score", 6).alias("score"), "rescued")
