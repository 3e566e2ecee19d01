"""Questions in several forms: variants by rules, a search of each, and their fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.lexical import tfidf_top
from loam.functions.vectors import top_per_key
from loam.operators import expansion, fusion
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()

#: How the questions begin: one for each family of rules, and one for none.
OPENINGS = [
    "What does Theo like? ", "Tell me about ", "How do I fix ", "When did ", "why is my ", "Where can I find ", "What happened to ", "remember when ",
    "test all ", "Problems with ", "what do I know about ", "what did I learn from ", "who is ", "What is ", "",
]

ASKED = f"""
WITH asked AS (SELECT item_id, [{", ".join(f"'{x}'" for x in OPENINGS)}][1 + item_id % {len(OPENINGS)}] || text || CASE WHEN item_id % {len(OPENINGS)} = 8 THEN ' best practices' ELSE '' END AS text FROM benchmark),
"""


def _questions(spark, sf_dir):
    kind = F.col("item_id") % len(OPENINGS)
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (kind + 1).cast("int"))
    ending = F.when(kind == 8, " best practices").otherwise("")
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(opening, "text", ending).alias("text"))


@REGISTRY.query(ASKED + expansion.expansion_sql() + "SELECT item_id, position, variant, CASE position WHEN 0 THEN 'original' ELSE 'rules' END AS source FROM variants")
def expand_queries(spark, sf_dir):
    """Variants of each question, the question itself first."""
    return expansion.expand_queries(_questions(spark, sf_dir))


#: Oracle form of the fused lists of the variants' best twenty documents.
SEARCHED = """
, words AS (SELECT item_id, position, unnest(list_distinct(list_filter(regexp_split_to_array(lower(variant), '[^a-z0-9]+'), lambda w: w <> ''))) AS w FROM variants),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents) GROUP BY doc_id, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), n AS (SELECT count(*) AS n FROM documents),
scored AS (SELECT item_id, position, doc_id, round(sum((1 + ln(tf)) * ln(1 + n / (1 + df))), 3) AS s FROM words JOIN tf USING (w) JOIN df USING (w), n GROUP BY item_id, position, doc_id),
lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, position ORDER BY s DESC, doc_id) AS r FROM scored) WHERE r <= 20),
fused AS (SELECT item_id, doc_id, count(*) AS lists, sum(CASE position WHEN 0 THEN 2.0::DOUBLE ELSE 1.0 END / (60 + r)) AS f FROM lists GROUP BY item_id, doc_id),
shares AS (SELECT item_id, doc_id, lists, round(f / max(f) OVER (PARTITION BY item_id), 6) AS fused FROM fused)
SELECT item_id, doc_id, fused, lists, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM shares) WHERE rank <= 10
"""


def _search(spark, sf_dir, most):
    variants = expansion.expand_queries(_questions(spark, sf_dir), most)
    keyed = variants.select((F.col("item_id") * expansion.MOST_VARIANTS + F.col("position")).alias("key"), "variant")
    found = tfidf_top(table(spark, sf_dir, "documents"), "doc_id", "text", keyed, "key", "variant", 20)
    ranked = top_per_key(found, ["item_id"], [F.desc("score"), F.asc("doc_id")], 20, "rank")
    position = F.pmod("item_id", F.lit(expansion.MOST_VARIANTS))
    lists = ranked.select(
        F.expr(f"item_id div {expansion.MOST_VARIANTS}").alias("query_id"), F.col("doc_id").alias("id"), "rank", "score", F.when(position == 0, "original").otherwise("rules").alias("source")
    )
    fused = fusion.fuse_weighted(lists, {"original": 2.0, "rules": 1.0}).withColumn("fused", F.round("fused", 6))
    best = top_per_key(fused, ["query_id"], [F.desc("fused"), F.asc("id")], 10, "rank")
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "fused", "lists", "rank")


@REGISTRY.query(ASKED + expansion.expansion_sql() + SEARCHED)
def multi_query_pipeline(spark, sf_dir):
    """All variants of all questions searched in one pass, their lists fused by weight."""
    return _search(spark, sf_dir, expansion.MOST_VARIANTS)


@REGISTRY.query(ASKED + expansion.expansion_sql(expansion.FEWER_VARIANTS) + SEARCHED)
def multi_query_short(spark, sf_dir):
    """The same with three variants at most, where time is short."""
    return _search(spark, sf_dir, expansion.FEWER_VARIANTS)
