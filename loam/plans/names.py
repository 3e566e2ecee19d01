"""Names: what they stand for, and recall through the graph around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.vectors import top_per_key
from loam.operators import names
from loam.plans.graphs import _edges
from loam.plans.search import HITS, _hits
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()

LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: Names of parts, suppliers, nations and regions under the numbers of their graph.
NAMED = """
parts AS (SELECT p_partkey, p_partkey AS entity, p_name || ' ' || lower(p_type) || ' ' || p_brand AS name, p_brand || '-' || p_partkey AS alias FROM part),
entities AS (
  SELECT entity, name FROM parts UNION ALL SELECT 1000000000 + s_suppkey, s_name FROM supplier
  UNION ALL SELECT 2000000000 + n_nationkey, n_name FROM nation UNION ALL SELECT 3000000000 + r_regionkey, r_name FROM region
)"""


def _parts(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("long").alias("entity"), name.alias("name"), F.concat_ws("-", "p_brand", "p_partkey").alias("alias"))


def _entities(spark, sf_dir):
    out = _parts(spark, sf_dir).select("entity", "name")
    for kind, name, key, text in ((1, "supplier", "s_suppkey", "s_name"), (2, "nation", "n_nationkey", "n_name"), (3, "region", "r_regionkey", "r_name")):
        out = out.unionByName(table(spark, sf_dir, name).select((F.lit(kind * 1_000_000_000) + F.col(key)).cast("long").alias("entity"), F.col(text).alias("name")))
    return out


def _letters(name):
    """How often each letter is in a name."""
    low = F.lower(name)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


@REGISTRY.query("WITH " + NAMED + f"""
, asked AS (SELECT p_partkey AS ask, CASE (p_partkey // 100) % 5 WHEN 0 THEN upper(name) WHEN 1 THEN lower(alias) WHEN 2 THEN substr(name, 1, 2) || substr(name, 4)
  WHEN 3 THEN reverse(name) ELSE '??' END AS name FROM parts WHERE p_partkey % 100 = 0),
s1 AS (SELECT ask, min(entity) AS entity, 'exact' AS stage, 1.0::DOUBLE AS score FROM asked a JOIN parts p ON lower(a.name) = lower(p.name) GROUP BY ask),
s2 AS (SELECT ask, min(entity), 'alias', 1.0::DOUBLE FROM asked a JOIN parts p ON lower(a.name) = lower(p.alias) WHERE ask NOT IN (SELECT ask FROM s1) GROUP BY ask),
left2 AS (SELECT * FROM asked WHERE ask NOT IN (SELECT ask FROM s1 UNION ALL SELECT ask FROM s2)),
ga AS (SELECT ask, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM left2),
gp AS (SELECT entity, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS x FROM parts),
fuzzy AS (SELECT ask, entity, round(len(list_intersect(g, x)) / len(list_distinct(list_concat(g, x))), 6) AS score FROM ga, gp WHERE len(g) > 0 AND len(x) > 0),
s3 AS (SELECT ask, entity, 'fuzzy' AS stage, score FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, entity) AS r FROM fuzzy WHERE score > 0.4) WHERE r = 1),
left3 AS (SELECT * FROM left2 WHERE ask NOT IN (SELECT ask FROM s3)),
letters AS (SELECT string_split('{LETTERS}', '') AS c),
va AS (SELECT ask, list_transform(c, lambda x: (length(name) - length(replace(lower(name), x, '')))::DOUBLE) AS v FROM left3, letters),
vp AS (SELECT entity, list_transform(c, lambda x: (length(name) - length(replace(lower(name), x, '')))::DOUBLE) AS v FROM parts, letters),
near AS (SELECT ask, entity, round(list_cosine_similarity(va.v, vp.v), 6) AS score FROM va, vp WHERE list_sum(va.v) > 0),
s4 AS (SELECT ask, entity, 'vector' AS stage, score FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, entity) AS r FROM near WHERE score >= 0.75) WHERE r = 1),
done AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)
SELECT * FROM done UNION ALL SELECT ask, NULL, 'none', 0.0 FROM asked WHERE ask NOT IN (SELECT ask FROM done)""")
def name_resolution(spark, sf_dir):
    """Every 100th part's name in capitals, by its alias, misspelt, backwards, or lost."""
    parts = _parts(spark, sf_dir)
    kind, name = F.expr("p_partkey div 100") % 5, F.col("name")
    written = F.when(kind == 0, F.upper(name)).when(kind == 1, F.lower("alias")).when(kind == 2, F.concat(F.substring(name, 1, 2), F.expr("substring(name, 4)"))).when(kind == 3, F.reverse(name)).otherwise("??")
    asked = parts.where("p_partkey % 100 = 0").select(F.col("entity").alias("ask"), written.alias("name"))
    return names.resolve_names(asked, parts.select("entity", "name"), parts.select("entity", "alias"), _letters)


RECALLED = NAMED + """
, edges AS (SELECT DISTINCT l_partkey AS src, 1000000000 + l_suppkey AS dst FROM lineitem UNION ALL SELECT 1000000000 + s_suppkey, 2000000000 + s_nationkey FROM supplier
  UNION ALL SELECT 2000000000 + n_nationkey, 3000000000 + n_regionkey FROM nation),
mentions AS (SELECT DISTINCT l_partkey AS entity, l_orderkey AS id FROM lineitem UNION SELECT DISTINCT 1000000000 + l_suppkey, l_orderkey FROM lineitem),
latest AS (SELECT entity, id, row_number() OVER (PARTITION BY entity ORDER BY id DESC) AS place, count(*) OVER (PARTITION BY entity) AS mentioned FROM mentions),
asked AS (
  SELECT p_partkey AS query_id, name AS n1, 'NATION_' || (p_partkey // 100 % 25) AS n2, 'Supplier#0000000' || lpad((p_partkey // 100 % 10)::VARCHAR, 2, '0') AS n3, alias AS n4 FROM parts WHERE p_partkey % 100 = 0
), spotted AS (SELECT query_id, unnest([n1, n2, n3, n4]) AS name FROM asked),
meant AS (
  SELECT name, entity FROM (
    SELECT name, entity, row_number() OVER (PARTITION BY name ORDER BY stage, coalesce(mentioned, 0) DESC, entity) AS r FROM (
      SELECT name, entity, min(stage) AS stage FROM (
        SELECT s.name, min(e.entity) AS entity, 0 AS stage FROM (SELECT DISTINCT name FROM spotted) s JOIN entities e ON lower(s.name) = lower(e.name) GROUP BY s.name
        UNION ALL SELECT s.name, min(p.entity), 1 FROM (SELECT DISTINCT name FROM spotted) s JOIN parts p ON lower(s.name) = lower(p.alias) GROUP BY s.name
        UNION ALL SELECT s.name, e.entity, 2 FROM (SELECT DISTINCT name FROM spotted) s JOIN entities e ON contains(lower(e.name), lower(s.name))
      ) GROUP BY name, entity
    ) LEFT JOIN (SELECT entity, any_value(mentioned) AS mentioned FROM latest GROUP BY entity) USING (entity)
  ) WHERE r <= 3
), steps AS (
  SELECT DISTINCT m.entity, e.dst AS related FROM (SELECT DISTINCT entity FROM meant) m JOIN edges e ON e.src = m.entity
  UNION SELECT m.entity, f.dst FROM (SELECT DISTINCT entity FROM meant) m JOIN edges e ON e.src = m.entity JOIN edges f ON f.src = e.dst
), ties AS (
  SELECT query_id, id FROM spotted JOIN meant USING (name) JOIN latest USING (entity) WHERE place <= 10
  UNION ALL SELECT query_id, id FROM spotted JOIN meant m USING (name) JOIN steps s ON s.entity = m.entity JOIN latest l ON l.entity = s.related WHERE place <= 5 AND s.related <> m.entity
), scored AS (SELECT query_id, id, count(*) AS hits, round(0.7 + 0.1 * (count(*) - 1), 6)::DOUBLE AS score FROM ties GROUP BY query_id, id),
recalled AS (SELECT query_id, id, hits, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS r FROM scored) WHERE r <= 20)
"""


def _recalled(spark, sf_dir):
    """A question for every 100th part: its name quoted, a nation after a possessive, a
    supplier in capitals and the part's alias."""
    parts, n = _parts(spark, sf_dir), F.expr("p_partkey div 100")
    supplier = F.concat(F.lit("Supplier#0000000"), F.lpad((n % 10).cast("string"), 2, "0"))
    text = F.concat(F.lit('Tell me what happened to "'), "name", F.lit('" in our NATION_'), n % 25, F.lit(". It came from "), supplier, F.lit(", the Tell of "), "alias", F.lit("?"))
    questions = parts.where("p_partkey % 100 = 0").select(F.col("entity").alias("query_id"), text.alias("text"))
    items = table(spark, sf_dir, "lineitem")
    mentions = items.select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("id")).unionByName(items.select((F.lit(1_000_000_000) + F.col("l_suppkey")).alias("entity"), F.col("l_orderkey").alias("id")))
    return names.graph_recall(questions, _entities(spark, sf_dir), parts.select("entity", "alias"), _edges(spark, sf_dir), mentions, 20)


@REGISTRY.query("WITH " + RECALLED + "SELECT query_id, id, hits, score FROM recalled")
def graph_recall(spark, sf_dir):
    """Orders tied to the names in a question, through parts, suppliers, nations and regions."""
    return _recalled(spark, sf_dir)


@REGISTRY.query(HITS.rstrip() + ", " + RECALLED + """
, v AS (SELECT query_id, id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM hits) WHERE r <= 20)
SELECT query_id, id, round(CASE WHEN s IS NOT NULL AND score IS NOT NULL THEN s * 1.2 ELSE coalesce(s, score) END, 6)::DOUBLE AS score
FROM v FULL JOIN (SELECT * FROM recalled WHERE query_id IN (SELECT vec_id FROM embeddings)) USING (query_id, id)""")
def graph_merge(spark, sf_dir):
    """Graph hits lift what the search found, or join it at their own score."""
    v = top_per_key(_hits(spark, sf_dir, k=20), ["query_id"], [F.desc("score"), F.asc("id")], 20)
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    return merged(v, _recalled(spark, sf_dir).join(asked, "query_id", "left_semi")).withColumn("score", F.round("score", 6))


def merged(hits, recalled, lift=1.2):
    """``(query_id, id, score)`` of vector hits and graph rows; a row of both is lifted."""
    g = recalled.select("query_id", "id", F.col("score").alias("g"))
    score = F.when(F.col("score").isNotNull() & F.col("g").isNotNull(), F.col("score") * lift).otherwise(F.coalesce("score", "g"))
    return hits.join(g, ["query_id", "id"], "full_outer").select("query_id", "id", score.alias("score"))
