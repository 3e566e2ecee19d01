"""Agents, teams, feedback and review queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions.vectors import top_per_key
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()


@REGISTRY.query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, round(least(1.0, avg(value) / 100), 2) AS score FROM events GROUP BY 1, 2)
SELECT event_type AS capability, round(avg(score), 6) AS mean, count(DISTINCT user_id) AS contributors FROM c WHERE n >= 2 GROUP BY event_type""")
def team_capabilities(spark, sf_dir):
    """Mean capped score per capability, of those who showed it twice."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.least(F.lit(1.0), F.avg("value") / 100), 2).alias("score"))
    return c.where("n >= 2").groupBy(F.col("event_type").alias("capability")).agg(F.round(F.avg("score"), 6).alias("mean"), F.countDistinct("user_id").alias("contributors"))


@REGISTRY.query("""
WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT a.l_suppkey AS agent, b.l_suppkey AS partner, count(*) AS tasks FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2""")
def pair_collaboration(spark, sf_dir):
    """Tasks that two agents share; a task has a handful of agents."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = p.select("l_orderkey", F.col("l_suppkey").alias("agent")), p.select("l_orderkey", F.col("l_suppkey").alias("partner"))
    return a.join(b, "l_orderkey").where("agent < partner").groupBy("agent", "partner").agg(F.count("*").alias("tasks"))


@REGISTRY.query("SELECT l_suppkey AS agent, count(DISTINCT l_orderkey) AS tasks, round(avg(l_quantity), 2) AS mean FROM lineitem GROUP BY 1")
def partner_stats(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("agent")).agg(F.countDistinct("l_orderkey").alias("tasks"), F.round(F.avg("l_quantity"), 2).alias("mean"))


@REGISTRY.query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS wins, count(*) FILTER (event_type = 'error') AS failures, round(avg(value), 6) AS mean FROM events GROUP BY user_id)
SELECT user_id, wins, failures, mean FROM c ORDER BY wins - failures DESC, user_id LIMIT 5""")
def agent_recommendation(spark, sf_dir):
    """The five agents with most successes over failures."""
    kind = F.col("event_type")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "purchase").alias("wins"), F.count_if(kind == "error").alias("failures"), F.round(F.avg("value"), 6).alias("mean")
    )
    return c.orderBy(F.desc(F.col("wins") - F.col("failures")), "user_id").limit(5)


@REGISTRY.query("""
WITH m AS (SELECT doc_id AS id, 1 AS priority, 'mention' AS via FROM documents WHERE text ILIKE '%idiot%' UNION ALL SELECT doc_id, 2, 'semantic' FROM documents WHERE n_chars > 4000)
, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority) AS r FROM m) SELECT id, via FROM r WHERE r = 1 AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def attach_priority(spark, sf_dir):
    """Mentions before semantic matches, without what is attached already."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    mention = d.where(F.col("text").ilike("%idiot%")).select("id", F.lit(1).alias("priority"), F.lit("mention").alias("via"))
    semantic = d.where("n_chars > 4000").select("id", F.lit(2).alias("priority"), F.lit("semantic").alias("via"))
    known = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return top_per_key(mention.unionByName(semantic), ["id"], [F.asc("priority")], 1).join(known, "id", "left_anti").select("id", "via")


@REGISTRY.query("""
WITH f AS (SELECT event_type, round(avg(value) / 1000 - 0.05, 6) AS adj FROM events GROUP BY event_type)
SELECT user_id, e.event_type, round(greatest(0.0, least(1.0, avg(value) / 100 + any_value(adj) * CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0.5 END)), 6)::DOUBLE AS confidence FROM events e JOIN f USING (event_type) GROUP BY user_id, e.event_type""")
def feedback_adjust(spark, sf_dir):
    """Feedback moves an insight's confidence, and those of its type by half."""
    e = table(spark, sf_dir, "events")
    f = e.groupBy("event_type").agg(F.round(F.avg("value") / 1000 - 0.05, 6).alias("adj"))
    c = e.groupBy("user_id", "event_type").agg((F.avg("value") / 100).alias("c")).join(f, "event_type")
    moved = F.col("c") + F.col("adj") * F.when(F.col("user_id") % 5 == 0, 1.0).otherwise(0.5)
    return c.select("user_id", "event_type", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 6).alias("confidence"))


@REGISTRY.query("""
WITH s AS (SELECT event_type, count(*) AS n, round(avg(value) / 100, 6) AS w FROM events GROUP BY 1), d(event_type, base) AS (VALUES ('view', 0.1), ('click', 0.2), ('purchase', 0.9), ('share', 0.4))
SELECT event_type, CASE WHEN n >= 100 THEN w ELSE base::DOUBLE END AS weight FROM d LEFT JOIN s USING (event_type)""")
def learned_weights(spark, sf_dir):
    """Learned weights where there are samples enough, else the defaults."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value") / 100, 6).alias("w"))
    d = spark.createDataFrame([("view", 0.1), ("click", 0.2), ("purchase", 0.9), ("share", 0.4)], "event_type string, base double")
    return d.join(s, "event_type", "left").select("event_type", F.when(F.col("n") >= 100, F.col("w")).otherwise(F.col("base")).alias("weight"))


@REGISTRY.query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'O' AND (o_orderkey % 3 <> 0 OR o_orderdate < TIMESTAMP '1999-01-01')) AS due FROM orders WHERE o_totalprice >= 1000""")
def review_queue(spark, sf_dir):
    """All, pending, and those not put off or put off until a time that has passed."""
    pending = F.col("o_orderstatus") == "O"
    due = pending & ((F.col("o_orderkey") % 3 != 0) | (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    return table(spark, sf_dir, "orders").where("o_totalprice >= 1000").agg(F.count("*").alias("total"), F.count_if(pending).alias("pending"), F.count_if(due).alias("due"))


@REGISTRY.query("""
WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, n, coalesce(n - lag(n) OVER (ORDER BY h), 0) AS delta, n > 5 AS alert FROM h""")
def monitoring_delta(spark, sf_dir):
    """Failures per hour, the change since the last, and whether that is too many."""
    h = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count_if(F.col("event_type") == "error").alias("n"))
    delta = F.coalesce(F.col("n") - F.lag("n").over(Window.orderBy("h")), F.lit(0))
    return h.select(F.date_format("h", "yyyy-MM-dd HH").alias("hour"), "n", delta.alias("delta"), (F.col("n") > 5).alias("alert"))


@REGISTRY.query("""
WITH w AS (SELECT user_id, event_type, 1 + 1 * (1 - exp(-count(*) / 15.0 * ln(2))) AS w FROM events GROUP BY 1, 2) SELECT user_id, round(max(w), 6) AS weight FROM w GROUP BY user_id""")
def experience_weight(spark, sf_dir):
    """The largest of a user's topic weights: 1 + 1 - 2^(-n / 15)."""
    w = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((2 - F.exp(-F.count("*") / 15.0 * F.log(F.lit(2.0)))).alias("w"))
    return w.groupBy("user_id").agg(F.round(F.max("w"), 6).alias("weight"))


@REGISTRY.query("""
SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, max_by(value, (ts, event_id)) AS latest,
  CASE WHEN max_by(value, (ts, event_id)) > avg(value) * 1.05 THEN 'up' WHEN max_by(value, (ts, event_id)) < avg(value) * 0.95 THEN 'down' ELSE 'flat' END AS trend FROM events GROUP BY user_id""")
def work_style(spark, sf_dir):
    latest, mean = F.max_by("value", F.struct("ts", "event_id")), F.avg("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.round(mean, 6).alias("mean"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        latest.alias("latest"),
        F.when(latest > mean * 1.05, "up").when(latest < mean * 0.95, "down").otherwise("flat").alias("trend"),
    )


@REGISTRY.query("SELECT source AS user, sum(n_chars)::BIGINT AS chars, count(*) AS docs FROM documents GROUP BY source")
def counter_fan_in(spark, sf_dir):
    """Stage counters of all users, summed."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("user")).agg(F.sum("n_chars").alias("chars"), F.count("*").alias("docs"))


@REGISTRY.query("""
SELECT o.o_orderkey AS log, count(l.l_linenumber) AS signals, list(l.l_linenumber ORDER BY l.l_linenumber) FILTER (l.l_linenumber IS NOT NULL) AS ranks
FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def log_signals_nested(spark, sf_dir):
    """The latest hundred logs with their signals nested."""
    logs = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select(F.col("o_orderkey").alias("l_orderkey"))
    found = logs.join(table(spark, sf_dir, "lineitem"), "l_orderkey", "left").groupBy(F.col("l_orderkey").alias("log"))
    ranks = F.sort_array(F.collect_list("l_linenumber"))
    return found.agg(F.count("l_linenumber").alias("signals"), F.when(F.count("l_linenumber") > 0, ranks).alias("ranks"))


@REGISTRY.query(r"""
WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^https?://([^?#]+)', 1), '/') AS parts FROM pages),
nodes AS (SELECT DISTINCT array_to_string(parts[1:2], '/') AS node FROM p WHERE page_id % 2 = 0 UNION SELECT DISTINCT parts[1] FROM p WHERE page_id % 3 = 0),
up AS (SELECT page_id, k, array_to_string(parts[1:k], '/') AS node FROM (SELECT page_id, parts, unnest(range(1, len(parts))) AS k FROM p))
SELECT page_id, arg_max(node, k) AS parent, max(k)::BIGINT AS depth FROM up JOIN nodes USING (node) GROUP BY page_id""")
def nearest_ancestor(spark, sf_dir):
    """Each page under the longest prefix of its path that is a node."""
    path = F.split(F.regexp_extract("url", "^https?://([^?#]+)", 1), "/", -1)
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("parts"))
    joined = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    nodes = p.where("page_id % 2 = 0").select(joined(F.lit(2)).alias("node")).unionByName(p.where("page_id % 3 = 0").select(joined(F.lit(1)).alias("node"))).distinct()
    up = p.where("size(parts) > 1").select("page_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    found = up.select("page_id", "k", joined(F.col("k")).alias("node")).join(nodes, "node")
    return found.groupBy("page_id").agg(F.max_by("node", "k").alias("parent"), F.max("k").cast("long").alias("depth"))
