"""Importance, decay, tiers, archival and trust."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.operators import lifecycle
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()

#: A record per user: age of its last event, uses, importance.
RECORDS = """
WITH r AS (SELECT user_id AS id, date_diff('day', max(ts)::DATE, DATE '2024-02-10') AS idle, date_diff('day', min(ts)::DATE, DATE '2024-02-10') AS age,
  count(*) FILTER (event_type = 'click') AS used, avg(value) / 100 AS base FROM events GROUP BY user_id)
"""
SIGNALS = """
WITH s AS (SELECT user_id, date_diff('day', ts::DATE, DATE '2024-02-01') AS age, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -1.5 WHEN 'signup' THEN -0.5 END AS w, ts FROM events WHERE event_type IN ('purchase', 'error', 'signup'))
"""


def _records(spark, sf_dir):
    as_of = F.lit("2024-02-10").cast("date")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.datediff(as_of, F.max("ts").cast("date")).alias("idle"),
        F.datediff(as_of, F.min("ts").cast("date")).alias("age"),
        F.count_if(F.col("event_type") == "click").alias("used"),
        (F.avg("value") / 100).alias("base"),
    )


def _signals(spark, sf_dir):
    w = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.5).when(F.col("event_type") == "signup", -0.5)
    e = table(spark, sf_dir, "events").withColumn("w", w).where("w IS NOT NULL")
    return e.select("user_id", "ts", "w", F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date")).alias("age"))


@REGISTRY.query("""
SELECT doc_id, round(least(1.0, (50 + (doc_id % 4) * 25 + CASE WHEN doc_id % 5 = 0 THEN 50 ELSE 0 END + 10 * (doc_id % 3) + 5 * (doc_id % 2)) * CASE WHEN doc_id % 10 = 0 THEN 1.2 ELSE 1.0 END
 * CASE lang WHEN 'en' THEN 2.0 WHEN 'de' THEN 1.5 ELSE 1.0 END / 300)::DOUBLE, 2) AS importance FROM documents""")
def importance_initial(spark, sf_dir):
    i = F.col("doc_id")
    layer = F.when(F.col("lang") == "en", 2.0).when(F.col("lang") == "de", 1.5).otherwise(1.0)
    return table(spark, sf_dir, "documents").select("doc_id", lifecycle.initial_importance(i % 4 * 25, i % 5 == 0, i % 3, i % 2, i % 10 == 0, layer).alias("importance"))


@REGISTRY.query(RECORDS + "SELECT id, round(base * pow(0.5, idle / 30.0), 6) AS decayed FROM r")
def decay_layer(spark, sf_dir):
    return _records(spark, sf_dir).select("id", F.round(F.col("base") * lifecycle.half_life(F.col("idle"), 30.0), 6).alias("decayed"))


@REGISTRY.query(RECORDS + """
, s AS (SELECT id, base * pow(0.5, idle / 30.0) * (1 + 0.15 * log2(1 + used)) * (0.5 + 0.5 * 0.8) + CASE WHEN id % 20 = 0 THEN 0.2 ELSE 0.0 END AS s FROM r)
SELECT id, round(least(1.0, CASE WHEN id % 9 = 0 THEN greatest(s, 0.6) ELSE s END), 6) AS score FROM s""")
def effective_score(spark, sf_dir):
    s = lifecycle.effective_score(F.col("base"), F.col("idle"), F.col("used"), F.lit(0.8), F.col("id") % 20 == 0, F.col("id") % 9 == 0)
    return _records(spark, sf_dir).select("id", F.round(s, 6).alias("score"))


@REGISTRY.query(RECORDS + """
, s AS (SELECT id, base, greatest(0.35, base * pow(0.5, idle / 60.0) * (1 + 0.05 * log10(1 + used))) AS n FROM r)
SELECT id, round(CASE WHEN abs(n - base) < 0.001 THEN base ELSE n END, 6) AS importance FROM s""")
def rescore(spark, sf_dir):
    """A new version; changes under 0.001 are ignored."""
    new = F.greatest(F.lit(0.35), F.col("base") * lifecycle.half_life(F.col("idle"), 60.0) * (1 + 0.05 * F.log10(1 + F.col("used"))))
    r = _records(spark, sf_dir).withColumn("n", new)
    return r.select("id", F.round(F.when(F.abs(F.col("n") - F.col("base")) < 0.001, F.col("base")).otherwise(F.col("n")), 6).alias("importance"))


@REGISTRY.query(RECORDS + "SELECT CASE WHEN base >= 0.6 AND idle <= 7 THEN 'HOT' WHEN base >= 0.3 AND idle <= 30 THEN 'WARM' ELSE 'COLD' END AS tier, count(*) AS n FROM r GROUP BY 1")
def tiering(spark, sf_dir):
    return _records(spark, sf_dir).groupBy(lifecycle.tier(F.col("base"), F.col("idle")).alias("tier")).agg(F.count("*").alias("n"))


@REGISTRY.query(RECORDS + """
SELECT CASE WHEN base >= 0.5 THEN 'important' WHEN id % 7 = 0 THEN 'protected' WHEN idle < 11 THEN 'recent' WHEN used > 20 THEN 'used' ELSE 'archived' END AS reason, count(*) AS n FROM r GROUP BY 1""")
def archival(spark, sf_dir):
    """The first reason that keeps a record, else it is archived."""
    reason = F.when(F.col("base") >= 0.5, "important").when(F.col("id") % 7 == 0, "protected").when(F.col("idle") < 11, "recent").when(F.col("used") > 20, "used")
    return _records(spark, sf_dir).groupBy(reason.otherwise("archived").alias("reason")).agg(F.count("*").alias("n"))


@REGISTRY.query(SIGNALS + "SELECT user_id, round(least(1.0, greatest(0.0, (sum(w * pow(0.5, age / 30.0)) / sum(abs(w) * pow(0.5, age / 30.0)) + 1) / 2)), 6) AS trust FROM s GROUP BY user_id")
def trust_score(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy("user_id").agg(F.round(lifecycle.trust(F.col("w"), F.col("age")), 6).alias("trust"))


@REGISTRY.query(SIGNALS + """
, r AS (SELECT user_id, w, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM s)
, h AS (SELECT user_id, n, avg(CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END) FILTER (r <= floor(n / 2)) AS a, avg(CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END) FILTER (r > floor(n / 2)) AS b FROM r GROUP BY user_id, n)
SELECT user_id, CASE WHEN n < 4 THEN 'stable' WHEN b - a > 0.1 THEN 'improving' WHEN a - b > 0.1 THEN 'declining' ELSE 'stable' END AS trend FROM h""")
def domain_trust_trend(spark, sf_dir):
    """Success of the later half against the earlier."""
    w = Window.partitionBy("user_id")
    s = _signals(spark, sf_dir).withColumn("r", F.row_number().over(w.orderBy("ts"))).withColumn("n", F.count("*").over(w))
    early, good = F.col("r") <= F.floor(F.col("n") / 2), F.when(F.col("w") > 0, 1.0).otherwise(0.0)
    h = s.groupBy("user_id", "n").agg(F.avg(F.when(early, good)).alias("a"), F.avg(F.when(~early, good)).alias("b"))
    trend = F.when(F.col("n") < 4, "stable").when(F.col("b") - F.col("a") > 0.1, "improving").when(F.col("a") - F.col("b") > 0.1, "declining")
    return h.select("user_id", trend.otherwise("stable").alias("trend"))


@REGISTRY.query(SIGNALS + """
, d AS (SELECT ts::DATE AS d, sum(w) AS w, sum(abs(w)) AS a FROM s GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, round((sum(w) OVER (ORDER BY d) / sum(a) OVER (ORDER BY d) + 1) / 2, 6)::DOUBLE AS trust FROM d""")
def trust_history(spark, sf_dir):
    """Trust of all signals up to each day, from daily sums."""
    d = _signals(spark, sf_dir).groupBy(F.to_date("ts").alias("d")).agg(F.sum("w").alias("w"), F.sum(F.abs("w")).alias("a"))
    upto = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.round((F.sum("w").over(upto) / F.sum("a").over(upto) + 1) / 2, 6).alias("trust"))


@REGISTRY.query("""
WITH c AS (SELECT user_id, event_type, count(*) FILTER (ts < '2024-01-15') AS before, count(*) AS now FROM events GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN before < 12 THEN 'gained' ELSE 'improved' END AS change FROM c WHERE now >= 12 AND (before < 12 OR now > before + 8)""")
def capability_delta(spark, sf_dir):
    """Capabilities that one checkpoint has and the one before lacks or has less of."""
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(early).alias("before"), F.count("*").alias("now"))
    c = c.where("now >= 12 AND (before < 12 OR now > before + 8)")
    return c.select("user_id", "event_type", F.when(F.col("before") < 12, "gained").otherwise("improved").alias("change"))


@REGISTRY.query("""
WITH e AS (SELECT user_id, props, value FROM events WHERE event_type = 'error')
SELECT 'agent' AS kind, user_id::VARCHAR AS key, count(*) AS n FROM e GROUP BY user_id HAVING count(*) >= 15
UNION ALL SELECT 'timeout', user_id::VARCHAR, count(*) FROM e WHERE value > 90 GROUP BY user_id HAVING count(*) >= 2
UNION ALL SELECT 'cascade', props, count(*) FROM e GROUP BY props HAVING count(*) >= 3 AND count(DISTINCT user_id) >= 2""")
def failure_patterns(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    n = F.count("*").alias("n")
    agent = e.groupBy(F.lit("agent").alias("kind"), F.col("user_id").cast("string").alias("key")).agg(n).where("n >= 15")
    slow = e.where("value > 90").groupBy(F.lit("timeout").alias("kind"), F.col("user_id").cast("string").alias("key")).agg(n).where("n >= 2")
    wide = e.groupBy(F.lit("cascade").alias("kind"), F.col("props").alias("key")).agg(n, F.countDistinct("user_id").alias("u")).where("n >= 3 AND u >= 2").drop("u")
    return agent.unionByName(slow).unionByName(wide)


@REGISTRY.query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM events GROUP BY 1, 2")
def daily_usage(spark, sf_dir):
    """Usage counters per account and day."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("used"))


@REGISTRY.query("""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1, 2""")
def day_buckets(spark, sf_dir):
    """Day buckets per agent since the last cycle, seven days back at most."""
    end = F.lit("2024-01-30").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").where((F.col("ts") >= end - F.expr("interval 7 days")) & (F.col("ts") < end))
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
