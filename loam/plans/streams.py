"""Batch twins of the streaming operators; the streams are held against them in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.registry import Registry
from loam.sources.tables import table
from loam.streaming import events, recall

REGISTRY = Registry()


@REGISTRY.query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_sliding(spark, sf_dir):
    return events.windows(table(spark, sf_dir, "events"))


@REGISTRY.query("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session_windows(spark, sf_dir):
    return events.sessions(table(spark, sf_dir, "events"), "6 hours")


@REGISTRY.query("""
WITH n AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events) SELECT user_id, event_id, n FROM n WHERE n > 4""")
def stream_rate_limit(spark, sf_dir):
    return events.rate_limit(table(spark, sf_dir, "events"), 4, 86_400)


@REGISTRY.query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return events.distinct_events(e.unionByName(e)).select("event_id", "user_id")


@REGISTRY.query("""
WITH RECURSIVE m AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, ceil(length(text) / 4)::BIGINT AS tokens FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 <> 0),
t AS (SELECT vec_id AS turn_id, vec_id // 100 % 2 AS session, 400 * (vec_id // 100) * (vec_id // 100) AS sec, embedding::DOUBLE[] AS v,
  row_number() OVER (PARTITION BY vec_id // 100 % 2 ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT turn_id, list({'id': id, 'score': s, 'tokens': tokens} ORDER BY s DESC, id) AS c FROM (SELECT turn_id, id, tokens, list_cosine_similarity(t.v, m.v) AS s FROM t, m) WHERE s >= 0.2 GROUP BY turn_id),
x AS (SELECT t.*, coalesce(c.c, []) AS c FROM t LEFT JOIN c USING (turn_id)),
r AS (
  SELECT session, 0::BIGINT AS n, NULL::BIGINT AS turn_id, NULL::BIGINT AS sec, []::DOUBLE[][] AS recent, []::BIGINT[] AS recalled, NULL::BOOLEAN AS shifted, NULL::DOUBLE AS drift, []::BIGINT[] AS ids, 0::BIGINT AS tokens
  FROM (SELECT DISTINCT session FROM x)
  UNION ALL
  SELECT session, n, turn_id, sec, list_slice(list_concat(recent, [v]), -5, -1), list_concat(recalled, list_transform(kept, lambda e: e.id)), shifted, drift, list_transform(kept, lambda e: e.id),
    coalesce(list_sum(list_transform(kept, lambda e: e.tokens)), 0)::BIGINT
  FROM (SELECT *, list_filter(near, lambda e, i: i = 1 OR list_sum(list_transform(near[1:i], lambda y: y.tokens)) <= 1500) AS kept
    FROM (SELECT *, list_filter(new, lambda e: e.score >= 0.7 * new[1].score)[1:5] AS near
      FROM (SELECT *, CASE WHEN shifted THEN list_filter(c, lambda e: NOT list_contains(recalled, e.id)) ELSE [] END AS new
        FROM (SELECT *, len(recent) = 0 OR 1 - list_cosine_similarity(v, recent[-1]) > 0.4 AS shifted,
            CASE WHEN len(recent) > 0 THEN 1 - list_cosine_similarity(v, list_transform(range(1, 65), lambda i: list_avg(list_transform(recent, lambda w: w[i])))) END AS drift
          FROM (SELECT x.session, x.n, x.turn_id, x.sec, x.v, x.c, CASE WHEN x.sec - r.sec > 3600 THEN [] ELSE r.recent END AS recent, CASE WHEN x.sec - r.sec > 3600 THEN [] ELSE r.recalled END AS recalled
            FROM r JOIN x ON x.session = r.session AND x.n = r.n + 1)))))
)
SELECT session, turn_id, shifted, round(drift, 6) AS drift, array_to_string(ids, ',') AS ids, tokens FROM r WHERE n > 0""")
def contextual_recall(spark, sf_dir):
    """Every 100th vector a turn of one of two sessions: what each turn brings that is near
    and new; a long pause begins a session anew."""
    e, k = table(spark, sf_dir, "embeddings"), F.expr("vec_id div 100")
    rows = e.where("vec_id % 100 <> 0").join(table(spark, sf_dir, "documents"), e["vec_id"] == F.col("doc_id"))
    memories = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.ceil(F.length("text") / 4).alias("tokens"))
    turns = e.where("vec_id % 100 = 0").select((k % 2).alias("session"), F.col("vec_id").alias("turn_id"), F.timestamp_seconds(400 * k * k).alias("ts"), F.col("embedding").alias("vector"))
    found = recall.session_recall(recall.with_candidates(turns, memories, 0.2, recall.wanted_candidates(turns)), least=0.2, tokens=1_500)
    return found.select("session", "turn_id", "shifted", F.round("drift", 6).alias("drift"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "tokens")
