"""Counts, distributions, trends and quality metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.operators import series
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()
TYPES = ["view", "click", "purchase", "signup", "error"]
AS_OF = "2024-01-25"


@REGISTRY.query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM events WHERE ts >= '2024-01-05' AND ts <= '2024-01-20' GROUP BY ALL")
def time_buckets(spark, sf_dir):
    return series.time_buckets(table(spark, sf_dir, "events"), "ts", "day", "2024-01-05", "2024-01-20")


@REGISTRY.query("""
WITH b AS (SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM orders GROUP BY ALL)
SELECT bucket, n, (sum(n) OVER (ORDER BY bucket))::BIGINT AS total FROM b""")
def time_buckets_cumulative(spark, sf_dir):
    return series.running_total(series.time_buckets(table(spark, sf_dir, "orders"), "o_orderdate", "week"), "bucket", "n", "total")


@REGISTRY.query("SELECT count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first FROM events WHERE ts >= TIMESTAMP '2023-12-26' AND ts <= TIMESTAMP '2024-01-25'")
def default_range(spark, sf_dir):
    start, end = series.default_range("day", AS_OF)
    e = table(spark, sf_dir, "events").where(F.col("ts").between(start, end))
    return e.agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first"))


@REGISTRY.query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error, count(*) AS total FROM events GROUP BY 1""")
def type_pivot(spark, sf_dir):
    """Types as columns; the total has every row, of other and null types too."""
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in TYPES], F.count("*").alias("total"))


@REGISTRY.query("""
WITH k AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS layer), c AS (SELECT lang AS layer, count(*) AS n FROM documents GROUP BY lang)
SELECT layer, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM documents), 2) AS pct FROM k LEFT JOIN c USING (layer)""")
def layer_distribution(spark, sf_dir):
    """Every layer has a row, also those without rows."""
    docs = table(spark, sf_dir, "documents")
    layers = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "layer string")
    counts = docs.groupBy(F.col("lang").alias("layer")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return layers.join(counts, "layer", "left").select("layer", n.alias("n"), F.round(100.0 * n / docs.count(), 2).alias("pct"))


@REGISTRY.query("""
SELECT count(*) AS total, count(*) FILTER (ts::DATE = DATE '2024-01-25') AS today, count(*) FILTER (ts::DATE BETWEEN DATE '2024-01-21' AND DATE '2024-01-25') AS this_week, round(avg(value), 6) AS mean FROM events""")
def summary_counts(spark, sf_dir):
    """One pass; the week starts on Sunday here."""
    day, as_of = F.to_date("ts"), F.lit(AS_OF).cast("date")
    sunday = F.date_sub(as_of, F.dayofweek(as_of) - 1)
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("total"),
        F.count_if(day == as_of).alias("today"),
        F.count_if(day.between(sunday, as_of)).alias("this_week"),
        F.round(F.avg("value"), 6).alias("mean"),
    )


@REGISTRY.query("SELECT round(100.0 * count(quality) / nullif(count(*), 0), 2) AS pct FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_pct(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.agg(F.round(100.0 * F.count("quality") / F.nullif(F.count("*"), F.lit(0)), 2).alias("pct"))


@REGISTRY.query("""
WITH g AS (SELECT count(*) AS c FROM documents GROUP BY text HAVING count(*) > 1) SELECT round((SELECT sum(c - 1) FROM g) / count(*), 6) AS ratio FROM documents""")
def duplicate_ratio(spark, sf_dir):
    """Share of rows that repeat a text, by its hash."""
    per = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("c"))
    return per.agg(F.round(F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(0)) / F.sum("c"), 6).alias("ratio"))


@REGISTRY.query("SELECT round(100.0 * count(*) FILTER (ts < TIMESTAMP '2024-01-25' - INTERVAL 14 DAY) / count(*), 2) AS pct FROM events")
def stale_pct(spark, sf_dir):
    old = F.col("ts") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 14 days")
    return table(spark, sf_dir, "events").agg(F.round(100.0 * F.count_if(old) / F.count("*"), 2).alias("pct"))


@REGISTRY.query("SELECT event_type, floor(date_diff('second', max(ts), TIMESTAMP '2024-02-01') / 60)::BIGINT AS minutes FROM events GROUP BY event_type")
def stage_sla(spark, sf_dir):
    """Whole minutes since the last event of each stage."""
    end = F.unix_timestamp(F.lit("2024-02-01").cast("timestamp"))
    last = F.unix_timestamp(F.max("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.floor((end - last) / 60).alias("minutes"))


@REGISTRY.query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5")
def all_models_coverage(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("k")).where("k = 5").select("user_id")


@REGISTRY.query("""
SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS commits, count(DISTINCT l_suppkey) AS authors, strftime(max(l_shipdate), '%Y-%m-%d') AS last_touch FROM lineitem GROUP BY l_partkey""")
def churn(spark, sf_dir):
    """Distinct commits and authors per file, and when it was last touched."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.countDistinct("l_orderkey").alias("commits"), F.countDistinct("l_suppkey").alias("authors"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_touch")
    )


@REGISTRY.query("""
WITH s AS (SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS a, count(DISTINCT l_suppkey) AS b, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
, x AS (SELECT part, round(0.5 * a / max(a) OVER () + 0.3 * b / max(b) OVER () + 0.2 * q / max(q) OVER (), 6) AS score FROM s)
SELECT part, score FROM x WHERE score >= 0.6 ORDER BY score DESC, part LIMIT 50""")
def hotspot_score(spark, sf_dir):
    """Axes over their largest values, weighted; the top 50 from 0.6 on."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.countDistinct("l_orderkey").alias("a"), F.countDistinct("l_suppkey").alias("b"), F.sum("l_quantity").alias("q")
    )
    top = s.agg(F.max("a"), F.max("b"), F.max("q")).first()
    score = F.round(0.5 * F.col("a") / F.lit(top[0]) + 0.3 * F.col("b") / F.lit(top[1]) + 0.2 * F.col("q") / F.lit(top[2]), 6)
    scored = s.select("part", score.alias("score"))
    return scored.where("score >= 0.6").orderBy(F.desc("score"), "part").limit(50)


@REGISTRY.query("""
WITH w AS (SELECT date_trunc('week', ts) AS w, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(w, '%Y-%m-%d') AS week, n, round(100.0 * (n - lag(n) OVER (ORDER BY w)) / lag(n) OVER (ORDER BY w), 2) AS trend FROM w""")
def trend_wow(spark, sf_dir):
    """Change against the week before, in percent."""
    w = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").alias("w")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("w"))
    return w.select(F.date_format("w", "yyyy-MM-dd").alias("week"), "n", F.round(100.0 * (F.col("n") - before) / before, 2).alias("trend"))


@REGISTRY.query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) FILTER (r >= ceil(n * 0.5)) AS p50, min(value) FILTER (r >= ceil(n * 0.95)) AS p95 FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return series.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@REGISTRY.query("""
WITH b AS (SELECT item_id, item_id % 7 AS r, item_id % 3 AS wanted FROM benchmark)
SELECT wanted AS category, count(*) AS queries, round(avg(CASE WHEN r BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 6) AS p_at_5, round(avg(CASE WHEN r > 0 THEN 1.0 / r ELSE 0.0 END), 6) AS mrr FROM b GROUP BY wanted""")
def retrieval_metrics(spark, sf_dir):
    """Mean hit within five and mean reciprocal rank per category; rank 0 is a miss."""
    rank = F.col("item_id") % 7
    return table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 3).alias("category")).agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.when(rank.between(1, 5), 1.0).otherwise(0.0)), 6).alias("p_at_5"),
        F.round(F.avg(F.when(rank > 0, 1.0 / rank).otherwise(0.0)), 6).alias("mrr"),
    )


@REGISTRY.query("""
WITH d AS (SELECT ts::DATE AS d, avg(value) AS v, count(*) AS n FROM events GROUP BY 1)
, x AS (SELECT d, v, n, avg(v) OVER w AS pv, avg(n) OVER w AS pn, count(*) OVER w AS k FROM d WINDOW w AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(k > 0 AND (v < pv - 5 OR n > 1.5 * pn), false) AS regressed FROM x""")
def eval_regression(spark, sf_dir):
    """Runs worse than the mean of the three before."""
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    w = Window.orderBy("d").rowsBetween(-3, -1)
    worse = (F.col("v") < F.avg("v").over(w) - 5) | (F.col("n") > 1.5 * F.avg("n").over(w))
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce(worse, F.lit(False)).alias("regressed"))


@REGISTRY.query("""
WITH s AS (SELECT event_type, round(count(*) FILTER (ts >= '2024-01-20') / (SELECT count(*) FROM events WHERE ts >= '2024-01-20'), 2) AS a,
  round(count(*) FILTER (ts < '2024-01-20') / (SELECT count(*) FROM events WHERE ts < '2024-01-20'), 2) AS b FROM events GROUP BY event_type)
SELECT round(least(1.0, 0.5 * sum(abs(a - b))), 6) AS drift FROM s""")
def distribution_drift(spark, sf_dir):
    """Half the summed differences of shares, recent against before."""
    recent = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(recent).alias("a"), F.count_if(~recent).alias("b"))
    total = per.agg(F.sum("a"), F.sum("b")).first()
    step = F.abs(F.round(F.col("a") / F.lit(total[0]), 2) - F.round(F.col("b") / F.lit(total[1]), 2))
    return per.agg(F.round(F.least(F.lit(1.0), 0.5 * F.sum(step)), 6).alias("drift"))


@REGISTRY.query("""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT source, n, round(n / (SELECT sum(n) FROM c), 6) AS share, n >= 20 AND n > 0.04 * (SELECT sum(n) FROM c) AS recurring FROM c""")
def entity_share(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return c.select("source", "n", F.round(F.col("n") / total, 6).alias("share"), ((F.col("n") >= 20) & (F.col("n") > 0.04 * total)).alias("recurring"))


@REGISTRY.query("""
SELECT 'm' || (a.label % 3) AS model, round(avg(1 - s), 6) AS mean, round(max(1 - s), 6) AS worst, count(*) FILTER (1 - s > 0.9) AS flagged FROM
 (SELECT a.vec_id, a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a GROUP BY 1""")
def embedding_drift(spark, sf_dir):
    """Distance between an old and a new vector of an id, per model."""
    from loam.functions.vectors import cosine_distance

    e = table(spark, sf_dir, "embeddings")
    new = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("new"))
    d = e.join(new, "vec_id").select(F.concat(F.lit("m"), F.col("label") % 3).alias("model"), cosine_distance(F.col("embedding"), F.col("new")).alias("d"))
    return d.groupBy("model").agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("worst"), F.count_if(F.col("d") > 0.9).alias("flagged"))


@REGISTRY.query("""
WITH g AS (SELECT user_id, event_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000 AS gap FROM events)
SELECT user_id, event_id, round(gap, 3) AS gap_s FROM g WHERE gap > 600""")
def gap_markers(spark, sf_dir):
    found = series.gap_markers(table(spark, sf_dir, "events"), ["user_id"], "ts", tie="event_id")
    return found.select("user_id", "event_id", F.round("gap_s", 3).alias("gap_s"))


@REGISTRY.query("""
WITH d AS (SELECT unnest(range(DATE '2023-12-28', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS d), c AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1)
, f AS (SELECT d, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (d))
SELECT strftime(d, '%Y-%m-%d') AS day, n, CASE WHEN n = 0 THEN 'gap' WHEN n < greatest(1, floor(0.5 * (SELECT avg(n) FROM f))) THEN 'sparse' ELSE 'ok' END AS state FROM f""")
def gap_detection(spark, sf_dir):
    return series.daily_gaps(table(spark, sf_dir, "events"), "ts", "2023-12-28", "2024-02-03")


@REGISTRY.query("""
WITH w AS (SELECT user_id, event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m FROM events)
SELECT user_id, event_id, round(m, 6) AS history, CASE WHEN m IS NULL THEN 'first' WHEN value > m * 1.5 THEN 'arrived' WHEN value < m * 0.5 THEN 'departed' ELSE 'same' END AS shift FROM w""")
def topic_history(spark, sf_dir):
    """Each value against the mean of the four before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, -1)
    m = F.avg("value").over(w)
    e = table(spark, sf_dir, "events").withColumn("m", m)
    shift = F.when(F.col("m").isNull(), "first").when(F.col("value") > F.col("m") * 1.5, "arrived").when(F.col("value") < F.col("m") * 0.5, "departed")
    return e.select("user_id", "event_id", F.round("m", 6).alias("history"), shift.otherwise("same").alias("shift"))


@REGISTRY.query("""
WITH s AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
SELECT label, vec_id, before IS NULL OR 1 - list_cosine_similarity(embedding::DOUBLE[], before::DOUBLE[]) > 0.9 AS shifted FROM s""")
def topic_shift(spark, sf_dir):
    """Whether a turn's vector is far from the one before; the first always is."""
    from loam.functions.vectors import cosine_distance

    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    e = table(spark, sf_dir, "embeddings").withColumn("before", before)
    far = cosine_distance(F.col("embedding"), F.col("before")) > 0.9
    return e.select("label", "vec_id", (F.col("before").isNull() | far).alias("shifted"))


@REGISTRY.query("SELECT coalesce(event_type, 'null') AS value, count(*) AS n FROM events GROUP BY 1")
def group_count_any(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.coalesce(F.col("event_type").cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n"))


@REGISTRY.query("SELECT round(avg(value), 6) AS mean, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events")
def scalar_agg(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))


@REGISTRY.query("""
SELECT user_id, count(*) FILTER (event_type = 'signup') AS created, count(*) FILTER (event_type = 'view') AS accessed, count(DISTINCT props) AS unique_accessed, date_diff('second', min(ts), max(ts)) AS duration_s FROM events GROUP BY user_id""")
def session_summary(spark, sf_dir):
    kind, unix = F.col("event_type"), lambda c: F.unix_timestamp(c.cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "signup").alias("created"),
        F.count_if(kind == "view").alias("accessed"),
        F.countDistinct("props").alias("unique_accessed"),
        (unix(F.max("ts")) - unix(F.min("ts"))).alias("duration_s"),
    )


@REGISTRY.query("""
SELECT event_type, count(*) AS runs, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(value), 6) AS mean_cost, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run
FROM events WHERE ts >= TIMESTAMP '2024-01-18' GROUP BY event_type""")
def run_stats(spark, sf_dir):
    """Per pass over seven days."""
    e = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-18").cast("timestamp_ntz"))
    return e.groupBy("event_type").agg(
        F.count("*").alias("runs"),
        F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("success_rate"),
        F.round(F.avg("value"), 6).alias("mean_cost"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_run"),
    )


@REGISTRY.query("""
WITH t AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(DISTINCT user_id) AS u FROM events)
SELECT unnest(['volume', 'reliability', 'breadth']) AS metric, unnest([round(least(100.0, n / 100.0), 2), round(100.0 * (n - e) / n, 2), round(least(100.0, u * 1.0), 2)]) AS value FROM t""")
def health_unpivot(spark, sf_dir):
    """A row per metric from one aggregated row."""
    t = table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.countDistinct("user_id").alias("u"))
    return t.selectExpr(
        "stack(3, 'volume', round(least(100.0D, n / 100.0D), 2), 'reliability', round(100.0D * (n - e) / n, 2), 'breadth', round(least(100.0D, u * 1.0D), 2)) AS (metric, value)"
    )


#: Weights of the six components of the fog index, and its tiers.
FOG_WEIGHTS = {"staleness": 25, "coverage": 20, "duplicates": 15, "consolidation": 20, "decay": 10, "gaps": 10}
FOG_TIERS = [(90, "Crystal"), (75, "Clear"), (60, "Haze"), (40, "Mist"), (20, "Fog"), (0, "Dense Fog")]


@REGISTRY.query("""
WITH u AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), e AS (SELECT max(ts) AS stop, min(ts) AS start, count(DISTINCT ts::DATE) AS days FROM events),
a AS (SELECT 100.0 * count(*) FILTER (last >= stop - INTERVAL 14 DAY) / count(*) AS staleness, 100.0 * count(*) FILTER (last >= stop - INTERVAL 1 DAY) / count(*) AS decay FROM u, e),
d AS (SELECT 100.0 * count(quality) / count(*) AS coverage, 100.0 * count(DISTINCT md5(text)) / count(*) AS duplicates, 100.0 * count(*) FILTER (quality = 1) / count(quality) AS consolidation FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT 100.0 * days / (stop::DATE - start::DATE + 1) AS gaps FROM e),
s AS (SELECT round((25 * staleness + 20 * coverage + 15 * duplicates + 20 * consolidation + 10 * decay + 10 * gaps) / 100, 1)::DOUBLE AS score FROM a, d, g)
SELECT score, CASE WHEN score >= 90 THEN 'Crystal' WHEN score >= 75 THEN 'Clear' WHEN score >= 60 THEN 'Haze' WHEN score >= 40 THEN 'Mist' WHEN score >= 20 THEN 'Fog' ELSE 'Dense Fog' END AS tier FROM s""")
def fog_index(spark, sf_dir):
    """Six weighted components, each one aggregated row of its table, and a tier."""
    events = table(spark, sf_dir, "events")
    stop, start, days = events.agg(F.max("ts"), F.min("ts"), F.countDistinct(F.to_date("ts"))).first()
    within = lambda n: 100 * F.avg(F.when(F.col("last") >= F.lit(stop) - F.expr(f"INTERVAL {n} DAY"), 1.0).otherwise(0.0))
    users = events.groupBy("user_id").agg(F.max("ts").alias("last")).agg(within(14).alias("staleness"), within(1).alias("decay"))
    texts = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy(F.md5("text").alias("h"))
    texts = texts.agg(F.count("*").alias("n"), F.count("quality").alias("known"), F.count_if(F.col("quality") == 1).alias("good"))
    share = lambda a, b: 100 * a / b
    docs = texts.agg(
        share(F.sum("known"), F.sum("n")).alias("coverage"), share(F.count("h"), F.sum("n")).alias("duplicates"), share(F.sum("good"), F.sum("known")).alias("consolidation")
    )
    both = users.unionByName(docs, allowMissingColumns=True)
    parts = both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("gaps", F.lit(100 * days / ((stop.date() - start.date()).days + 1)))
    s = parts.select(F.round(sum(w * F.col(c) for c, w in FOG_WEIGHTS.items()) / 100, 1).alias("score"))
    tier = F.lit(FOG_TIERS[-1][1])
    for least, name in reversed(FOG_TIERS[:-1]):
        tier = F.when(F.col("score") >= least, name).otherwise(tier)
    return s.select("score", tier.alias("tier"))


@REGISTRY.query("""
WITH e AS (SELECT user_id, event_type = 'click' AS used, event_type = 'view' AS wanted FROM events WHERE event_type IN ('click', 'view', 'purchase'))
, c AS (SELECT user_id, count(*) FILTER (used) AS tp, count(*) FILTER (NOT used AND NOT wanted) AS fp, count(*) FILTER (wanted) AS fn FROM e GROUP BY user_id)
SELECT user_id, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c WHERE tp > 0""")
def precision_recall_f1(spark, sf_dir):
    kind = F.col("event_type")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("tp"), F.count_if(kind == "purchase").alias("fp"), F.count_if(kind == "view").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.where("tp > 0").select(
        "user_id", F.round(tp / (tp + fp), 6).alias("precision"), F.round(tp / (tp + fn), 6).alias("recall"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1")
    )
