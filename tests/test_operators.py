from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from loam.functions import vectors
from loam.operators import dedup, filters, graph, lifecycle, series, texts
from loam.plans.search import dedup_action
from loam.streaming import events


def column(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_vectors_of_all_kinds(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])]
    found = column(spark, rows, "a array<double>, b array<double>", vectors.cosine_similarity(F.col("a"), F.col("b")))
    assert found == [1.0, -1.0, 0.0, None]
    valid = column(spark, [([1.0],), ([],), (None,), ([math.nan],), ([math.inf],)], "a array<double>", vectors.valid_vector(F.col("a")))
    assert valid == [True, False, False, False, False]


def test_block_search_refuses_unbounded_query_sets(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    found = vectors.block_search(rows, rows, "id", "v", k=2).orderBy("query_id", F.desc("score"), "id").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(1, 1), (1, 3), (2, 2), (2, 1), (3, 1), (3, 3)]
    assert vectors.block_search(rows.limit(0), rows, "id", "v").count() == 0
    monkeypatch.setattr(vectors, "QUERY_BYTES", 8)
    with pytest.raises(ValueError, match="in parts"):
        vectors.block_search(rows, rows, "id", "v")


def test_dedup_thresholds(spark):
    scores = [(0.93,), (0.929,), (0.85,), (0.849,), (0.78,), (0.779,)]
    assert column(spark, scores, "s double", dedup_action(F.col("s"))) == ["merged", "reinforced", "reinforced", "review", "review", "create"]


def test_gap_markers_are_strict_and_per_key(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:01"), (1, "2024-01-01 00:20:01"), (2, "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "k int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r["gap_s"] for r in series.gap_markers(df, ["k"], "ts").collect()] == [601.0]


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)], "k string, x double")
    assert series.nearest_rank(df, ["k"], "x", {"p": 0.5}).first()["p"] == 5.0
    assert series.nearest_rank(df, ["k"], "x", {"p": 0.5}, floor_index=True).first()["p"] == 6.0


@pytest.mark.parametrize(
    ("edges", "wanted"),
    [
        ([(k, k + 1) for k in range(60)], {k: 0 for k in range(61)}),
        ([(1, 2), (2, 3), (3, 1), (7, 7), (8, 9)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}),
        ([], {}),
    ],
)
def test_components(spark, edges, wanted):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == wanted


def test_shortest_paths_in_a_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 6)], "src long, dst long")
    found = graph.shortest_paths(edges, spark.createDataFrame([(1,)], "node long"), 3)
    assert {r["node"]: r["path"] for r in found.collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 2, 4], 5: [1, 2, 4, 5]}


def test_filters(spark):
    rows = [(1, "a_b", ["x", "y"], True), (2, "aXb", ["x"], None), (3, None, [], False)]
    df = spark.createDataFrame(rows, "id int, t string, tags array<string>, searchable boolean")
    ids = lambda f: [r["id"] for r in df.where(f).collect()]
    none = F.lit(None).cast("int")
    assert ids(filters.build({"t__ilike": "a_b"})) == [1]
    assert ids(filters.build({"tags__all_of": ["x", "y"]})) == [1]
    assert ids(filters.build({"id": [1, 3], "t__null": False})) == [1]
    assert ids(filters.live(none, none, none, F.col("searchable"))) == [1, 2]
    paths = [("src/a.py",), ("src/x/a.py",), ("src/a.txt",)]
    assert column(spark, paths, "p string", filters.glob(F.col("p"), ["src/*.py"])) == [True, False, False]
    assert column(spark, paths, "p string", filters.glob(F.col("p"), ["src/**"], ["**.txt"])) == [True, True, False]


def test_numbers_of_reports(spark):
    rows = [("$1,347.42",), ("--",), (None,)]
    assert column(spark, rows, "x string", texts.parse_currency(F.col("x"))) == [1347.42, None, None]
    assert column(spark, [("35.06%",), ("0",), ("< 10%",)], "x string", texts.parse_percent(F.col("x"))) == [pytest.approx(0.3506), None, None]


def test_trust_without_signals_is_even(spark):
    df = spark.createDataFrame([], "w double, age int")
    assert df.agg(lifecycle.trust(F.col("w"), F.col("age"))).first()[0] == 0.5


def test_content_hash_ignores_case_and_outer_space(spark):
    a, b = column(spark, [("\t Ab c\n",), ("ab C",)], "x string", dedup.content_hash(F.col("x")))
    assert a == b


def test_segments_cover_the_text_in_order(spark):
    df = spark.createDataFrame([(1, "One. " + "A much longer sentence follows here. " * 3 + "End."), (2, None), (3, "")], "id long, t string")
    found = texts.segments(df, "id", "t").orderBy("position").collect()
    assert {r["id"] for r in found} == {1}
    assert " ".join(r["segment"] for r in found) == df.first()["t"]


def test_budget_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate([50, 60, 30, 25])], "k int, o int, n int")
    assert [r["n"] for r in texts.fitting_rows(df, "k", ["o"], "n", 100).orderBy("o").collect()] == [50, 30]


def rows(df):
    return sorted(map(str, df.collect()))


def test_streams_give_the_rows_of_their_batch_twins(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    drained = lambda df, name, mode="append": events.drain(df, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", mode)
    once = drained(events.distinct_events(events.event_stream(spark, sf_dir)), "once")
    assert once.count() == batch.count()
    marks = drained(events.gap_markers(events.event_stream(spark, sf_dir)), "marks")
    wanted = series.gap_markers(batch, ["user_id"], "ts", tie="event_id").select("user_id", "event_id", F.round("gap_s", 3).alias("gap_s"))
    assert rows(marks.select("user_id", "event_id", F.round("gap_s", 3).alias("gap_s"))) == rows(wanted)
    # Windows still open at the last watermark are not final and so not appended.
    days = {(r["start"], r["event_type"]): r["n"] for r in events.windows(batch).collect()}
    streamed = {(r["start"], r["event_type"]): r["n"] for r in drained(events.windows(events.event_stream(spark, sf_dir)), "days").collect()}
    assert streamed and streamed.items() <= days.items()
    stream = lambda: events.event_stream(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for name, make in (("sliding", lambda d: events.windows(d, "1 day", "6 hours")), ("sessions", lambda d: events.sessions(d, "6 hours"))):
        twin = {tuple(r) for r in make(e).collect()}
        streamed = {tuple(r) for r in drained(make(stream()), name).collect()}
        assert streamed and streamed <= twin
    limited = {tuple(r) for r in drained(events.rate_limit(stream(), 4, 86_400), "rate").collect()}
    assert limited and limited == {tuple(r) for r in events.rate_limit(e, 4, 86_400).collect()}


def test_similar_pairs_of_more_rows_than_a_query_set(spark, monkeypatch):
    import numpy as np

    from loam.functions import vectors
    from loam.plans.search import similar_pairs

    monkeypatch.setattr(vectors, "QUERY_BYTES", 1_000)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    v = np.random.default_rng(3).normal(size=(60, 4))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] >= 0.8}
    found = [(r["id1"], r["id2"]) for r in similar_pairs(rows, 0.8).collect()]
    assert len(found) == len(near) and set(found) == near


def test_near_dup_pairs_reach_rows_older_than_the_newest_5000(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from loam.plans.search import near_dup_pairs

    v = np.random.default_rng(4).normal(size=(5_003, 64))
    v[1] = v[0]
    pq.write_table(pa.table({"vec_id": np.arange(5_003), "embedding": v.tolist()}), tmp_path / "embeddings.parquet")
    assert near_dup_pairs(spark, str(tmp_path)).where("id1 = 0 and id2 = 1").count() == 1
    assert near_dup_pairs(spark, str(tmp_path), newest=5_000).where("id1 < 3").count() == 0
