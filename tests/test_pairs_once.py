"""Pairs that are dear to make are made once, however often an operator reads them."""

from __future__ import annotations

import pytest

from loam.operators import communities, graph


@pytest.fixture
def counted(spark):
    met = spark.sparkContext.accumulator(0)

    def made(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    return met, lambda rows, schema: spark.createDataFrame(rows, schema).mapInArrow(made, schema)


def test_dbscan_makes_its_pairs_once(spark, counted):
    met, table = counted
    pairs = table([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (4, 5), (6, 7)], "src long, dst long")
    found = {r["node"]: (r["role"], r["cluster"]) for r in graph.dbscan(pairs, spark.range(1, 9).withColumnRenamed("id", "node")).collect()}
    assert found == {1: ("core", 1), 2: ("core", 1), 3: ("core", 1), 4: ("core", 1), 5: ("border", 1)} | {k: ("noise", None) for k in (6, 7, 8)}
    assert met.value == 8


def test_louvain_makes_its_pairs_once(spark, counted, monkeypatch):
    met, table = counted
    monkeypatch.setattr(communities, "MOST_LEVELS", 1)
    monkeypatch.setattr(communities, "MOST_ROUNDS", 1)
    pairs = table([(1, 2, 1.0), (4, 5, 1.0)], "a long, b long, w double")
    assert {r["node"]: r["community"] for r in communities.louvain(pairs).collect()} == {1: 1, 2: 1, 4: 4, 5: 4}
    assert met.value == 2


def test_louvain_leaves_only_what_its_result_reads(spark):
    kept, inner = [], communities.checkpointed
    ring = [(a, a + 1, 1.0) for k in range(8) for a in range(10 * k, 10 * k + 3)] + [(10 * k, 10 * k + 3, 1.0) for k in range(8)] + [(10 * k, 10 * k + 10, 1.0) for k in range(7)]
    pairs = spark.createDataFrame(ring, "a long, b long, w double")
    communities.checkpointed = lambda df: kept.append(inner(df)) or kept[-1]
    try:
        assert communities.louvain(pairs).count() == 32
    finally:
        communities.checkpointed = inner
    folder = spark._jvm.org.apache.hadoop.fs.Path(kept[0].kept_at)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert len(kept) > 5 and sum(system.exists(spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)) for df in kept) == 1


def test_weights_of_soft_pairs_count_once(spark):
    edges, soft = (spark.createDataFrame(rows, "src long, dst long") for rows in ([(1, 2), (2, 1), (3, 3)], [(2, 1), (1, 2), (4, 5)]))
    assert {tuple(r) for r in communities.weighted_pairs(edges, soft, 0.5).collect()} == {(1, 2, 2.5), (4, 5, 0.5)}
