"""Edges of a traversal are dealt into tasks by their number."""

from __future__ import annotations

from loam.operators import graph


def test_more_edges_are_dealt_into_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_A_TASK", 100, raising=False)
    plans, inner = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or inner(df))
    edges = spark.range(3_000).selectExpr("id AS src", "id + 1 AS dst")
    found = graph.traverse(edges.unionByName(edges), spark.createDataFrame([(0,), (2_999,)], "node long"), 2, directed=False)
    assert {(r["seed"], r["node"], r["depth"]) for r in found.collect()} == {(0, 0, 0), (0, 1, 1), (0, 2, 2), (2_999, 2_999, 0), (2_999, 2_998, 1), (2_999, 3_000, 1), (2_999, 2_997, 2)}
    assert any("hashpartitioning(src" in p and ", 120), REPARTITION_BY_NUM" in p for p in plans)
