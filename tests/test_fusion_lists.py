"""Fusion of unions of lists."""

from __future__ import annotations

from loam.operators.fusion import fuse_minmax


def test_minmax_searches_once(spark):
    lists = spark.createDataFrame([(1, "a", 1, 0.2), (1, "a", 2, 0.6), (1, "a", 3, 0.4), (1, "b", 3, 0.3)], "query_id long, source string, id long, score double")
    fused = fuse_minmax(lists)
    assert {(r["id"], round(r["fused"], 9)) for r in fused.collect()} == {(1, 0.0), (2, 1.0), (3, 1.0)}
    assert "Join" not in fused._jdf.queryExecution().optimizedPlan().toString()
