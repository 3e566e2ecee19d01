"""Searches and self-joins of vectors hold a bounded number of scores and rows at once."""

from __future__ import annotations

import numpy as np

from loam.functions import vectors as v


def table_of(spark, n, d=8, seed=5):
    rows = np.random.default_rng(seed).normal(size=(n, d))
    return spark.createDataFrame([(k, k % 3, x.tolist()) for k, x in enumerate(rows)], "id long, g int, v array<double>")


def found(df):
    return sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_a_search_gives_its_rows_a_few_queries_at_a_time(spark, monkeypatch):
    rows = table_of(spark, 300)
    asked = rows.where("id % 10 = 0")
    kinds = ({}, {"min_score": 0.3}, {"k": 4}, {"k": 4, "group": "g"})
    whole = [found(v.block_search(asked, rows, "id", "v", **kind)) for kind in kinds]
    monkeypatch.setattr(v, "CELLS", 700)
    assert [found(v.block_search(asked, rows, "id", "v", **kind)) for kind in kinds] == whole


def test_the_first_of_equal_scores_are_those_with_the_smaller_ids():
    scores, ids = np.array([[0.5, 1.0], [0.9, 1.0], [0.5, 1.0], [0.5, 0.2]]), np.array([7, 3, 1, 5])
    assert v._first_k(scores, ids, 2).tolist() == [[False, False], [True, True], [True, True], [False, False]]


def test_a_tile_holds_the_rows_of_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(v, "BLOCK_ROWS", 50)
    largest = []
    inner = v._tiled
    monkeypatch.setattr(v, "_tiled", lambda placed, least: largest.append(placed.selectExpr("key", "home", "explode(visits) AS o", "id").selectExpr("key", "least(home, o) AS i", "greatest(home, o) AS j").groupBy("key", "i", "j").count().agg({"count": "max"}).first()[0]) or inner(placed, least))
    rows = table_of(spark, 600)
    pairs = v.cell_join(rows, "id", "v", 0.2).count()
    assert pairs == v.block_join(rows, "id", "v", 0.2).count() > 0
    assert max(largest) <= 2 * 50 * 2  # blocks are dealt by hash, so some are larger
