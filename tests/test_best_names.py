"""Of the names that are compared only the best leave a task, and equal scores are those of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.vectors import block_search
from loam.operators import names


def test_pairs_of_similar_names_are_not_written(spark, monkeypatch):
    left = []
    inner = names.top_per_key
    monkeypatch.setattr(names, "top_per_key", lambda df, *rest: left.append(df.count()) or inner(df, *rest))
    monkeypatch.setattr(names, "GRAMS_AT_ONCE", 900)
    monkeypatch.setattr(names, "MEETINGS_AT_ONCE", 500)
    entities = spark.range(300).select((300 - F.col("id")).alias("entity"), F.concat(F.lit("large blue ring "), F.col("id") % 150).alias("name"))
    asked = spark.range(40).select(F.col("id").alias("ask"), F.concat(F.lit("arge blue ring "), F.col("id")).alias("name"))
    found = {r["ask"]: r["entity"] for r in names.best_by_grams(asked, entities).collect()}
    assert found == {k: 150 - k for k in range(40)}
    assert left[0] <= 40 * 4  # not 40 * 300


def test_scores_that_are_equal_once_rounded_go_to_the_smallest_id(spark):
    rows = spark.createDataFrame([(100 - k, [1.0, 1e-5 * k]) for k in range(1, 16)], "id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in block_search(asked, rows, "id", "v", 0.75, k=1, places=6).collect()] == [(1, 85, 1.0)]
    stones = spark.createDataFrame([(100 - k, "stone" + "s" * k) for k in range(1, 16)], "entity long, name string")
    vector = lambda name: F.array(F.lit(1.0), F.when(name == "rock", 0.0).otherwise(1e-5 * (F.length(name) - 5)))
    found = names.resolve_names(spark.createDataFrame([(7, "rock"), (8, "rock")], "ask long, name string"), stones, spark.createDataFrame([], "entity long, alias string"), vector)
    assert {tuple(r) for r in found.collect()} == {(7, 85, "vector", 1.0), (8, 85, "vector", 1.0)}
