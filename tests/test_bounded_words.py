"""Searches by words hold a bounded number of rows and meetings at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loam.functions import lexical
from loam.operators import rescue


def test_rows_with_terms_are_made_without_their_texts(spark):
    # A batch's texts, once for each of a hundred questions, are more than an array holds.
    docs = spark.range(60).coalesce(1).select("id", F.concat(F.repeat(F.lit("river "), 70_000), F.col("id").cast("string")).alias("text"), (F.col("id") % 7).alias("importance"))
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.array(F.lit("river")).alias("terms"))
    assert rescue.rows_with_terms(docs, asked).count() == 6_000


def test_only_the_first_rows_of_a_question_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(rescue, "PAIRS_AT_ONCE", 50)
    docs = spark.range(200).repartition(3).selectExpr("id", "concat('w', id % 4, ' all') AS text", "id % 7 / 10 AS importance")
    asked = spark.createDataFrame([(1, ["all"]), (2, ["w3", "w1"]), (3, ["none"])], "query_id long, terms array<string>")
    every, some = rescue.rows_with_terms(docs, asked), rescue.rows_with_terms(docs, asked, ["importance", "id"], 5)
    best = lambda df: sorted(map(tuple, rescue.best_rows(df, [F.desc("importance"), F.desc("id")], 5).collect()))
    assert best(some) == best(every) and len(best(some)) == 10
    assert some.count() < every.count() == 300


def test_words_meet_their_askers_in_runs_of_whole_documents(monkeypatch):
    asked = lexical._Asked(["a", "b", "a", "a"], [10, 20, 30, 40])
    doc, word, value = np.array([0, 0, 1, 2, 2, 3]), np.array([0, 1, 0, 0, 1, 2]), np.arange(6.0)
    monkeypatch.setattr(lexical, "MEETINGS_AT_ONCE", 5)
    runs = [list(zip(*(x.tolist() for x in run), strict=True)) for run in asked.meet(doc, word, value, ["a", "b", "c"])]
    assert [{d for d, *_ in run} for run in runs] == [{0}, {1}, {2}]
    assert sorted(x for run in runs for x in run) == sorted([(d, float(v), c) for d, v in ((0, 0), (1, 2), (2, 3)) for c in (10, 30, 40)] + [(0, 1.0, 20), (2, 4.0, 20)])
