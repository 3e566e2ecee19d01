"""A turn brings as many candidates as can matter since its session's last pause."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loam.streaming import recall


def test_fewer_candidates_recall_the_same_rows(spark):
    rnd = np.random.default_rng(8)
    memories = spark.createDataFrame([(k, rnd.normal(size=6).tolist(), 10) for k in range(400)], "id long, vector array<double>, tokens long")
    seconds = np.cumsum([0, 10, 10, 9_000, 10, 10, 10, 3_600, 3_601])
    turns = spark.createDataFrame([(k % 2, k, int(s), rnd.normal(size=6).tolist()) for k, s in enumerate(seconds)], "session long, turn_id long, s long, vector array<double>")
    turns = turns.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    every, some = recall.with_candidates(turns, memories, 0.2), recall.with_candidates(turns, memories, 0.2, recall.wanted_candidates(turns))
    rows = lambda df: sorted(map(str, recall.session_recall(df, least=0.2).collect()))
    assert rows(every) == rows(some)
    sizes = {r["turn_id"]: r["n"] for r in some.select("turn_id", F.size("candidates").alias("n")).collect()}
    assert max(sizes.values()) <= 5 * 5 and min(sizes.values()) == 5
