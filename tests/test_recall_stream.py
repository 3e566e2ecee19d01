"""Recall by turns: the rule against a plain loop, the stream against its batch twin."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.streaming import recall

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
OPTIONS = {"shift": 0.5, "least": 0.2, "rows": 3, "tokens": 40, "idle": 1_000}


def vectors(n, seed):
    rnd = np.random.default_rng(seed)
    return [v / np.linalg.norm(v) for v in rnd.normal(size=(n, 6))]


def made():
    rnd = random.Random(4)
    turns, at = [], {}
    for k, v in enumerate(vectors(80, 1)):
        s = rnd.randrange(4)
        at[s] = at.get(s, 0) + rnd.choice([30, 200, 999, 1_000, 1_001, 5_000])
        turns.append((s, k, START + timedelta(seconds=at[s]), v.tolist()))
    memories = [(1_000 + k, v.tolist(), 5 + k % 30) for k, v in enumerate(vectors(60, 2))]
    return sorted(turns, key=lambda t: (t[2], t[1])), memories


def plain(turns, memories):
    out, state = {}, {}
    for s, k, ts, v in turns:
        last, recent, recalled = state.get(s, (None, [], set()))
        if last is not None and (ts - last).total_seconds() > OPTIONS["idle"]:
            recent, recalled = [], set()
        shifted = not recent or 1 - float(np.dot(v, recent[-1])) > OPTIONS["shift"]
        ids, used = [], 0
        if shifted:
            hits = sorted(((round(float(np.dot(v, m)), 12), -i, n) for i, m, n in memories), reverse=True)
            hits = [(x, -i, n) for x, i, n in hits if x >= OPTIONS["least"] and -i not in recalled]
            hits = [h for h in hits if h[0] >= 0.7 * hits[0][0]][: OPTIONS["rows"]]
            for _, i, n in hits:
                if ids and used + n > OPTIONS["tokens"]:
                    break
                ids.append(i)
                used += n
        state[s] = (ts, [*recent, v][-5:], recalled | set(ids))
        out[s, k] = (shifted, ids, used)
    return out


@pytest.fixture(scope="module")
def frames(spark):
    turns, memories = made()
    t = spark.createDataFrame(turns, "session long, turn_id long, ts timestamp, vector array<double>")
    return t, spark.createDataFrame(memories, "id long, vector array<double>, tokens int")


def listed(df):
    return {(r["session"], r["turn_id"]): (r["shifted"], r["ids"], r["tokens"]) for r in df.collect()}


def test_turns_in_a_batch_against_a_plain_loop(spark, frames):
    turns, memories = frames
    asked = recall.with_candidates(turns.unionByName(turns.limit(1).withColumn("session", F.lit(None).cast("long")).withColumn("turn_id", F.lit(999).cast("long"))), memories, OPTIONS["least"])
    found = listed(recall.session_recall(asked, **OPTIONS))
    assert found == plain(*made())
    assert sum(len(ids) for _, ids, _ in found.values()) > 30 and not all(s for s, _, _ in found.values())


def test_turns_on_a_stream_of_several_batches(spark, frames, tmp_path):
    turns, memories = frames
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", recall.ROCKS)
    ordered = made()[0]
    for k in range(0, len(ordered), 16):
        part = spark.createDataFrame(ordered[k : k + 16], turns.schema).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/turns")
    arrive = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/turns")
    recall.attach_candidates(arrive, memories, f"{tmp_path}/asked", f"{tmp_path}/attach", OPTIONS["least"])
    asked = spark.read.parquet(f"{tmp_path}/asked")
    assert asked.select("batch").distinct().count() == 5
    stream = spark.readStream.schema(asked.drop("batch").schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/asked")
    found = recall.session_recall(stream.withWatermark("ts", "2 hours"), **OPTIONS)
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) > 2
    assert listed(spark.read.parquet(f"{tmp_path}/out")) == listed(recall.session_recall(asked, **OPTIONS)) == plain(*made())
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
