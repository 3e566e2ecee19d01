"""The merge ledger against a loop that merges and rolls back record by record."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import merges

MEMBERS = "cluster long, id long, text string, kind string, created long, observed long, importance double, accesses long, accessed long"


def members(n=60):
    rnd = random.Random(3)
    kinds = ["CONSTRAINT", "LESSON", "FACT", "EVENT", None]
    text = lambda k: " ".join(rnd.choice(["One", "two", "3", "four,"]) for _ in range(rnd.randrange(1, 9)))
    return [(k % 23 if k % 23 < 15 else 100 + k, k, text(k), rnd.choice(kinds), rnd.randrange(9), rnd.choice([None, rnd.randrange(9)]), rnd.randrange(4) / 4, rnd.randrange(5), rnd.choice([None, rnd.randrange(50)])) for k in range(n)]


def wanted_survivor(rows, strategy, detail):
    keys = {
        "newest": lambda r: r[5] if r[5] is not None else r[4],
        "oldest": lambda r: -r[4],
        "detailed": lambda r: detail[r[1]],
        "combine": lambda r: detail[r[1]],
        "important": lambda r: r[6],
    }
    return max(rows, key=lambda r: (keys[strategy](r), -r[1]))


@pytest.mark.parametrize("strategy", [None, "newest", "oldest", "detailed", "combine", "important"])
def test_each_strategy(spark, strategy):
    rows = members()
    df = spark.createDataFrame([*rows, (None, 900, "x", None, 1, None, 0.0, 0, None), (3, None, "x", None, 1, None, 0.0, 0, None)], MEMBERS)
    detail = {r["id"]: r["d"] for r in df.where("id is not null").select("id", merges.detail_score(F.col("text")).alias("d")).collect()}
    found: dict = {}
    for r in merges.merge_events(df, 1, F.lit(strategy) if strategy else None, 1_000).collect():
        found.setdefault(r["event"], []).append(r)
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(found) == {1_000 + c for c, g in groups.items() if len(g) > 1}
    for c, g in groups.items():
        if len(g) > 1:
            own = strategy or merges.STRATEGIES.get(min(g, key=lambda r: r[1])[3], "detailed")
            kept = wanted_survivor(g, own, detail)
            assert sorted(r["absorbed"] for r in found[1_000 + c]) == sorted(r[1] for r in g if r[1] != kept[1])
            accessed = max((r[8] for r in g if r[8] is not None), default=None)
            for r in found[1_000 + c]:
                assert (r["survivor"], r["content"], r["importance"], r["accesses"], r["accessed"]) == (kept[1], kept[2], max(x[6] for x in g), sum(x[7] for x in g), accessed)


def test_merge_roll_back_and_merge_again(spark):
    rows = members()
    df = spark.createDataFrame(rows, MEMBERS)
    records = df.select("id", "text", "importance", "accesses", "accessed")
    first = merges.merge_events(df, 1, F.lit("newest"))
    chosen = spark.createDataFrame([(c,) for c in range(0, 15, 3)] + [(77,)], "event long")
    ledger = first.unionByName(merges.rollbacks(chosen, 2))
    again = merges.merge_events(df.where("cluster % 6 = 0 and cluster < 15"), 3, F.lit("oldest"), 5_000)
    ledger = ledger.unionByName(again).unionByName(again)
    # Survivors of even clusters merge once more, into the first of them.
    survivors = [r["survivor"] for r in first.where("event % 3 <> 0 and event % 2 = 0").select("survivor").distinct().orderBy("survivor").collect()]
    up = merges.merge_events(df.where(F.col("id").isin(survivors)).withColumn("cluster", F.lit(9_000)), 4, F.lit("oldest"))
    ledger = ledger.unionByName(up)

    def replay(at):
        """By hand: events in order, each with what it takes, and rollbacks that lift one event alone."""
        events: dict = {}
        for r in sorted(map(tuple, ledger.distinct().where(F.col("at") <= at).collect()), key=lambda r: (r[1], r[0])):
            if r[2] == "merge":
                events.setdefault((r[0], r[1]), []).append(r)
            else:
                events = {k: v for k, v in events.items() if k[0] != r[0] or k[1] > r[1]}
        state = {r[1]: {"text": r[2], "importance": r[6], "accesses": r[7], "accessed": r[8], "by": None} for r in rows}
        for _, some in sorted(events.items(), key=lambda kv: (kv[0][1], kv[0][0])):
            for r in some:
                state[r[4]]["by"] = r[3]
                own = state[r[3]]
                own.update(text=r[5], importance=max(own["importance"], r[6]), accesses=r[7], accessed=r[8])
        return state

    for at in (0, 1, 2, 3, 4):
        found = {r["id"]: r for r in merges.records_at(records, ledger, at).collect()}
        assert len(found) == len(rows)
        for i, own in replay(at).items():
            r = found[i]
            assert (r["text"], r["importance"], r["accesses"], r["accessed"], r["superseded_by"], r["live"]) == (own["text"], own["importance"], own["accesses"], own["accessed"], own["by"], own["by"] is None), (at, i)
    assert merges.records_at(records, ledger).where("live").count() == merges.records_at(records, ledger, 4).where("live").count() < len(rows)
