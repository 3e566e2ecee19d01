"""The rate limit over several batches with late rows, and its state's end."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from loam.streaming import events

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
BATCHES = [
    [(1, 0), (1, 5), (1, 5), (2, 0)],
    [(1, 3), (1, 9), (2, 100)],  # the first is late
    [(2, 5_000)],
    [(1, 9_000), (1, 9_001), (1, 9_001)],
]


def test_late_rows_and_freed_state(spark, tmp_path):
    schema, number = "user_id long, event_id long, ts timestamp", 0
    wanted, held = set(), {}
    for rows in BATCHES:
        made = []
        for user, second in sorted(rows, key=lambda r: r[1]):
            made.append((user, number, START + timedelta(seconds=second)))
            number += 1
        for user, second in sorted({r for r in rows}, key=lambda r: r[1]):
            own = held.setdefault(user, [])
            own += [second] * sum(r == (user, second) for r in rows)
            n = sum(second - 10 <= t <= second for t in own)
            wanted |= {(user, e, n) for u, e, ts in made if u == user and ts == START + timedelta(seconds=second) and n > 2}
            held[user] = own
        held = {u: [t for t in own if t >= max(own) - 10] for u, own in held.items()}
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
    query = events.rate_limit(stream, 2, 10).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == wanted and len(wanted) > 4
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 2 + 1
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress) >= 1
