"""Event streams.  Every operator has a batch twin with the same rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str, watermark: str = "1 hour") -> DataFrame:
    """The events as a file stream, with event time and a watermark."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def drain(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a Parquet table, and read it."""
    df.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(sink)


def _stamp(df: DataFrame):
    """``ts`` as a timestamp; as it is where it is one, so that its watermark stays."""
    return F.col("ts") if dict(df.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp")


def windows(df: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts by type."""
    w = F.window(_stamp(df), size, slide or size)
    return df.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def sessions(df: DataFrame, gap: str = "600 seconds") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    found = df.groupBy(F.session_window(_stamp(df), gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def distinct_events(df: DataFrame) -> DataFrame:
    """Each event once, within the watermark in a stream."""
    return df.dropDuplicatesWithinWatermark(["event_id"]) if df.isStreaming else df.dropDuplicates(["event_id"])


MARKER_SCHEMA = "user_id long, event_id long, gap_s double"


def gap_markers(stream: DataFrame, seconds: int = 600) -> DataFrame:
    """Markers where a user's event comes more than ``seconds`` after the last one seen.

    State is one timestamp per user, which stays, since an event after any pause is
    marked.  Events are put in order within a batch; one that arrives later than a newer
    one gets no marker.
    """

    def mark(key: tuple, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        found = [f for f in frames if len(f)]
        if not found:
            return
        whole, out = pd.concat(found).sort_values(["ts", "event_id"]), []
        for event_id, ts in zip(whole["event_id"], whole["ts"], strict=True):
            now = ts.value // 1000
            if last is not None and now - last > seconds * 1_000_000:
                out.append((key[0], event_id, (now - last) / 1_000_000))
            last = now if last is None else max(last, now)
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "gap_s"])

    return stream.groupBy("user_id").applyInPandasWithState(mark, MARKER_SCHEMA, "last long", "append", GroupStateTimeout.NoTimeout)


RATE_SCHEMA = "user_id long, event_id long, n long"


def rate_limit(df: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """``(user_id, event_id, n)`` of a user's rows beyond ``limit`` within the sliding
    window that ends with them, to the second.

    On a stream, state is the seconds of a user's rows in the last window, so its size
    is that of one window; rows are put in order within a batch, and one that arrives
    after a newer one is counted with what is left of its window.  When the watermark has
    passed a user's window, which holds no row that counts any more, the state is freed.
    """
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    if not df.isStreaming:
        w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds, 0)
        return df.withColumn("n", F.count("*").over(w)).where(F.col("n") > limit).select("user_id", "event_id", "n")

    def count(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = sorted(state.get[0]) if state.exists else []
        found = [f for f in frames if len(f)]
        if not found:
            return
        whole, out = pd.concat(found).sort_values(["at", "event_id"]), []
        for now, rows in whole.groupby("at", sort=True):
            at = bisect_right(held, now)
            held[at:at] = [int(now)] * len(rows)
            n = at + len(rows) - bisect_left(held, now - seconds)
            out += [(key[0], event_id, n) for event_id in rows["event_id"] if n > limit]
        state.update((held[bisect_left(held, held[-1] - seconds) :],))
        state.setTimeoutTimestamp(max((held[-1] + seconds + 1) * 1_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "n"])

    keyed = df.select("user_id", "event_id", "ts", at.alias("at"))
    return keyed.groupBy("user_id").applyInPandasWithState(count, RATE_SCHEMA, "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
