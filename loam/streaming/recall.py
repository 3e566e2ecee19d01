"""Recall turn by turn: what a conversation needs next, with state for each session.

A session remembers its last few vectors, the rows it has recalled and when it last
spoke.  A turn that stays on the topic recalls nothing; one that leaves it recalls what
is near and new.  :class:`Session` is the rule, which the stream and its batch twin share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loam.functions.vectors import block_search

# Distance of a turn that leaves the topic, vectors that are remembered, least score, share of the
# best score, rows of a turn, tokens of a turn, and seconds without a turn after which a session is forgotten.
SHIFT, RECENT, LEAST, SHARE, MOST_ROWS, MOST_TOKENS, IDLE = 0.4, 5, 0.35, 0.7, 5, 500, 3_600

SCHEMA = "session long, turn_id long, shifted boolean, drift double, ids array<long>, tokens long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else 0.0


class Session:
    """State of one session and what a turn does with it."""

    def __init__(self, recent=(), recalled=(), last: int | None = None, **options) -> None:
        self.recent, self.recalled, self.last = [np.asarray(v, float) for v in recent], set(recalled), last
        self.shift, self.least, self.rows, self.tokens, self.idle = (
            options.get(k, v) for k, v in (("shift", SHIFT), ("least", LEAST), ("rows", MOST_ROWS), ("tokens", MOST_TOKENS), ("idle", IDLE))
        )

    def turn(self, at: int, vector, candidates) -> tuple[bool, float | None, list[int], int]:
        """``at``: seconds.  Whether the topic was left, the distance from the mean of the
        remembered vectors (null for the first), the rows recalled and their tokens.

        ``candidates``: (id, score, tokens) in order.  The first row always fits.
        """
        if self.last is not None and at - self.last > self.idle:
            self.recent, self.recalled = [], set()
        self.last = at if self.last is None else max(self.last, at)
        vector = np.asarray(vector, float)
        drift = 1 - _cosine(vector, np.mean(self.recent, axis=0)) if self.recent else None
        shifted = not self.recent or 1 - _cosine(vector, self.recent[-1]) > self.shift
        self.recent = [*self.recent, vector][-RECENT:]
        ids, used = [], 0
        if shifted:
            new = [c for c in candidates if c[1] >= self.least and c[0] not in self.recalled]
            for i, _, tokens in [c for c in new if c[1] >= SHARE * new[0][1]][: self.rows]:
                if ids and used + tokens > self.tokens:
                    break
                ids.append(int(i))
                used += int(tokens)
            self.recalled.update(ids)
        return shifted, drift, ids, used


def wanted_candidates(turns: DataFrame, rows: int = MOST_ROWS, idle: int = IDLE) -> DataFrame:
    """``(query_id, wanted)``: how many candidates of a turn can matter.  Each turn since the
    session's last pause has recalled ``rows`` at most, and this one takes as many more."""
    own = Window.partitionBy("session").orderBy("ts", "turn_id")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    begun = turns.where("session is not null").select("session", "turn_id", "ts", at.alias("at"))
    begun = begun.withColumn("run", F.coalesce((F.col("at") - F.lag("at").over(own) > idle).cast("int"), F.lit(0)))
    begun = begun.withColumn("run", F.sum("run").over(own))
    number = F.row_number().over(Window.partitionBy("session", "run").orderBy("ts", "turn_id"))
    return begun.select(F.col("turn_id").cast("long").alias("query_id"), (number.cast("long") * rows).alias("wanted"))


def with_candidates(turns: DataFrame, memories: DataFrame, least: float = LEAST, wanted: DataFrame | None = None) -> DataFrame:
    """Turns (session, turn_id, ts, vector) with ``candidates``: the rows (id, vector, tokens)
    of at least ``least``, best first, ties by id; as many as there are, since what a session
    has recalled is passed over, or as many as ``wanted`` (query_id, wanted) says."""
    found = block_search(turns.select(F.col("turn_id").alias("id"), "vector"), memories.select("id", "vector"), "id", "vector", least)
    if wanted is not None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        found = found.join(wanted, "query_id").withColumn("place", place).where("place <= wanted").drop("place", "wanted")
    found = found.join(memories.select("id", "tokens"), "id")
    order = F.struct((-F.col("score")).alias("s"), F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens"))
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("l"))
    listed = listed.select(F.col("query_id").alias("turn_id"), F.transform("l", lambda c: F.struct(c["id"].alias("id"), (-c["s"]).alias("score"), c["tokens"].alias("tokens"))).alias("candidates"))
    none = F.array().cast("array<struct<id: bigint, score: double, tokens: bigint>>")
    return turns.join(listed, "turn_id", "left").withColumn("candidates", F.coalesce("candidates", none))


def _narrow(turns: DataFrame) -> DataFrame:
    return turns.select("session", "turn_id", F.col("ts").cast("timestamp").alias("ts"), F.col("vector").cast("array<double>").alias("vector"), "candidates")


def _taken(session: Session, key: int, rows) -> list[tuple]:
    out = []
    for turn_id, ts, vector, candidates in rows:
        ordered = [(c["id"], c["score"], c["tokens"]) for c in candidates]
        out.append((key, turn_id, *session.turn(int(ts.timestamp()), vector, ordered)))
    return out


_COLUMNS = ["session", "turn_id", "shifted", "drift", "ids", "tokens"]


def session_recall(turns: DataFrame, **options) -> DataFrame:
    """``(session, turn_id, shifted, drift, ids, tokens)`` for turns with candidates.

    On a stream (event time ``ts`` with a watermark) state lives in RocksDB: a list of
    vectors, a map of recalled ids and the last time; a timer frees it when the session
    has been idle.  Turns are taken in order within a batch; one that comes after a newer
    one is taken when it comes.  In a batch, sessions are sorted and swept, so a task holds
    the state of one session and never its rows.  Turns with a null session are left out.
    """
    turns = _narrow(turns).where("session is not null")
    if turns.isStreaming:
        return turns.groupBy("session").transformWithStateInPandas(_Recall(options), SCHEMA, "Append", "EventTime")

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session = None, None
        for frame in frames:
            out = []
            rows = frame[["session", "turn_id", "ts", "vector", "candidates"]].itertuples(index=False, name=None)
            for now, some in groupby(rows, key=lambda r: r[0]):
                if session is None or now != key:
                    key, session = now, Session(**options)
                out += _taken(session, key, (r[1:] for r in some))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return turns.repartition("session").sortWithinPartitions("session", "ts", "turn_id").mapInPandas(sweep, SCHEMA)


class _Recall(StatefulProcessor):
    def __init__(self, options: dict) -> None:
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "vector array<double>")
        self.recalled = handle.getMapState("recalled", "id long", "at long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        recalled = [r[0] for r in self.recalled.keys()] if self.recalled.exists() else []
        session = Session(recent, recalled, last, **self.options)
        whole = pd.concat(list(rows)).sort_values(["ts", "turn_id"])
        out = _taken(session, key[0], whole[["turn_id", "ts", "vector", "candidates"]].itertuples(index=False, name=None))
        self.last.update((session.last,))
        self.recent.put([(v.tolist(),) for v in session.recent])
        if not session.recalled >= set(recalled):
            self.recalled.clear()
            recalled = []
        for i in session.recalled.difference(recalled):
            self.recalled.updateValue((i,), (session.last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((session.last + session.idle + 1) * 1_000)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        self.recent.clear()
        self.recalled.clear()
        yield pd.DataFrame([], columns=_COLUMNS)

    def close(self) -> None:
        pass


def attach_candidates(stream: DataFrame, memories: DataFrame, path: str, checkpoint: str, least: float = LEAST) -> None:
    """Give each micro-batch of a stream of turns its candidates, as a table that
    :func:`session_recall` reads as a stream.  A batch that comes twice replaces itself."""

    def attach(batch: DataFrame, number: int) -> None:
        with_candidates(batch, memories, least).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(attach).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
