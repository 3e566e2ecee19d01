"""Removal of passages that repeat across documents, by level-wise doubling.

A window of ``length`` words can only repeat if the shorter windows in it do.  For
13 words the levels are 4, 8 and 13: at each level every window of the full length
that is still a candidate is known by one shorter window in it, the one with the
smallest hash, so that neighbours share it and equal windows choose alike.  Only
candidates whose chosen window repeats in different texts go on to twice that
length, and each level reads nothing but what the level before kept.
:func:`repeat_lengths` doubles on from ``length`` in the same way until no
candidates survive.

Per level one row of hashes is shuffled per chosen window; which documents hold a
window is settled by a pre-aggregated minimum and a join, so a window that very
many documents share is never gathered.  Whole copies are settled by their text's
hash first.  A document is known by its id and the hash of its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loam.llm.columns import REST, restored, set_aside
from loam.llm.storage import Scratch
from loam.llm.text import as_list, joined_words, split_words, strings, text_slices

LENGTH = 13


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    coded = words.dictionary_encode()
    digests = b"".join([xxhash.xxh3_128_digest(w) for w in as_list(coded.dictionary)])
    table = np.frombuffer(digests, "<u8").reshape(-1, 2)
    index = coded.indices.to_numpy(zero_copy_only=False)
    return table[index, 0], table[index, 1]


def _double(h: np.ndarray, step: int, salt: int) -> np.ndarray:
    """From hashes of windows at each word, those of windows longer by ``step``."""
    return _mix(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:] + np.uint64(salt))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on, by doubling."""
    have = 1
    while have < length:
        step = min(have, length - have)
        if len(h) <= step:
            return h[:0]
        h = _double(h, step, have * 1000 + step)
        have += step
    return h


def first_level(length: int) -> int:
    """Words of the windows looked at first."""
    return max(1, min(4, -(-length // 2)))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _full_windows(offsets: np.ndarray, length: int) -> np.ndarray:
    """Word positions at which a window of one document starts."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    return np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def levels(length: int) -> list[int]:
    """Words of the windows looked at in turn: each twice the one before, the last ``length``."""
    out = [first_level(length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _chosen(h: np.ndarray, length: int, level: int) -> np.ndarray:
    """For the window at each word, the smallest hash of the windows of ``level`` words in it."""
    return _sliding_min(window_hashes(h, level), length - level + 1) if len(h) >= length else h[:0]


def _listed(values: np.ndarray, owner: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which values are in the list of their owner."""
    held = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(values.dtype)
    own = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    cut = np.searchsorted(owner, np.arange(len(lists) + 1))
    keep = np.zeros(len(values), bool)
    for d in range(len(lists)):
        keep[cut[d] : cut[d + 1]] = np.isin(values[cut[d] : cut[d + 1]], held[own[d] : own[d + 1]])
    return keep


def _candidates(batch: pa.RecordBatch, length: int, before: int | None):
    """Two hashes of each word; where windows start that the level ``before`` has kept
    (all without one), whose they are, and the documents' word offsets."""
    words, offsets = split_words(strings(batch.column("text")))
    h, g = _word_hashes(words)
    at = _full_windows(offsets, length)
    owner = np.repeat(np.arange(batch.num_rows), np.maximum(np.diff(offsets) - length + 1, 0))
    if before is not None and len(at):
        keep = _listed(_chosen(h, length, before)[at], owner, batch.column("hashes"))
        at, owner = at[keep], owner[keep]
    return h, g, at, owner, offsets


def _anchors(docs: DataFrame, length: int, level: int, before: int | None = None) -> DataFrame:
    """``(hash, doc_id, body)``: the windows of ``level`` words that candidates choose."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                h, _, at, owner, _ = _candidates(batch, length, before)
                if not len(at):
                    continue
                chosen = _chosen(h, length, level)[at]
                new = np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]
                of = pa.array(owner[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chosen[new].view(np.int64)), batch.column("doc_id").take(of), batch.column("body").take(of)],
                    names=["hash", "doc_id", "body"],
                )

    return docs.mapInArrow(run, "hash long, doc_id long, body long")


def _windows(docs: DataFrame, length: int, before: int) -> DataFrame:
    """``(high, low, doc_id, body, start)`` of the candidates at their full length."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                h, g, at, owner, offsets = _candidates(batch, length, before)
                yield _window_rows(batch, window_hashes(h, length), window_hashes(g, length), at, owner, offsets)

    return docs.mapInArrow(run, "high long, low long, doc_id long, body long, start int")


def _window_rows(batch: pa.RecordBatch, high: np.ndarray, low: np.ndarray, at: np.ndarray, owner: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    of = pa.array(owner)
    start = pa.array((at - offsets[owner]).astype(np.int32))
    columns = [pa.array(high[at].view(np.int64)), pa.array(low[at].view(np.int64)), batch.column("doc_id").take(of), batch.column("body").take(of), start]
    return pa.RecordBatch.from_arrays(columns, names=["high", "low", "doc_id", "body", "start"])


def _named(docs: DataFrame) -> DataFrame:
    """Documents with an id, known by it and the hash of their text."""
    text = F.coalesce("text", F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("body"))


def _survivors(scratch: Scratch, named: DataFrame, length: int, apart: str, left_out: DataFrame | None) -> DataFrame:
    """Windows of ``length`` words that all levels keep, as a kept table.  A window
    repeats if it occurs with different values of ``apart``; documents ``left_out``
    count for that but have no windows of their own."""
    texts, before = named, None
    for level in levels(length)[:-1]:
        anchors = scratch.keep(_anchors(texts, length, level, before), f"anchors-{level}")
        repeated = anchors.groupBy("hash").agg(F.min(apart).alias("a"), F.max(apart).alias("b")).where("a <> b").select("hash")
        repeated = scratch.keep(repeated, f"repeated-{level}")
        near = anchors.join(repeated, "hash").groupBy("doc_id", "body").agg(F.collect_set("hash").alias("hashes"))
        if left_out is not None and level == levels(length)[-2]:
            near = near.join(left_out, ["doc_id", "body"], "left_anti")
        near = scratch.keep(near, f"candidates-{level}")
        scratch.drop(f"anchors-{level}", f"repeated-{level}", *([f"candidates-{before}"] if before else []))
        texts, before = named.join(near, ["doc_id", "body"]), level
    windows = scratch.keep(_windows(texts, length, before), f"windows-{length}")
    scratch.drop(f"candidates-{before}")
    return windows


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``(doc_id, body, starts)``, where windows start that also start in a
    document with a smaller id; and ``(doc_id, body)`` of whole copies of a document
    with a smaller id, whose windows are left out of the first."""
    scratch, named = Scratch(docs.sparkSession, "substring"), _named(docs)
    texts = named.select("doc_id", "body", F.unhex(F.md5("text")).alias("text_hash"))
    # What is joined to a hot key is written first: Spark splits the partitions of a join
    # only if neither side is aggregated within it.
    copied = texts.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copied = scratch.keep(copied, "copied")
    copies = scratch.keep(texts.join(copied, "text_hash").where("doc_id > first").select("doc_id", "body").distinct(), "copies")
    scratch.drop("copied")

    windows = _survivors(scratch, named, length, "body", copies)
    first = windows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = scratch.keep(first.drop("last"), "firsts")
    found = windows.join(first, ["high", "low"]).where("doc_id > first").select("doc_id", "body", "start")
    starts = scratch.keep(found.groupBy("doc_id", "body").agg(F.sort_array(F.collect_set("start")).alias("starts")), "starts")
    scratch.drop(f"windows-{length}", "firsts")
    return starts, copies


#: Added columns; further columns of documents may have any other name.
STARTS, BODY = "__loam_starts", "__loam_body"


def _marked(docs: DataFrame, length: int) -> DataFrame:
    starts, copies = repeated_starts(docs, length)
    every = starts.unionByName(copies.withColumn("starts", F.array().cast("array<int>")))
    every = every.select("doc_id", F.col("body").alias(BODY), F.col("starts").alias(STARTS))
    return docs.withColumn(BODY, F.xxhash64(F.coalesce("text", F.lit("")))).join(every, ["doc_id", BODY], "left").drop(BODY)


def _covered(n: int, starts: np.ndarray | None, length: int) -> np.ndarray:
    """Which of a document's words are covered; no starts at all: those of a whole copy."""
    if starts is None or n < length:
        return np.zeros(n, bool)
    if not len(starts):
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(batch: pa.RecordBatch, length: int):
    """For each document: words, words removed, and the kept text."""
    buffer, begin, end, offsets = joined_words(strings(batch.column("text")))
    lists = batch.column(STARTS)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
    for d in range(batch.num_rows):
        a, b = offsets[d], offsets[d + 1]
        gone = _covered(int(b - a), values[upto[d] : upto[d + 1]] if valid[d] else None, length)
        if not gone.any():
            kept = buffer[begin[a] : end[b - 1]] if b > a else b""
        else:
            edges = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
            kept = b" ".join(buffer[begin[a + i] : end[a + j - 1]] for i, j in zip(edges[::2], edges[1::2], strict=True))
        yield int(b - a), int(gone.sum()), kept


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs``.

    A word is removed if a window of ``length`` words of its document covers it
    whose words also start in a document with a smaller doc_id.  Windows are judged
    on the input.  Null texts have no words; a row with a null id keeps all words
    and removes none elsewhere.  Rows that repeat an id are one document's versions:
    each is judged by its own text, and neither removes words of the other.  Texts of
    any length are read whole; of equal windows the one with the smallest id stays;
    an empty table gives no rows; further columns are ignored.
    """

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _kept(batch, length)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return _marked(narrow, length).select("doc_id", "text", STARTS).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``.

    Only texts that lose words change: their kept words are joined by one space.  All
    rows and columns stay, also those of nulls, repeated rows and texts that lose all
    their words, which become empty.  Cases are settled as in :func:`removal_report`;
    columns of any name but the two above may accompany a document.
    """

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                out = [kept.decode() if gone else text for text, (_, gone, kept) in zip(texts, _kept(batch, length), strict=True)]
                yield pa.RecordBatch.from_pydict({REST: batch.column(REST), "doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())})

    narrow = set_aside(docs, "doc_id", "text")
    marked = _marked(narrow, length).select(REST, "doc_id", "text", STARTS)
    kept = marked.mapInArrow(run, StructType([narrow.schema[c] for c in (REST, "doc_id", "text")]))
    return restored(kept, docs.columns, "doc_id", "text")


def _doubled(docs: DataFrame, length: int) -> DataFrame:
    """The windows of twice ``length`` words both of whose halves are among ``hashes``,
    the starts of repeated windows of ``length``."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                words, offsets = split_words(strings(batch.column("text")))
                h, g = _word_hashes(words)
                at = _full_windows(offsets, 2 * length)
                owner = np.repeat(np.arange(batch.num_rows), np.maximum(np.diff(offsets) - 2 * length + 1, 0))
                start, starts = at - offsets[owner], batch.column("hashes")
                keep = _listed(start, owner, starts) & _listed(start + length, owner, starts)
                yield _window_rows(batch, window_hashes(h, 2 * length), window_hashes(g, 2 * length), at[keep], owner[keep], offsets)

    return docs.mapInArrow(run, "high long, low long, doc_id long, body long, start int")


def repeat_lengths(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(length, windows)``: how many windows start that also start in a document with
    a smaller id, at ``length``, twice it, and so on, until no candidates survive.

    Windows inside whole copies count.  Only what repeats at one length is extended to
    the next.
    """
    spark, out = docs.sparkSession, []
    scratch, named = Scratch(spark, "repeat-lengths"), _named(docs).distinct()
    windows = _survivors(scratch, named, length, "doc_id", None)
    while True:
        first = windows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        first = scratch.keep(first, f"firsts-{length}")
        alive = scratch.keep(windows.join(first, ["high", "low"]), f"alive-{length}")
        n = alive.where("doc_id > first").select("doc_id", "body", "start").distinct().count()
        if not n:
            scratch.drop("")
            return spark.createDataFrame(out, "length int, windows long")
        out.append((length, n))
        starts = alive.groupBy("doc_id", "body").agg(F.collect_set(F.col("start").cast("long")).alias("hashes"))
        windows = scratch.keep(_doubled(named.join(starts, ["doc_id", "body"]), length), f"windows-{2 * length}")
        scratch.drop(f"windows-{length}", f"firsts-{length}", f"alive-{length}")
        length *= 2


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_substring": op5_substring}
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN firsts USING (k) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM hit)),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
ORACLE_SQL = {"op5_substring": OP5_SQL}
