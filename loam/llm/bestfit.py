"""Best-fit packing of documents into sequences, by large-item matching.

Documents above a third of the capacity go at most two to a sequence: a greedy
matching pairs the largest with the largest partner that still fits.  Smaller
ones then fill the gaps, in decreasing order, each into the tightest gap that
holds it.

Only the histogram of lengths (at most ``capacity`` rows) decides, so the plan
is computed once, on runs of equal sequences, and every piece finds its place
from its rank among the pieces of equal length.  Ranks come from counts per
bucket, so no length class is gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loam.llm.columns import with_fields
from loam.llm.storage import Scratch
from loam.llm.text import strings, text_slices
from loam.llm.tokenize import WordIds, encode_texts

CAPACITY = 2048
#: Pieces that one bucket of the ranking holds on average.
BUCKET_ROWS = 10_000
#: Bytes of text that a task encodes at once: what it holds for them is some forty times as much.
SLICE_BYTES = 2 << 20

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(upto: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, number and start (in its document) of each piece."""
    sizes = np.diff(upto)
    counts = -(-sizes // capacity)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, number, number * capacity


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: its document, number, start, length and CRC-32 of its ids.

    A null or empty text has the end id alone.  Ids are not kept: they follow
    from the text.
    """

    def cut(batches):
        known = WordIds(tokenizer_path)
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE_BYTES):
                ids, upto = encode_texts(strings(batch.column("text")), known, end_id)
                owner, number, start = piece_bounds(upto, capacity)
                begin = upto[owner] + start
                end = np.minimum(begin + capacity, upto[owner + 1])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(owner)),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(end - begin, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


class _Gaps:
    """Runs of equal sequences by the room left in them."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if not self.runs[gap]:
                insort(self.sizes, gap)
            self.runs[gap].append((first, count))

    def tightest(self, need: int) -> tuple[int, int, int] | None:
        k = bisect_left(self.sizes, need)
        if k == len(self.sizes):
            return None
        gap = self.sizes[k]
        first, count = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.sizes[k]
        return gap, first, count


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Places for ``histogram[length]`` pieces of each length.

    Returns for each length its places as (first rank, pieces, first sequence,
    offset), where rank r of such a run goes to sequence ``first sequence + r -
    first rank``; and the number of sequences.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    places: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    gaps, made = _Gaps(), 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        places[length].append((used[length], count, first, offset))
        used[length] += count

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        top = large[-1]
        k = bisect_left(large, capacity - top + 1) - 1
        partner = large[k] if k >= 0 else None
        if partner == top:
            pairs = left[top] // 2
            partner = partner if pairs else (large[k - 1] if k else None)
        if partner is None:
            count, rest = left[top], capacity - top
        else:
            count = pairs if partner == top else min(left[top], left[partner])
            rest = capacity - top - partner
        put(top, count, made, 0)
        left[top] -= count
        if partner is not None:
            put(partner, count, made, top)
            left[partner] -= count
        gaps.add(rest, made, count)
        made += count
        for one in {top, partner} - {None}:
            if not left[one]:
                large.remove(one)

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        count = left[length]
        while count:
            found = gaps.tightest(length)
            if found is None:
                gap, first = capacity, made
                run = -(-count // (capacity // length))
                made += run
            else:
                gap, first, run = found
            each = gap // length
            full = min(run, count // each)
            for k in range(each if full else 0):
                put(length, full, first, capacity - gap + k * length)
            gaps.add(gap - each * length, first, full)
            count -= full * each
            if full < run and 0 < count < each:
                for k in range(count):
                    put(length, 1, first + full, capacity - gap + k * length)
                gaps.add(gap - count * length, first + full, 1)
                count, full = 0, full + 1
            gaps.add(gap, first + full, run - full)
    return dict(places), made


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with doc_id, piece and length."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, _ = plan_packing(counts, capacity)
    total = sum(counts.values())
    buckets = max(1, -(-total // BUCKET_ROWS))
    tables = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in places.items()}

    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked_before"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        bucketed.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("ranked_before"))
        .drop("bucket", "ranked_before")
    )

    def place(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(part):
                    first_rank, _, first_sequence, at = tables[int(lengths[part[0]])]
                    k = np.searchsorted(first_rank, ranks[part], side="right") - 1
                    sequence[part] = first_sequence[k] + ranks[part] - first_rank[k]
                    offset[part] = at[k]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            columns |= {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_pydict(columns)

    names = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = with_fields(names, sequence_id=LongType(), offset=LongType())
    return ranked.select(*[f.name for f in names], F.col("rank").cast("long")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    Only documents over ``capacity`` tokens are cut, of any length and without loss.
    Null texts are empty ones; a null id stays null; equal rows each get a place of
    their own; of pieces of one length those come first whose ids, then numbers, are
    smaller within a hashed bucket; an empty table gives no rows; other columns are
    ignored.
    """
    pieces = Scratch(docs.sparkSession, "bestfit").keep(document_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place_pieces(pieces, capacity).select(*columns)


def best_fit(lengths: list[int], capacity: int) -> int:
    """Sequences that plain best-fit-decreasing takes; for tests and reports."""
    bins: list[int] = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(bins, x)
        gap = bins.pop(k) if k < len(bins) else capacity
        insort(bins, gap - x)
    return len(bins)


def op8_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_bestfit": op8_bestfit}
ORACLE_SQL: dict[str, str] = {}
