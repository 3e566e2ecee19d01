"""Packed token id matrices.

Each task tokenizes its documents, cuts those over the row length losslessly, and
packs the pieces by best-fit decreasing: a segment tree over the room left in
rows finds the tightest row that still holds a piece.  A task packs what it reads,
in buffers of bounded size, so no ids are shuffled; a buffer wastes about one row.

Written per buffer, beside each other: the id matrix, the cumulative lengths of the
segments of each row, and where positions reset, with the position in its document
that the segment goes on from.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.bestfit import piece_bounds
from loam.llm.storage import open_filesystem, shared_path
from loam.llm.text import strings, text_slices
from loam.llm.tokenize import WordIds, encode_texts, id_type

ROW_TOKENS = 2048
#: Tokens that are packed together: what a task holds at once.
BUFFER_TOKENS = 4 << 20
PAD_ID = 0

SCHEMA = (
    "matrix string, row int, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, "
    "resets array<int>, base_positions array<long>, ids_crc32 long"
)


class RoomTree:
    """Segment tree over amounts of room: how many open rows have each amount."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest amount of at least ``need`` that an open row has."""
        k = need + self.size
        if self.count[k]:
            return need
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and offset of each piece, and the number of rows."""
    row, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_rows, rows = RoomTree(capacity), {}, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = tree.tightest(need)
        if room is None:
            at, room, rows = rows, capacity, rows + 1
        else:
            at = open_rows[room].pop()
            tree.add(room, -1)
        row[k], offset[k] = at, capacity - room
        if room > need:
            open_rows.setdefault(room - need, []).append(at)
            tree.add(room - need, 1)
    return row, offset, rows


class _Buffer:
    """Pieces held until there are enough to pack."""

    def __init__(self, directory: str, capacity: int, kind: type) -> None:
        self.directory, self.capacity, self.kind = directory, capacity, kind
        self.clear()

    def clear(self) -> None:
        self.ids, self.doc_ids, self.pieces, self.starts, self.lengths, self.tokens = [], [], [], [], [], 0

    def add(self, ids: np.ndarray, upto: np.ndarray, doc_ids: list) -> None:
        owner, number, start = piece_bounds(upto, self.capacity)
        begin = upto[owner] + start
        self.ids.append((ids.astype(self.kind), begin))
        self.doc_ids += [doc_ids[k] for k in owner.tolist()]
        self.pieces.append(number)
        self.starts.append(start)
        self.lengths.append(np.minimum(self.capacity, upto[owner + 1] - begin))
        self.tokens += len(ids)

    def pack(self) -> pa.RecordBatch | None:
        """Writes the matrix and its companions; a row per row of the matrix."""
        if not self.doc_ids:
            return None
        lengths, pieces, starts = (np.concatenate(x) for x in (self.lengths, self.pieces, self.starts))
        row, offset, rows = best_fit_decreasing(lengths, self.capacity)
        matrix = np.full((rows, self.capacity), PAD_ID, self.kind)
        k = 0
        for ids, begin in self.ids:
            for b in begin.tolist():
                n = lengths[k]
                matrix[row[k], offset[k] : offset[k] + n] = ids[b : b + n]
                k += 1
        order = np.lexsort((offset, row))
        cut = np.searchsorted(row[order], np.arange(rows + 1))
        name = uuid.uuid4().hex
        cumulative = [np.r_[offset[order[a:b]], offset[order[b - 1]] + lengths[order[b - 1]]] for a, b in zip(cut, cut[1:], strict=False)]
        self._write(name, matrix, np.concatenate(cumulative), np.cumsum([0, *map(len, cumulative)]), offset[order], starts[order])
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))
        used = np.array([c[-1] for c in cumulative])
        crc = [zlib.crc32(matrix[r, : used[r]].astype("<u4").tobytes()) for r in range(rows)]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([name] * rows),
                pa.array(np.arange(rows), pa.int32()),
                pa.array(used, pa.int32()),
                lists([self.doc_ids[k] for k in order.tolist()], pa.int64()),
                lists(pieces[order], pa.int32()),
                pa.array([c.tolist() for c in cumulative], pa.list_(pa.int32())),
                lists(offset[order], pa.int32()),
                lists(starts[order], pa.int64()),
                pa.array(crc, pa.int64()),
            ],
            names=["matrix", "row", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "resets", "base_positions", "ids_crc32"],
        )
        self.clear()
        return out

    def _write(self, name: str, matrix, cumulative, cumulative_cut, resets, base) -> None:
        system, root = open_filesystem(self.directory)
        system.create_dir(root, recursive=True)
        little = lambda x, kind: np.ascontiguousarray(x.astype(kind))
        parts = {
            "ids": little(matrix, f"<u{matrix.dtype.itemsize}"),
            "cu_seqlens": little(cumulative, "<i4"),
            "cu_offsets": little(cumulative_cut, "<i8"),
            "resets": little(resets, "<i4"),
            "base_positions": little(base, "<i8"),
        }
        for part, values in parts.items():
            with system.open_output_stream(f"{root}/{name}.{part}.npy", compression=None) as out:
                held = io.BytesIO()
                np.save(held, values)
                out.write(held.getbuffer())


def pack_matrices(docs: DataFrame, directory: str, tokenizer_path: str, capacity: int = ROW_TOKENS, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as packed matrices in ``directory``, named after the column
    ``matrix``; one row per matrix row, with what it holds.

    A null or empty text is the end id alone.  Repeated rows are packed each; a null
    id stays null in the lists; an empty table writes nothing and gives no rows;
    further columns are ignored.  A task that is repeated writes anew under other
    names: the files that the rows name are whole.  All files of a tokenizer have ids of one
    width, 16 bits where its vocabulary fits, else 32.
    """

    def run(batches):
        known, buffer = WordIds(tokenizer_path), _Buffer(directory, capacity, id_type(tokenizer_path, end_id, PAD_ID))
        for whole in batches:
            for batch in text_slices(whole, "text"):
                ids, upto = encode_texts(strings(batch.column("text")), known, end_id)
                buffer.add(ids, upto, batch.column("doc_id").to_pylist())
                if buffer.tokens >= BUFFER_TOKENS:
                    yield buffer.pack()
        last = buffer.pack()
        if last is not None:
            yield last

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def read_matrix(directory: str, name: str) -> dict[str, np.ndarray]:
    """The parts of a matrix by name."""
    system, root = open_filesystem(directory)
    out = {}
    for part in ("ids", "cu_seqlens", "cu_offsets", "resets", "base_positions"):
        with system.open_input_stream(f"{root}/{name}.{part}.npy", compression=None) as stream:
            out[part] = np.load(io.BytesIO(stream.read()))
    return out


def position_ids(cu_seqlens: np.ndarray, capacity: int) -> np.ndarray:
    """Positions of a row: from zero again at every segment, zero where it is padded."""
    out = np.zeros(capacity, np.int64)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def op3_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_matrices(docs, shared_path(spark, "matrices"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_token_matrix": op3_token_matrix}
ORACLE_SQL: dict[str, str] = {}
