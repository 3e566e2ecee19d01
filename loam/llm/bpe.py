"""Byte-level BPE: token ids of whole texts, and the texts of token ids.

A text is cut into pieces by the tokenizer's pattern, a piece into bytes.  A segment
tree over the piece's adjacent pairs holds ``rank, position`` of each pair that can be
merged; its root is the leftmost pair of the lowest rank.  A merge changes three leaves
at most, each in logarithmic time, until the root says that no pair can be merged.
Short pieces are merged side by side, a row of trees to each; long ones one by one.
Pieces met before in a task are remembered, so a frequent piece is merged once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.text import as_list, expand_ranges, strings, text_slices

#: Pieces that a task remembers; then it starts anew.
MOST_PIECES = 600_000
#: Bytes up to which pieces are merged side by side, and leaves of the trees of one go.
SHORT_PIECE, _LEAVES = 64, 1 << 17
_NONE = 1 << 62
_POSITION = (1 << 32) - 1


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the
    next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """Merges, tokens and added tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, added = spec["model"]["vocab"], spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take the space around them are not supported")
        letters = byte_alphabet()
        byte_of = {c: bytes([b]) for b, c in enumerate(letters)}
        self.bytes = [ids[c] for c in letters]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a] << 32 | ids[b]] = rank
            self.made.append(ids[a + b])
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[p] for p in self.pairs.tolist()], np.int64)
        self.byte_ids, self.made_ids = np.array(self.bytes, np.int64), np.array(self.made, np.int64)
        tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in added}
        spelled = [b"".join(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in (tokens.get(i, "") for i in range(max(tokens) + 1))]
        self.sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.starts, self.spelling = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(spelled), np.uint8)
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in order; an added token is a piece of its own."""
        if self.cut is None or not any(t in text for t in self.added):
            return self.pattern.findall(text)
        return list(chain.from_iterable([part] if part in self.added else self.pattern.findall(part) for part in self.cut.split(text)))

    def piece_ids(self, pieces: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Pieces in some order with the number of their ids and all ids in that order."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            own, raw = self.added.get(piece), piece.encode()
            if own is not None or len(raw) > SHORT_PIECE:
                ids = merged([self.bytes[b] for b in raw], self.ranks, self.made) if own is None else [own]
                yield [piece], np.array([len(ids)], np.int64), np.array(ids, np.int64)
            else:
                classes.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for leaves, some in classes.items():
            for part in batched(some, _LEAVES // leaves):
                yield [piece for piece, _ in part], *merged_rows([raw for _, raw in part], leaves, self)

    def keys(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaves of pairs of ids at these positions."""
        pair = a << 32 | b
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[place] == pair, self.pair_ranks[place] << 32 | at, _NONE)


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _set(tree: list[int], at: int, key: int) -> None:
    """Put a leaf and mend what is above it, as far as something changes."""
    tree[at] = key
    while at > 1:
        least = tree[at] if tree[at] < tree[at ^ 1] else tree[at ^ 1]
        at >>= 1
        if tree[at] == least:
            return
        tree[at] = least


def merged(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """``ids`` after all merges, each time the leftmost pair of the lowest rank.

    ``ranks``: rank of the pair ``left << 32 | right``; ``made``: the id a rank makes.
    Leaf i of the tree is the pair that begins at position i.
    """
    n = len(ids)
    if n < 2:
        return ids
    leaves = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        rank = ranks.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[leaves + i] = rank << 32 | i
    for i in range(leaves - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != _NONE:
        i = root & _POSITION
        j = after[i]
        k = after[j]
        ids[i], after[i] = made[root >> 32], k
        if j < n - 1:
            _set(tree, leaves + j, _NONE)
        if k < n:
            before[k] = i
            rank = ranks.get(ids[i] << 32 | ids[k])
            _set(tree, leaves + i, _NONE if rank is None else rank << 32 | i)
        else:
            _set(tree, leaves + i, _NONE)
        h = before[i]
        if h >= 0:
            rank = ranks.get(ids[h] << 32 | ids[i])
            _set(tree, leaves + h, _NONE if rank is None else rank << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def merged_rows(pieces: list[bytes], leaves: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``merged`` of many pieces of at most ``leaves`` bytes, a power of two: a row with a
    tree for each, of which every round takes the root.  The number of ids of each piece,
    and all ids."""
    m, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    place = np.arange(leaves)
    alive = place < sizes[:, None]
    ids = np.full((m, leaves), -1, np.int64)
    ids[alive] = vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    tree = np.full((m, 2 * leaves), _NONE, np.int64)
    row, at = np.nonzero(alive[:, 1:])
    tree[row, leaves + at] = vocabulary.keys(ids[row, at], ids[row, at + 1], at)
    for low in (1 << k for k in range(leaves.bit_length() - 2, -1, -1)):
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
    after, before = np.tile(place + 1, (m, 1)), np.tile(place - 1, (m, 1))
    row = np.arange(m)
    while True:
        row = row[tree[row, 1] != _NONE]
        if not len(row):
            return alive.sum(axis=1), ids[alive]
        root = tree[row, 1]
        i = root & _POSITION
        j = after[row, i]
        k = after[row, j]
        ids[row, i], after[row, i], alive[row, j], tree[row, leaves + j] = vocabulary.made_ids[root >> 32], k, False, _NONE
        more = k < sizes[row]
        before[row[more], k[more]] = i[more]
        tree[row, leaves + i] = np.where(more, vocabulary.keys(ids[row, i], ids[row, np.where(more, k, 0)], i), _NONE)
        h = before[row, i]
        some = h >= 0
        tree[row[some], leaves + h[some]] = vocabulary.keys(ids[row[some], h[some]], ids[row[some], i[some]], h[some])
        three, up = np.concatenate([row, row, row[some]]), leaves + np.concatenate([i, j, h[some]])
        while up[0] > 1:
            up >>= 1
            tree[three, up] = np.minimum(tree[three, 2 * up], tree[three, 2 * up + 1])


class PieceIds:
    """Ids of the pieces met so far, up to ``most``; then it starts anew."""

    def __init__(self, vocabulary: Vocabulary, most: int = MOST_PIECES) -> None:
        self.vocabulary, self.most = vocabulary, most
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.sizes, self.table = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin and end."""
        pieces, counts = [], []
        for text in texts:
            found = self.vocabulary.pieces(text)
            counts.append(len(found))
            pieces += found
        if len(self.rows) > self.most:
            self._clear()
        missing = list(set(pieces).difference(self.rows))
        if missing:
            names, sizes, ids = zip(*self.vocabulary.piece_ids(missing), strict=True)
            self.rows.update((piece, k) for k, piece in enumerate(chain.from_iterable(names), len(self.sizes)))
            self.sizes, self.table = np.concatenate([self.sizes, *sizes]), np.concatenate([self.table, *ids]).astype(np.int32)
        row = np.fromiter(map(self.rows.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[row]
        flat = self.table[expand_ranges((np.cumsum(self.sizes) - self.sizes)[row], sizes)]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return flat, upto[np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))]


def spelled_out(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The text of each range of ids.  Ids that name no token are passed over; bytes that
    are no UTF-8 become U+FFFD."""
    known = (ids >= 0) & (ids < len(vocabulary.sizes))
    sizes = np.where(known, vocabulary.sizes[np.where(known, ids, 0)], 0)
    text = vocabulary.spelling[expand_ranges(vocabulary.starts[np.where(known, ids, 0)], sizes)].tobytes()
    at = np.concatenate(([0], np.cumsum(sizes)))[offsets].tolist()
    return [text[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)``: the token ids of each whole text, as the tokenizers library gives
    them without special tokens of its own, truncation or padding.

    An added token that a text spells out is that token.  Null and empty texts have no
    ids; rows with a null doc_id and repeated rows stay; a text of any length, and a
    piece of any length, is encoded whole; further columns are ignored; an empty table
    gives none.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PieceIds(load_vocabulary(path))
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, offsets = known.encode(as_list(strings(part.column("text"))))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, text)``: the text of each list of ids, added tokens included.

    Null lists and null ids count as absent, and so do ids of no token; bytes that are no
    UTF-8 become U+FFFD.  Rows with a null doc_id and repeated rows stay; further
    columns are ignored.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path)
        for batch in batches:
            step = max(1, 65_536 * batch.num_rows // max(1, len(batch.column("ids").flatten())))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column("ids")
                offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                texts = spelled_out(vocabulary, lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(decode, "doc_id long, ids array<int>, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = decode_documents(encode_documents(docs, path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op11_bpe": op11_bpe}
ORACLE_SQL: dict[str, str] = {}
