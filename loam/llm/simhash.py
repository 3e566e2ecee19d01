"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct 64-bit fingerprints that differ in at most two bits are linked.

* The top nodes of the index are masked bit patterns: 32 of the 64 bits, in six
  choices (four blocks of 16, two at a time).  Two bits touch at most two
  blocks, so linked fingerprints share at least one top node in full.  A top
  node with many members is factored again, by three sub-blocks of the other
  bits, of which one must agree: such a node has at most 2^22 members, whatever
  the input.
* Below a node, members are sorted by Gray rank, so that neighbours share long
  patterns; runs of neighbours become inner nodes that keep the bits on which all
  agree.  Pairs of nodes are descended together, and a pair whose agreed bits
  already differ in more than two places is pruned as a group.

A task returns a spanning forest of what it finds and never all pairs, and the
links are closed by connected components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import jaccard
from loam.llm.columns import free_name, named
from loam.llm.components import connected_components
from loam.llm.storage import Scratch
from loam.llm.text import joined_words, strings, text_slices

MAX_DISTANCE = 2
SHINGLE_WORDS = 3
SEED = 42
#: Members of a top node beyond which it is factored again.
NODE_ROWS = 4_096
#: Children of an inner node.
FAN_OUT = 8
#: Pairs of nodes looked at together, and rows of whole nodes held at a time.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 1 << 18


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints; a bit is set if over half the shingles set it.

    Texts with fewer words than ``shingle`` have their whole sequence as the one
    shingle, texts without words have fingerprint zero.
    """
    import pyarrow.compute as pc

    buffer, starts, ends, offsets = joined_words(pc.ascii_lower(texts))
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(sizes - shingle + 1, 1), 0)
    first = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    last = np.minimum(first + shingle - 1, np.repeat(offsets[1:], counts) - 1)
    digest = xxhash.xxh64_intdigest
    begin, end = starts[first].tolist(), ends[last].tolist()
    hashes = np.fromiter((digest(buffer[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, len(first))
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        cut = np.searchsorted(at, np.arange(0, len(hashes), 1 << 18), side="left")
        for lo, hi in zip(cut, [*cut[1:], len(at)], strict=True):
            if lo == hi:
                continue
            a, b = at[lo], at[hi] if hi < len(at) else len(hashes)
            bits = np.unpackbits(hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, at[lo:hi] - a, axis=0, dtype=np.int32)
            most = (2 * ones > counts[some[lo:hi], None]).astype(np.uint8)
            out[some[lo:hi]] = np.packbits(most, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``, fp as the signed long of the same bits."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                fp = fingerprints_of(strings(batch.column("text")), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp):
    """Column: position of a bit pattern in reflected Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _levels(fp: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """From the rows up: the bits all set, the bits any set, first and last child.

    Each group ends in one node; upper levels repeat it until all have one.
    """
    levels = [(fp, fp, np.arange(len(fp)), np.arange(len(fp)) + 1)]
    while True:
        size = len(group)
        new_group = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        if len(new_group) == size:
            return levels
        place = np.arange(size) - np.repeat(new_group, np.diff(np.r_[new_group, size]))
        first = np.flatnonzero(place % FAN_OUT == 0)
        all_set, any_set = levels[-1][0], levels[-1][1]
        levels.append((np.bitwise_and.reduceat(all_set, first), np.bitwise_or.reduceat(any_set, first), first, np.r_[first[1:], size]))
        group = group[first]


def _pairs(a: np.ndarray, b: np.ndarray, level: tuple[np.ndarray, ...], leaf: bool) -> tuple[np.ndarray, np.ndarray]:
    """Children of the node pairs (a, b), each unordered pair once."""
    _, _, first, last = level
    n, m = last[a] - first[a], last[b] - first[b]
    count = n * m
    owner = np.repeat(np.arange(len(a)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    i, j = first[a][owner] + k // m[owner], first[b][owner] + k % m[owner]
    keep = (a[owner] != b[owner]) | ((i < j) if leaf else (i <= j))
    return i[keep], j[keep]


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of linked rows; roots are the smallest row of a tree."""
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]


def link_forest(fp: np.ndarray, group: np.ndarray, distance: int = MAX_DISTANCE) -> np.ndarray:
    """For rows sorted by group and Gray rank, the first row that each is linked to,
    over links of at most ``distance`` bits within a group."""
    root = np.arange(len(fp))
    if not len(fp):
        return root
    levels = _levels(fp, group)
    top = len(levels) - 1
    tops = np.arange(len(levels[top][0]))
    stack = [(top, tops[k : k + 4096], tops[k : k + 4096]) for k in range(0, len(tops), 4096)]
    while stack:
        at, a, b = stack.pop()
        if at == 0:
            _merge(root, a, b)
            continue
        i, j = _pairs(a, b, levels[at], at == 1)
        all_set, any_set = levels[at - 1][:2]
        apart = (all_set[i] & ~any_set[j]) | (all_set[j] & ~any_set[i])
        keep = np.bitwise_count(apart) <= distance
        i, j = i[keep], j[keep]
        if at == 1:
            keep = root[i] != root[j]
            i, j = i[keep], j[keep]
        step = PAIRS_AT_ONCE // FAN_OUT**2 if at > 1 else PAIRS_AT_ONCE
        stack += [(at - 1, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
    return root


def _search(batches):
    """Streams sorted rows, holding whole nodes only, and returns their links."""
    held: list[pa.RecordBatch] = []

    def links(table: pa.Table):
        keys = [table.column(k).to_numpy() for k in ("mask", "pattern", "sub", "sub_pattern")]
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        ids = table.column("id").to_numpy()
        root = link_forest(table.column("fp").to_numpy().view(np.uint64), np.cumsum(new))
        linked = np.flatnonzero(root != np.arange(len(root)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS_AT_ONCE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(k).to_numpy() for k in ("mask", "pattern", "sub", "sub_pattern")]
        other = np.zeros(table.num_rows, bool)
        for k in last:
            other |= k != k[-1]
        whole = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        yield from links(table.slice(0, whole)) if whole else ()
        held = table.slice(whole).to_batches()
    if held:
        yield from links(pa.Table.from_batches(held).combine_chunks())


def _top_nodes() -> list[tuple[int, list[int]]]:
    """Mask of each choice of two blocks of 16 bits, and of the three sub-blocks of
    the other bits."""
    out = []
    for chosen in combinations(range(4), 2):
        rest = [16 * b + k for b in range(4) if b not in chosen for k in range(16)]
        mask = sum(((1 << 16) - 1) << (16 * b) for b in chosen)
        subs = [sum(1 << bit for bit in part) for part in (rest[:11], rest[11:22], rest[22:])]
        out.append((_signed(mask), [_signed(x) for x in subs]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """A spanning forest of the links between rows of ``(id, fp)`` with distinct fp,
    as pairs of ids."""
    tops = _top_nodes()
    entries = nodes.select(
        "id",
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern")) for k, (m, _) in enumerate(tops)])
        ).alias("top"),
    ).select("id", "fp", "top.mask", "top.pattern")
    # Written, so that Spark splits a crowded node in the join: it doesn't where a side is aggregated within it.
    sizes = entries.groupBy("mask", "pattern").agg(F.count("*").alias("members")).where("members > 1")
    sizes = Scratch(nodes.sparkSession, "top-nodes").keep(sizes, "sizes")
    entries = entries.join(sizes, ["mask", "pattern"])
    sub_mask = [F.element_at(F.array(*[F.lit(s[k]) for _, s in tops]), F.col("mask") + 1) for k in range(3)]
    subs = F.when(
        F.col("members") > NODE_ROWS,
        F.array(*[F.struct(F.lit(k).alias("sub"), F.col("fp").bitwiseAND(sub_mask[k]).alias("sub_pattern")) for k in range(3)]),
    ).otherwise(F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_pattern"))))
    keys = ["mask", "pattern", "sub", "sub_pattern"]
    members = entries.withColumn("node", F.explode(subs)).select("mask", "pattern", "node.sub", "node.sub_pattern", "id", "fp")
    return (
        members.repartition(*keys)
        .sortWithinPartitions(*keys, gray_rank(F.col("fp")))
        .select("mask", "pattern", "sub", "sub_pattern", "id", "fp")
        .mapInArrow(_search, "a long, b long")
    )


def near_duplicate_components(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own included.
    Null texts count as empty: their fingerprint is zero and is linked like any
    other.  Rows with a null id keep a fingerprint and get the component of rows
    with the same one, but form no links.  Rows of one id with different texts are
    judged each by its own fingerprint and may lie in different components.  Texts of
    any length are read whole, repeated rows stay, an empty table gives no rows,
    further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle), "fingerprints")
    nodes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), "nodes")
    labels = connected_components(fingerprint_links(nodes), "a", "b")
    named = nodes.join(labels, nodes["id"] == labels["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = jaccard.SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component.

    Documents are linked by a Jaccard similarity of their shingles of 0.8 or more
    (:mod:`loam.llm.jaccard`): the index above proposes links of fingerprints of these
    shingles, exact similarity decides on them, and what lies further apart than the
    index reaches is found by shared shingles.  Of repeated rows with one id the first
    by text, then by its JSON form, stays; columns may have any names and types.  Rows with a null id can't stand for a group and stay.
    """
    found = jaccard.similar_components(docs, fingerprint_links, shingle)
    kept = found.where("component_id is null or doc_id = component_id").select("doc_id").distinct()
    row = free_name(docs.columns, "row")
    with_id = docs.where("doc_id is not null").join(kept.where("doc_id is not null"), "doc_id", "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    single = with_id.join(repeated, "doc_id", "left_anti")
    columns = named(docs.columns)
    whole = F.struct(*columns)
    first = with_id.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias(row)).select(f"{row}.*")
    return single.select(*columns).union(first).union(docs.where("doc_id is null"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
