"""Near copies: fingerprints propose, the exact similarity of shingle sets decides.

Sets of distinct shingles are linked if their Jaccard similarity is at least SHARE;
links are closed by connected components.  No pair that reaches it is missed:

* Equal sets are one node.  Each node has a SimHash fingerprint of its shingles, and
  the caller's index proposes links between near fingerprints.  Exact similarity
  keeps the right ones, so large groups of copies are joined at once.
* For what lies further apart, two bounds leave out most nodes.  Of similar sets of at
  least n shingles, those smallest hashes that are as many as may be missing and COMMON
  of n more have that many in common.  And all but a share of a set's shingles must be
  in other such sets too.
* In what is left, shingles are ordered by the number of sets they are in, rarest
  first.  Similar sets share one of their first few (the prefix), at places that leave
  room for the overlap, and differ little in size.
* Sets of one component need not be compared.  First all sets with a prefix shingle are
  compared with a few of them, which joins groups in as many rows as they have members.
  Then all pairs that are in different components still are compared, in rounds: the sets
  of a frequent shingle are dealt into parts, and pairs of a part are compared.  A group
  in which a share of the pairs are similar is joined in the first rounds by as many rows
  as it has members; the last round has one part, so no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.components import connected_components
from loam.llm.storage import Scratch
from loam.llm.substring import _word_hashes, window_hashes
from loam.llm.text import expand_ranges, split_words, strings, text_slices

SHINGLE_WORDS = 5
#: Least similarity, as a fraction.
SHARE = (4, 5)
#: One in so many shingles of a set must be found again among the smallest hashes.
COMMON = 10
#: Sets that all with a shingle in common are compared with first.
HEADS = 3
#: Sets with a shingle in common that are compared in the first round, and how many times
#: more in each round that follows.
MEMBERS, MORE = 128, 4


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, and the text that it is of.

    Texts with fewer words than ``shingle`` have their whole sequence as the one
    shingle, texts without words have none.
    """
    words, offsets = split_words(pc.ascii_lower(texts))
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(sizes - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    at = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
    out = np.zeros(len(owner), np.uint64)
    hashes = _word_hashes(words)[0] if len(words) else np.zeros(0, np.uint64)
    for length in range(1, shingle + 1):
        own = np.minimum(sizes, shingle)[owner] == length
        if own.any():
            out[own] = window_hashes(hashes, length)[at[own]]
    return out, owner


def _distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and owners, sorted by owner and value, each once."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of the hashes of each range, the bits that are set in more than half."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    sizes = np.diff(offsets)
    for k in range(64):
        ones = np.concatenate(([0], np.cumsum((hashes >> np.uint64(k)) & np.uint64(1), dtype=np.int64)))
        most = 2 * (ones[offsets[1:]] - ones[offsets[:-1]]) > sizes
        out |= most.astype(np.uint64) << np.uint64(k)
    return out


def needed_overlap(n):
    """Shingles of a set of n that a similar set must share with it."""
    return -(-n * SHARE[0] // SHARE[1])


def common_least(n):
    """How many of the smallest hashes of two similar sets of at least n are the same."""
    return np.maximum(1, n // COMMON)


def set_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, k1, k2, n, fp, least)``: a 128-bit hash of each document's set of
    shingles, its size, its fingerprint, and its smallest hashes, as many as a similar
    set may lack and :func:`common_least` more."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                values, owner = _distinct(*shingle_hashes(strings(batch.column("text")), shingle))
                offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=batch.num_rows))]
                sizes = np.diff(offsets)
                digests = b"".join([xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                keys = np.frombuffer(digests, np.int64).reshape(-1, 2)
                cut = np.where(sizes > 0, np.minimum(sizes, sizes - needed_overlap(sizes) + common_least(sizes)), 0)
                least = pa.array(values[expand_ranges(offsets[:-1], cut)].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.array(sizes, pa.int32()),
                        pa.array(majority_bits(values, offsets).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cut)], pa.int32()), least),
                    ],
                    names=["doc_id", "k1", "k2", "n", "fp", "least"],
                )

    schema = "doc_id long, k1 long, k2 long, n int, fp long, least array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def whole_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``(node, n, shingles)`` of the nodes, made again from their documents' texts."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                values, owner = _distinct(*shingle_hashes(strings(batch.column("text")), shingle))
                offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=batch.num_rows))]
                digests = b"".join([xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                keys = np.frombuffer(digests, np.int64).reshape(-1, 2)
                mine = np.flatnonzero((keys[:, 0] == batch.column("k1").to_numpy()) & (keys[:, 1] == batch.column("k2").to_numpy()))
                sizes = np.diff(offsets)[mine]
                kept = pa.array(values[expand_ranges(offsets[mine], sizes)].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), kept)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(mine)), pa.array(sizes, pa.int32()), lists], names=["node", "n", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(nodes.select(F.col("id").alias("doc_id"), "node", "k1", "k2"), "doc_id")
    # A repeated row makes its set again.
    return texts.mapInArrow(run, "node long, n int, shingles array<long>").dropDuplicates(["node"])


def _enough(overlap, n1: str, n2: str):
    """Whether sets of these sizes with this overlap reach SHARE."""
    return overlap * (SHARE[0] + SHARE[1]) >= (F.col(n1) + F.col(n2)) * SHARE[0]


def _possible():
    """Whether sets whose first common shingle is at p1 and p2 can reach SHARE."""
    return _enough(F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")), "n1", "n2")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach SHARE.  Only sets that are in a pair
    are moved."""

    def side(k: str) -> DataFrame:
        needed = pairs.select(F.col(k).alias("node")).distinct()
        own = sets.join(needed, "node", "left_semi")
        return own.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("shingles").alias(f"s{k}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_enough(F.size(F.array_intersect("sa", "sb")), "na", "nb")).select("a", "b")


def _near_fingerprints(nodes: DataFrame, index: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of nodes with one fingerprint or with such as the index links."""
    some = nodes.where("n > 0").select("node", "fp")
    heads = some.groupBy("fp").agg(F.min("node").alias("head"))
    same = some.join(heads, "fp").where("node > head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return same.unionByName(index(heads.select(F.col("head").alias("id"), "fp")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()


def _shared_prefixes(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """``(node, n, p, shingle)``: the prefix shingles of each set that are in others too,
    with their places, of the sets that have enough such shingles; a kept table."""
    listed = sets.select("node", F.explode("shingles").alias("shingle"))
    often = scratch.keep(listed.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "often")
    shared = listed.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    whole = F.col("n") - F.size("shared")  # shingles that no other set has come first
    missing = F.col("n") - F.ceil(F.col("n") * SHARE[0] / SHARE[1])
    few = shared.join(sets.select("node", "n"), "node").where(whole <= missing)
    places = few.select("node", "n", whole.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), missing + 1 - whole)).alias("p", "s"))
    out = scratch.keep(places.select("node", "n", (F.col("alone") + F.col("p")).cast("int").alias("p"), F.col("s.shingle").alias("shingle")), "places")
    scratch.drop("often")
    return out


def _mixed(scratch: Scratch, places: DataFrame, links: DataFrame, most: int, turn: int) -> DataFrame:
    """Of the prefix shingles those whose sets are in different components, with each
    set's component, the commonest of them, the number of sets, and a part to which the
    set is dealt where they are over ``most``; a kept table."""
    found = connected_components(links, "a", "b")
    labelled = scratch.keep(places.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), f"labelled-{turn}")
    each = labelled.groupBy("shingle", "label").agg(F.count("*").alias("c"))
    mixed = each.groupBy("shingle").agg(F.count("*").alias("labels"), F.sum("c").alias("members"), F.max_by("label", F.struct("c", "label")).alias("major"))
    mixed = scratch.keep(mixed.where("labels > 1").drop("labels"), f"mixed-shingles-{turn}")
    # Powers of two, so that pairs which meet by several shingles meet by most of them.
    parts = F.when(F.col("members") > most, F.pow(F.lit(2.0), F.ceil(F.log2(F.col("members") / most)))).otherwise(1.0).cast("long")
    part = F.pmod(F.xxhash64("node", F.lit(turn)), parts)
    out = scratch.keep(labelled.join(mixed, "shingle").withColumn("part", part), f"mixed-{turn}")
    scratch.drop(f"labelled-{turn}", f"mixed-shingles-{turn}")
    return out


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components in one part of a shingle.  One of them
    is not of the commonest component, whose own sets don't meet each other."""
    one, two = (mixed.select("shingle", "part", "major", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "p", "label")]) for k in (1, 2))
    met = one.where("label1 <> major").join(two.drop("major"), ["shingle", "part"])
    met = met.where("label1 <> label2 AND (label2 = major OR node1 > node2)").where(_possible())
    return met.select(F.greatest("node1", "node2").alias("a"), F.least("node1", "node2").alias("b")).distinct()


def _links(scratch: Scratch, docs: DataFrame, nodes: DataFrame, index: Callable[[DataFrame], DataFrame], shingle: int) -> DataFrame:
    """Pairs (a, b) of nodes that reach SHARE, enough to join all that do."""
    near = scratch.keep(_near_fingerprints(nodes, index), "near")
    least = nodes.select("node", F.explode("least").alias("shingle"))
    met = scratch.keep(least.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1").select("shingle"), "met")
    again = least.join(met, "shingle").groupBy("node").agg(F.count("*").alias("again"))
    bare = nodes.drop("least", "fp")
    # A similar set may have one in five shingles less, so fewer in common are asked for.
    wanted = bare.join(again, "node").where(F.col("again") >= F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * SHARE[0] / SHARE[1]) / COMMON))).select("node")
    wanted = wanted.unionByName(near.select(F.col("a").alias("node"))).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.keep(bare.join(wanted, "node", "left_semi"), "wanted")
    scratch.drop("met")
    sets = scratch.keep(whole_sets(docs, wanted, shingle), "sets")
    links = [scratch.keep(_verified(near, sets), "links-near")]
    places = _shared_prefixes(scratch, sets)

    # The same few come first for every shingle of a group, so that pairs coincide.
    head = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("order"), "node", "n", "p")) for k in range(HEADS)]
    heads = places.groupBy("shingle").agg(F.count("*").alias("members"), F.array_distinct(F.array(*head)).alias("heads"))
    heads = scratch.keep(heads.where("members > 1").drop("members"), "heads")
    sides = places.join(heads, "shingle").select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("p").alias("p1"), F.explode("heads").alias("head"))
    sides = sides.select("a", "n1", "p1", F.col("head.node").alias("b"), F.col("head.n").alias("n2"), F.col("head.p").alias("p2"))
    pairs = sides.where("a <> b").where(_possible()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = scratch.keep(pairs.join(near, ["a", "b"], "left_anti"), "pairs")
    links.append(scratch.keep(_verified(pairs, sets), "links-heads"))
    scratch.drop("heads")

    done, most, undecided = [near, pairs], MEMBERS, places
    for turn in count():
        mixed = _mixed(scratch, undecided, _union(links), most, turn)
        if turn:
            scratch.drop(f"mixed-{turn - 1}")
        # Components only grow together: a shingle whose sets are in one needs no further look.
        undecided = mixed.select(*places.columns)
        largest = mixed.agg(F.max("members")).first()[0]
        if largest is None:
            break
        rest = _across(mixed).join(_union(done), ["a", "b"], "left_anti")
        done.append(scratch.keep(rest, f"rest-{turn}"))
        links.append(scratch.keep(_verified(done[-1], sets), f"links-rest-{turn}"))
        if largest <= most:
            break
        most *= MORE
    scratch.drop("near", "wanted", "sets", "places", "pairs", *[f"rest-{k}" for k in range(turn + 1)], f"mixed-{turn}")
    out = scratch.keep(_union(links), "links")
    scratch.drop("links-near", "links-heads", *[f"links-rest-{k}" for k in range(len(links) - 2)])
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def similar_components(docs: DataFrame, index: Callable[[DataFrame], DataFrame], shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs``.

    ``index`` links rows of ``(id, fp)`` with near fingerprints, as pairs of ids.
    component_id is the smallest doc_id that links reach, the row's own included.
    Null texts count as empty, and texts without words equal each other.  Rows with
    a null id get the component of rows with the same set, but form no links.  Rows of
    one id are judged each by its own text; texts of any length are read whole; an
    empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.keep(set_rows(docs, shingle).withColumn("row", F.monotonically_increasing_id()), "rows")
    # A set is known by its first row, as one id may have several texts.
    named = rows.where("doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("id"))
    named = scratch.keep(named, "named")
    firsts = rows.select(F.col("row").alias("node"), "fp", "least").join(named, "node")
    nodes = scratch.keep(firsts.select("node", "id", "k1", "k2", "n", "fp", "least"), "nodes")
    links = _links(scratch, docs, nodes, index, shingle)
    labels = connected_components(links, "a", "b")
    placed = scratch.keep(named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    found = scratch.keep(placed.join(least, "component").select("k1", "k2", "n", "component_id"), "found")
    out = scratch.keep(rows.select("doc_id", "k1", "k2", "n").join(found, ["k1", "k2", "n"], "left").select("doc_id", "component_id"), "components")
    scratch.drop("rows", "named", "nodes", "placed", "found", "links")
    return out
