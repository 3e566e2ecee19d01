"""Prefix trie of conversations, from their globally sorted turn arrays.

Conversations are range-sorted by the digests of their turns.  Of neighbours, the length
of the longest common prefix (LCP) says which nodes end and which begin, so each part
of the sorted rows is swept once with a stack of open nodes.  A node that is open
across the border of parts, as the LCP there tells, is left as a fragment; fragments are
swept once more in order of their parts, which stitches the open stacks together.

A turn is known by the MD5 digest of its role and text, so texts are never shuffled.  A
node is named by its smallest conversation and its depth, which lead to its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import batched, chain, groupby, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from loam.llm.storage import Scratch
from loam.llm.text import as_list

#: Turns of a part, which a task holds as numbers.
PART_TURNS = 200_000
#: Open nodes up to which they are sent to the nodes below them; beyond, both are shuffled.
BROADCAST_ROWS = 250_000
#: Ids in a row of a fragment, rows of a batch that a task gives.
_IDS, _ROWS = 1_024, 8_192
_EMPTY = hashlib.sha256(b"").hexdigest()



def _schema(**kinds: str) -> StructType:
    known = {"int": IntegerType(), "long": LongType(), "string": StringType(), "boolean": BooleanType()}
    return StructType([StructField(name, known[kind]) for name, kind in kinds.items()])


_NODE = {c: "long" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")} | {"ends_sha256": "string"}
#: Whole nodes, with ``part, up`` where the parent is open; and fragments of open nodes.
_SWEPT = _schema(part="int", slot="int", up="int", **_NODE, before="boolean", stays="boolean", row="int", chars="long", ends="string")
#: Nodes, with null ``part``; and the smallest conversation of the node of each fragment.
_STITCHED = _schema(part="int", slot="int", **_NODE)


def turn_paths(conversations: DataFrame) -> DataFrame:
    """``(conv_id, path, chars)``: the digests and code points of a conversation's turns.

    Turns are in order of ``turn``, null first, ties in order of their digests.  A null
    role or text is empty.  Rows with a null conv_id are left out; repeated rows are
    turns of their own; texts may be of any length; further columns are ignored.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct("turn", digest.alias("d"), F.length(text).cast("long").alias("n")).alias("t"))
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return packed.select("conv_id", F.transform("t", lambda t: t["d"]).alias("path"), F.transform("t", lambda t: t["n"]).alias("chars"))


def with_shared_heads(paths: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns of the first conversation of their block of
    ids, then their own after the first h; h is the CRC-32 of the id modulo ``heads``.
    A block whose first conversation is absent gives no turns."""
    base = F.col("conv_id") - F.col("conv_id") % block
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.struct(*[F.slice(c, 1, heads).alias(c) for c in ("path", "chars")])), ignorenulls=True)
    wide = paths.withColumn("base", base).withColumn("head", head.over(Window.partitionBy("base"))).withColumn("h", h)

    def rebuilt(c: str) -> Column:
        first = F.coalesce(F.slice(F.col(f"head.{c}"), F.lit(1), F.col("h")), F.slice(c, 1, 0))
        return F.concat(first, F.slice(c, F.col("h") + 1, F.size(c)))

    return wide.select("conv_id", *[rebuilt(c).alias(c) for c in ("path", "chars")])


class _Trie:
    """Nodes by number, those that are open in a stack."""

    def __init__(self) -> None:
        self.up, self.depth, self.least, self.convs, self.children, self.leaves, self.saved, self.chars = (array("q") for _ in range(8))
        self.hashes: dict[int, str] = {}
        self.open: list[int] = []

    def push(self, chars: int, new: bool) -> int:
        """Open a node below the last open one; ``new``: it is counted as its child."""
        node, up = len(self.up), self.open[-1] if self.open else -1
        self.up.append(up)
        self.depth.append(len(self.open))
        self.least.append((1 << 63) - 1)
        self.chars.append(chars)
        for column in (self.convs, self.children, self.leaves, self.saved):
            column.append(0)
        if new and up >= 0:
            self.children[up] += 1
        self.open.append(node)
        return node

    def close(self, ends: str) -> None:
        """Settle the last open node and count it in its parent."""
        node = self.open.pop()
        self.hashes[node] = ends
        if not self.children[node]:
            self.leaves[node] = 1
        self.saved[node] += (self.convs[node] - 1) * self.chars[node]
        if self.open:
            self.fold(self.open[-1], self.least[node], self.convs[node], 0, self.leaves[node], self.saved[node])

    def fold(self, node: int, least: int, convs: int, children: int, leaves: int, saved: int) -> None:
        self.least[node] = min(self.least[node], least)
        self.convs[node] += convs
        self.children[node] += children
        self.leaves[node] += leaves
        self.saved[node] += saved

    def row(self, node: int, parent: int | None) -> tuple:
        return (self.least[node], self.depth[node], parent, self.convs[node], self.children[node], self.leaves[node], self.saved[node], self.hashes.get(node))


class _Part:
    """The sweep of one part.  Nodes of its first path down to the depth ``left`` were open
    before it, those of its last path down to ``right`` stay open after it."""

    def __init__(self, part: int, left: int, right: int) -> None:
        self.part, self.left, self.right = part, left, right
        self.trie, self.last = _Trie(), None
        self.before: set[int] = set()
        self.ids: dict[int, list[int]] = {}

    def add(self, conv_id: int, path: list[bytes], chars: list[int]) -> None:
        trie, first = self.trie, self.last is None
        if first:
            self.before.add(trie.push(0, False))
        same = 0 if first else next((k for k, (x, y) in enumerate(zip_longest(self.last, path)) if x != y), len(path))
        self._shut(same)
        for n in chars[same:]:
            old = first and len(trie.open) <= self.left
            node = trie.push(n, not old)
            if old:
                self.before.add(node)
        top = trie.open[-1]
        trie.convs[top] += 1
        trie.least[top] = min(trie.least[top], conv_id)
        self.ids.setdefault(top, []).append(conv_id)
        self.last = path

    def _shut(self, depth: int) -> None:
        trie = self.trie
        while len(trie.open) > depth + 1:
            node = trie.open[-1]
            if node in self.before:
                trie.open.pop()
            else:
                ids = self.ids.pop(node, None)
                trie.close(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else _EMPTY)

    def rows(self) -> Iterator[tuple]:
        self._shut(self.right)
        trie, stays = self.trie, set(self.trie.open)
        shared = self.before | stays
        for node, up in enumerate(trie.up):
            if node in shared:
                chunks = list(batched(self.ids.get(node, ()), _IDS)) or [()]
                for k, ids in enumerate(chunks):
                    yield (self.part, node, None, *trie.row(node, None), node in self.before, node in stays, k, trie.chars[node], ",".join(map(str, ids)))
            elif up in shared:
                yield (self.part, None, up, *trie.row(node, None), None, None, None, None, None)
            else:
                yield (None, None, None, *trie.row(node, trie.least[up]), None, None, None, None, None)


def _batches(rows: Iterator[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    for some in batched(rows, _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, path and conv_id; a task may have several parts."""

    def swept() -> Iterator[tuple]:
        now: _Part | None = None
        for batch in batches:
            part, left, right, ids = (batch.column(c).to_pylist() for c in ("part", "left", "right", "conv_id"))
            lists = [batch.column(c) for c in ("path", "chars")]
            sizes = lists[0].value_lengths().to_pylist()
            path, chars = (as_list(x.flatten()) for x in lists)
            at = 0
            for p, a, b, i, n in zip(part, left, right, ids, sizes, strict=True):
                if now is None or now.part != p:
                    if now:
                        yield from now.rows()
                    now = _Part(p, a, b)
                now.add(i, path[at : at + n], chars[at : at + n])
                at += n
        if now:
            yield from now.rows()

    return _batches(swept(), _SWEPT)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order of part, slot and row; each part leaves its stack to the next."""
    trie, hashes, places = _Trie(), {}, []

    def shut(depth: int) -> None:
        while len(trie.open) > depth + 1:
            ends = hashes.pop(trie.open[-1], None)
            trie.close(ends.hexdigest() if ends else _EMPTY)

    fragments = (r for batch in batches for r in batch.to_pylist())
    for part, rows in groupby(fragments, key=lambda r: r["part"]):
        stays, shut_here, node = -1, False, 0
        for r in rows:
            if r["row"] == 0:
                if not r["before"] and not shut_here:
                    shut(stays)
                    shut_here = True
                if not r["before"] or not trie.open:
                    trie.push(r["chars"], False)
                node = trie.open[r["depth"]]
                trie.fold(node, r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
                places.append((part, r["slot"], node))
                stays = max(stays, r["depth"] if r["stays"] else -1)
            if r["ends"]:
                if node in hashes:
                    hashes[node].update(b"," + r["ends"].encode())
                else:
                    hashes[node] = hashlib.sha256(r["ends"].encode())
        if not shut_here:
            shut(stays)
    shut(-1)
    nodes = ((None, None, *trie.row(n, trie.least[up] if up >= 0 else None)) for n, up in enumerate(trie.up))
    yield from _batches(chain(nodes, ((part, slot, trie.least[n], *[None] * 7) for part, slot, n in places)), _STITCHED)


def prefix_trie(paths: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)``: a node for each distinct beginning of the conversations' ``path``.

    ``conv_id`` is the smallest member and ``n_convs`` counts them; ``saved_tokens`` sums
    over the subtree the code points of a node's last turn for each member but one;
    ``ends_sha256`` is the hash of the ids that end here, ascending and comma-joined.  The
    root has depth 0 and no parent; it is there if any conversation is, though it have no
    turns.  Equal conversations share all nodes.  An empty table gives no nodes.

    A part holds about ``part_turns`` turns, more where one conversation is longer; groups
    of equal conversations are split over parts by their ids.  The only rows that one task
    reads are the fragments: for each part the nodes open at its borders, and the ids of
    conversations that end at these.
    """
    scratch = Scratch(paths.sparkSession, "trie")
    rows = scratch.keep(paths.select("conv_id", "path", "chars"), "paths")
    turns = rows.agg(F.coalesce(F.sum(F.size("path") + 1), F.lit(0))).first()[0]
    n = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // part_turns))
    dealt = scratch.keep(rows.repartitionByRange(n, "path", "conv_id").withColumn("part", F.spark_partition_id()), "parts")
    scratch.drop("paths")

    order = Window.orderBy("part")  # a row for each part
    common = F.zip_with(F.lag("last").over(order), F.col("first"), lambda a, b: F.coalesce(a == b, F.lit(False)))
    borders = dealt.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    apart = F.when(F.array_contains(common, False), F.array_position(common, False).cast("int") - 1).when(common.isNotNull(), F.size(common))
    borders = borders.select("part", F.coalesce(apart, F.lit(0)).alias("left"))
    borders = borders.withColumn("right", F.coalesce(F.lead("left").over(order), F.lit(0)))

    kept = dealt.join(F.broadcast(borders), "part").repartition(n, "part").sortWithinPartitions("part", "path", "conv_id")
    swept = scratch.keep(kept.select("part", "left", "right", "conv_id", "path", "chars").mapInArrow(_sweep, _SWEPT), "swept")
    scratch.drop("parts")
    stitched = swept.where("slot is not null").repartition(1).sortWithinPartitions("part", "slot", "row").mapInArrow(_stitch, _STITCHED)
    stitched = scratch.keep(stitched, "stitched")

    columns = list(_NODE)
    whole = swept.where("part is null").select(*columns).unionByName(stitched.where("part is null").select(*columns))
    parents = stitched.where("part is not null").select("part", F.col("slot").alias("up"), F.col("conv_id").alias("parent"))
    few = parents.count() <= BROADCAST_ROWS
    below = swept.where("part is not null and slot is null").join(F.broadcast(parents) if few else parents, ["part", "up"])
    return whole.unionByName(below.withColumn("parent_conv_id", F.col("parent")).select(*columns))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(turn_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP13_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS t FROM turns GROUP BY conv_id
), bits AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM lists
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.t[1:h], []), c.t[h + 1:]) AS t
  FROM lists c JOIN bits USING (conv_id) LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100
), members AS (
  SELECT conv_id, d, t[1:d] AS p, d = len(t) AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY p
), kids AS (
  SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), own AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].text) END AS saved FROM nodes LEFT JOIN kids USING (p)
), sums AS (
  SELECT p[1:k] AS p, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM own) GROUP BY 1
)
SELECT o.conv_id, o.depth, up.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, o.ends_sha256
FROM own o JOIN sums USING (p) LEFT JOIN own up ON o.depth > 0 AND up.p = o.p[1:o.depth - 1]
"""

QUERIES = {"op13_trie": op13_trie}
ORACLE_SQL = {"op13_trie": OP13_SQL}
