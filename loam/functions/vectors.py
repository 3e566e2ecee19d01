"""Vector expressions, the block search of a bounded query set, and the self-join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that are sent to every task; more are searched in parts.
QUERY_BYTES = 32 << 20
#: Rows of a block of a self-join.
BLOCK_ROWS = 16_384
#: Scores, and rows that visit cells, that a task holds at once.
CELLS, VISITS = 1 << 20, 1 << 14


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is zero; null where sizes differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).otherwise(F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a norm is zero."""
    return 1 - cosine_similarity(a, b)


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def valid_vector(a: Column) -> Column:
    """Not null, not empty, and all components finite."""
    return a.isNotNull() & (F.size(a) > 0) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(n == 0, 1, n)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Arrow lists of one length as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1)


def rounded(scores: np.ndarray, places: int = 6) -> np.ndarray:
    """Rounded as SQL does, halves away from zero."""
    return np.copysign(np.floor(np.abs(scores) * 10.0**places + 0.5) / 10.0**places, scores)


def _first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of each column's scores are its ``k`` largest; ties go to the smaller id."""
    if len(ids) <= k:
        return np.ones_like(scores, bool)
    keep = scores >= np.partition(scores, len(ids) - k, axis=0)[len(ids) - k]
    for j in np.flatnonzero(keep.sum(0) > k):  # ties at the last place
        own = np.flatnonzero(keep[:, j])
        keep[own[np.lexsort((ids[own], -scores[own, j]))[k:]], j] = False
    return keep


def block_search(
    queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, min_score: float | None = None, k: int | None = None, group: str | None = None, places: int | None = None
) -> DataFrame:
    """``(query_id, id, score)``: cosine of every query with every row, in blocks.

    The queries are a bounded set: they are collected, sent as a broadcast variable, and
    refused beyond QUERY_BYTES.  Each block of rows is multiplied with them and keeps
    what reaches ``min_score``, or per query its best ``k``; ties go to the smaller id.
    ``group``: a column of the rows, which comes too; the best ``k`` are then those of
    each of its values, so no more pairs than these leave a task.  ``places``: scores are rounded
    before they are compared.  Vectors of several sizes are compared each with those of its own; invalid ones are left out.
    """
    kind = dict(rows.dtypes)[group] if group else None
    good = queries.where(valid_vector(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    sizes, n = good.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)), F.count("*")).first()
    if not n:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double" + (f", {group} {kind}" if group else ""))
    if sizes * 8 > QUERY_BYTES:
        raise ValueError(f"{n} queries are more than one search takes: search them in parts")
    held = good.toArrow()
    by_size = {int(d): held.filter(pc.equal(pc.list_value_length(held["v"]), d)) for d in pc.unique(pc.list_value_length(held["v"])).to_pylist()}
    sent = queries.sparkSession.sparkContext.broadcast({d: (t["id"].to_numpy(), _unit(np.array(t["v"].to_pylist(), float))) for d, t in by_size.items()})

    def of_one_size(batches):
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v"))
            for d in pc.unique(lengths).to_pylist():
                yield *sent.value[d], batch.filter(pc.equal(lengths, d))

    def search(batches):
        for names, matrix, batch in of_one_size(batches):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            vectors = _unit(_matrix(batch.column("v")))
            codes = batch.column("g").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if group else np.zeros(len(ids), np.int64)
            some = max(1, CELLS // max(1, len(ids)))
            for first in range(0, len(names), some):  # so many queries at a time as keep the scores small
                scores = vectors @ matrix[first : first + some].T
                scores = scores if places is None else rounded(scores, places)
                keep = np.ones_like(scores, bool) if min_score is None else scores >= min_score
                if k is not None:
                    best = np.zeros_like(keep)
                    for code in np.unique(codes):
                        own = np.flatnonzero(codes == code)
                        best[own] = _first_k(scores[own], ids[own], k)
                    keep &= best
                i, j = np.nonzero(keep)
                columns = [pa.array(names[first + j]), pa.array(ids[i]), pa.array(scores[i, j])] + ([batch.column("g").take(pa.array(i))] if group else [])
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score", *([group] if group else [])])

    sized = rows.where(valid_vector(F.col(vector_col)) & F.size(vector_col).isin(sorted(by_size)))
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")] + ([F.col(group).alias("g")] if group else [])
    schema = "query_id long, id long, score double" + (f", {group} {kind}" if group else "")
    found = sized.select(*columns).mapInArrow(search, schema)
    return found if k is None else top_per_key(found, ["query_id", *([group] if group else [])], [F.desc("score"), F.asc("id")], k)


class Tile(NamedTuple):
    """What a self-join makes of a tile instead of its pairs: ``task`` takes the least cosine
    and gives a function of the tile's batches, whose rows bring the columns ``carry``.
    ``own``: only of tiles of one block with itself."""

    task: Callable
    schema: str
    carry: tuple[str, ...] = ()
    own: bool = False


def tile_pairs(held: pa.Table, min_score: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of a tile's pairs over a cosine, and their cosines, CELLS scores at a time: rows of
    ``side`` 0 with those of ``side`` 1, and rows of ``side`` 2, whose block meets itself,
    with each other.  Whether a pair reaches the cosine is the same wherever it is compared."""
    sides, ids = held["side"].to_numpy(), held["id"].to_numpy()
    unit = _unit(_matrix(held["v"].combine_chunks()))
    inner = bool((sides == 2).any())
    one, two = (np.flatnonzero(sides == k) for k in ((2, 2) if inner else (0, 1)))
    x, y, left, right = ids[one], ids[two], unit[one], unit[two]
    some = max(1, CELLS // max(1, len(y)))
    for first in range(0, len(x) if len(y) else 0, some):
        scores = left[first : first + some] @ right.T
        own = x[first : first + some, None]
        i, j = np.nonzero((scores >= min_score - 1e-9) & (own < y if inner else own != y))
        found = scores[i, j]
        close = np.flatnonzero(np.abs(found - min_score) < 1e-9)
        found[close] = (left[first + i[close]] * right[j[close]]).sum(1)
        keep = found >= min_score
        yield one[first + i[keep]], two[j[keep]], found[keep]


def _pairs_of_tile(min_score: float):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        ids = held["id"].to_numpy()
        for i, j, scores in tile_pairs(held, min_score):
            a, b = ids[i], ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(scores)], names=["id1", "id2", "score"])

    return multiply


PAIRS = Tile(_pairs_of_tile, "id1 long, id2 long, score double")


def block_join(rows: DataFrame, id_col: str, vector_col: str, min_score: float, key: str | None = None, tile: Tile = PAIRS) -> DataFrame:
    """``(id1, id2, score)`` with id1 < id2: all pairs of rows over a cosine, or with
    ``key`` all pairs of rows with one value of that column.

    Rows are dealt by the hash of their id into blocks of about BLOCK_ROWS, and each
    pair of blocks, a tile, is multiplied in a task, CELLS scores at a time, so a table of
    any size is taken and nothing comes to the driver.  A key has as many blocks as its own
    rows need.  Vectors of several sizes are compared each with those of its own; invalid
    ones are left out.
    """
    own = F.struct(F.col(key) if key else F.lit(0), F.size(vector_col))
    good = rows.where(valid_vector(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), *tile.carry, F.to_json(own).alias("key"))
    blocks = good.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = good.join(F.broadcast(blocks) if key is None else blocks, "key").withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    visits = F.array("home") if tile.own else F.sequence(F.lit(0), F.col("blocks") - 1)
    return _tiled(placed.withColumn("visits", visits), min_score, *([] if tile is PAIRS else [tile]))


def _tiled(placed: DataFrame, min_score: float, tile: Tile = PAIRS) -> DataFrame:
    """The pairs, or what ``tile`` makes of them, of rows (id, v, key, home, visits): ``home`` is a row's block and ``visits``
    the blocks that it meets, its own included; blocks of one key meet both ways."""
    visited = placed.select("id", "v", *tile.carry, "key", "home", F.explode("visits").alias("other"))
    side = F.when(F.col("home") == F.col("other"), 2).when(F.col("home") < F.col("other"), 0).otherwise(1)
    tiles = visited.select("key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), side.alias("side"), "id", "v", *tile.carry)
    return tiles.groupBy("key", "i", "j").applyInArrow(tile.task(min_score), tile.schema)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _reached(pivots: dict, widths: dict, least: float):
    """For each row the cells that can hold a row of at least ``least`` with it: the angle
    to the cell's pivot, less the cell's width, is no more than that of ``least``."""
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-6

    def visits(batches):
        for batch in batches:
            rows, cells = [], []
            sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                names, matrix = pivots[int(d)]
                near = _angles(_unit(_matrix(batch.column("v").take(pa.array(own)))), matrix) - np.array([widths.get(int(c), -np.inf) for c in names]) <= reach
                r, c = np.nonzero(near)
                rows.append(own[r])
                cells.append(np.asarray(names)[c])
            rows, cells = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (rows, cells))
            for first in range(0, max(1, len(rows)), VISITS):
                part = batch.take(pa.array(rows[first : first + VISITS]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[first : first + VISITS])], names=[*part.schema.names, "cell"])

    return visits


def cell_join(rows: DataFrame, id_col: str, vector_col: str, min_score: float, most_cells: int = 1_024, tile: Tile = PAIRS) -> DataFrame:
    """The rows of :func:`block_join` without a key, for similarities over 0.

    Rows lie in the cells of their nearest pivots, rows drawn by the hash of their id, at
    most ``most_cells`` for each size of vectors.  A row is compared only with cells whose
    pivot and width, by the triangle inequality of angles, leave a pair of ``min_score``
    possible, so what a row is copied to is what lies around it and not the whole table.
    Cells have some BLOCK_ROWS rows, crowded ones are split into blocks of as many, and no
    task holds more than two blocks.  Pairs are the same as without cells.
    """
    if min_score <= 0:
        return block_join(rows, id_col, vector_col, min_score, tile=tile)
    good = rows.where(valid_vector(F.col(vector_col)) & (norm(F.col(vector_col)) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), *tile.carry)
    counts = {r["d"]: r["n"] for r in good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.sparkSession.createDataFrame([], tile.schema)
    if max(counts.values()) <= BLOCK_ROWS:  # a block holds all: there is nothing to leave out
        return block_join(rows, id_col, vector_col, min_score, tile=tile)
    pivots: dict = {}
    for d, n in counts.items():
        drawn = good.where(F.size("v") == d).orderBy(F.xxhash64("id"), "id").limit(min(most_cells, -(-n // BLOCK_ROWS))).collect()
        first = sum(len(names) for names, _ in pivots.values())
        pivots[d] = (np.arange(first, first + len(drawn)), _unit(np.array([r["v"] for r in drawn], float)))

    def home(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            cell, angle = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                names, matrix = pivots[int(d)]
                far = _angles(_unit(_matrix(batch.column("v").take(pa.array(own)))), matrix)
                nearest = far.argmin(axis=1)
                cell[own], angle[own] = names[nearest], far[np.arange(len(own)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "own", "angle"])

    kinds = ", ".join(f"{c} {k}" for c, k in good.dtypes)
    homes = good.mapInArrow(home, f"{kinds}, own long, angle double")
    cells = homes.groupBy("own").agg(F.max("angle").alias("width"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).collect()  # as many as pivots
    widths = {r["own"]: r["width"] for r in cells}
    # Blocks are numbered through all cells.
    blocks = np.zeros(sum(len(names) for names, _ in pivots.values()), np.int64)
    for r in cells:
        blocks[r["own"]] = r["blocks"]
    of = lambda values, cell: F.get(F.array(*map(F.lit, values.tolist())), F.col(cell).cast("int"))
    start = np.cumsum(blocks) - blocks
    placed = homes.select(*good.columns, (of(start, "own") + F.pmod(F.xxhash64("id"), of(blocks, "own"))).alias("home"))
    if tile.own:
        return _tiled(placed.select("*", F.lit(0).alias("key"), F.array("home").alias("visits")), min_score, tile)
    coming = placed.mapInArrow(_reached(pivots, widths, min_score), f"{kinds}, home long, cell long")
    visits = F.sequence(of(start, "cell"), of(start + blocks, "cell") - 1)
    return _tiled(coming.select(*good.columns, F.lit(0).alias("key"), "home", visits.alias("visits")), min_score, *([] if tile is PAIRS else [tile]))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; ``rank`` names the column that numbers them."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= k)
    return out if rank else out.drop(name)
