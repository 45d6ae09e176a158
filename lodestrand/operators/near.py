"""Near duplicates of vectors: similar pairs (by hashing, or exact by angles to pivots) and who is kept of them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.vector import cosine, norm
from ..sources.state import stored

#: The chance to miss a pair at the threshold that decides how many hash tables there are; most pivots.
MISSED, PIVOTS = 1e-3, 1024
#: Rows of a side of a tile, least and most; slices of a cell, so that each row is dealt out that often; rows of a product.
TILE, MOST_TILE, SLICES, STEP = 1024, 131_072, 16, 512
#: What a row that is dealt out costs, in pairs that are compared (some 3 us against 3 ns).
ROW = 1000
#: Pairs that are passed on at once; what one costs that passes a bound, in dimensions of a product; rows that costs are drawn from.
PASSED, SURVIVOR, DRAWN = 65_536, 4000, 512
#: The greedy choice by prefixes: vectors of the first, how often longer each next is, ids that their ends are drawn from; pairs
#: for each vector above which it is taken, and vectors that their number is drawn from.
PREFIX, LONGER, ENDS, PAIRS, PAIRS_DRAWN = 4096, 4, 16_384, 16, 2048
#: Slack of bounds in floating point; what passes is compared again in double precision.
SLACK, ANGLE_SLACK = 1e-9, 1e-6


def matrix(lists: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n, flat = len(lists), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n and pc.min_max(pc.list_value_length(lists)).as_py() != {"min": len(flat) // n, "max": len(flat) // n}:
        raise ValueError("vectors of unequal length")
    return flat.reshape(n, len(flat) // n if n else 0)


def directions(lists: pa.Array) -> np.ndarray:
    rows = matrix(lists)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def tables_for(threshold: float, bits: int, missed: float = MISSED) -> int:
    """Tables that bring a pair at the threshold together in one of them but for a share of ``missed``."""
    met = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if met >= 1 - missed else math.ceil(math.log(missed) / math.log1p(-met))


def hashing_for(n: int, threshold: float, missed: float = MISSED, row: float = 1) -> tuple[int, int, float]:
    """(bits, tables, cost) of the cheapest hashing of n vectors: its rows, each as ``row`` pairs, and the unlike pairs that
    meet by chance."""
    costs = []
    for bits in range(2, 33):
        tables = tables_for(threshold, bits, missed)
        costs.append((n * tables * row + n * (n - 1) / 2 * tables * 2.0**-bits, bits, tables))
    cost, bits, tables = min(costs)
    return bits, tables, cost


@lru_cache(4)
def _planes(dims: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, dims, bits))


def hash_codes(vectors: np.ndarray, bits: int, tables: int, seed: int, first: int | None = None) -> np.ndarray:
    """A row of block numbers for each vector, one a table (or for the first tables): the sides of ``bits`` random hyperplanes."""
    planes = _planes(vectors.shape[1], bits, tables, seed)[:first]
    blocks = np.zeros((len(vectors), len(planes)), np.int64)
    for table, plane in enumerate(planes):
        blocks[:, table] = (table << bits) + (vectors @ plane >= 0) @ (1 << np.arange(bits))
    return blocks


def _bounding(one: np.ndarray, other: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Both sides with fewer dimensions, whose products are nowhere below those of the whole rows: the directions in which the
    rows differ most, and the length of what is left (Cauchy-Schwarz). As many as make products and survivors cheapest by a
    draw of rows; None if whole rows are cheaper."""
    dims = one.shape[1]
    if dims < 16 or len(one) * len(other) < 4 * DRAWN**2:
        return None
    turn = np.linalg.eigh((one.T @ one + other.T @ other).astype(np.float64))[1][:, ::-1].astype(np.float32)

    def bound(turned: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([turned[:, :n], np.linalg.norm(turned[:, n:], axis=1, keepdims=True)], axis=1)

    drawn = [side[:: -(-len(side) // DRAWN)] @ turn for side in (one, other)]
    costs = [(dims, dims)]
    for n in range(dims // 4, dims * 3 // 4, max(1, dims // 16)):
        costs.append((n + 1 + SURVIVOR * float((bound(drawn[0], n) @ bound(drawn[1], n).T >= least).mean()), n))
    n = min(costs)[1]
    return None if n == dims else (bound(one @ turn, n), bound(other @ turn, n))


def _alike(one: np.ndarray, other: np.ndarray, least: float, same: bool):
    """(i, j) of rows whose product is at least ``least``, many at a time; same: of one set of rows, i < j."""
    slack = _float_slack(one.shape[1])
    bounds = _bounding(one, other, least - slack)
    left, right, low = (one, other, least) if bounds is None else (*bounds, least - slack)
    product, passed, found, n = np.empty(STEP * STEP, np.result_type(left, right)), np.zeros(STEP * STEP + 8, bool), [], 0

    def whole():
        i, j = (np.concatenate(x) for x in zip(*found))
        if same:
            i, j = i[i < j], j[i < j]
        if bounds is not None:
            good = np.concatenate([np.einsum("ij,ij->i", one[i[k : k + PASSED]], other[j[k : k + PASSED]]) >= least for k in range(0, len(i), PASSED)] or [np.zeros(0, bool)])
            i, j = i[good], j[good]
        return i, j

    for at in range(0, len(left), STEP):
        for to in range(at if same else 0, len(right), STEP):
            x, y = left[at : at + STEP], right[to : to + STEP]
            size = len(x) * len(y)
            met = np.matmul(x, y.T, out=product[:size].reshape(len(x), len(y)))
            np.greater_equal(met, low, out=passed[:size].reshape(len(x), len(y)))
            passed[size : size + 8] = False
            eight = passed[: -(-size // 8) * 8]
            words = np.flatnonzero(eight.view(np.uint64))  # few are not zero
            if len(words):
                w, k = np.nonzero(eight.reshape(-1, 8)[words])
                i, j = np.divmod(words[w] * 8 + k, len(y))
                found.append((i + at, j + to))
                n += len(i)
            if n >= PASSED:
                yield whole()
                found, n = [], 0
    if found:
        yield whole()


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows by rows, summed in the order of functions.vector.cosine, so that both give the same numbers."""
    sums = np.zeros((3, len(x)))
    for d in range(x.shape[1]):
        a, b = x[:, d], y[:, d]
        sums += a * b, a * a, b * b
    return sums[0] / (np.sqrt(sums[1]) * np.sqrt(sums[2]))


def _similar(tile: pa.Table, one: np.ndarray, other: np.ndarray, same: bool, threshold: float):
    """(i, j, sim) of rows of one and other whose cosine is at least ``threshold``, places in them, many at a time."""
    vectors = matrix(tile.column("v"))
    units = np.empty(vectors.shape, np.float32)
    for at in range(0, len(units), 8192):
        units[at : at + 8192] = vectors[at : at + 8192] / np.linalg.norm(vectors[at : at + 8192], axis=1, keepdims=True)
    for x, y in _alike(units[one], units[one if same else other], threshold - _float_slack(units.shape[1]), same):
        for at in range(0, len(x), 8192):
            i, j = x[at : at + 8192], y[at : at + 8192]
            sim = _cosines(vectors[one[i]], vectors[(one if same else other)[j]])
            good = sim >= threshold
            yield i[good], j[good], sim[good]


def _ordered(a: pa.Array, b: pa.Array, **more: np.ndarray) -> pa.Table:
    first = pc.less(a, b)
    return pa.table({"a": pc.if_else(first, a, b), "b": pc.if_else(first, b, a), **more})


def _float_slack(dims: int) -> float:
    """How far a product of unit vectors may be off in single precision."""
    return 1e-7 * dims + 1e-6


def _dealt(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows (cell, own, id, v) in tiles (cell, i, j), left and right rows: slice i of a cell's own rows with slice j of its own
    and, from s on, of its guests. parts: (cell, s, g), slices of each cell; a cell that isn't there has one."""
    rows = rows.join(F.broadcast(parts), "cell", "left").withColumns({"s": F.coalesce("s", F.lit(1)), "g": F.coalesce("g", F.lit(0))})
    hashed = F.xxhash64("id")
    rows = rows.withColumn("_slice", F.when(F.col("own"), F.pmod(hashed, F.col("s"))).otherwise(F.col("s") + F.pmod(hashed, F.greatest("g", F.lit(1)))).cast("int"))
    span = lambda first, last: F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    at, zero = F.col("_slice"), F.lit(0)
    left = F.transform(F.when(F.col("own"), span(at, F.col("s") + F.col("g") - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.struct(at.alias("i"), j.alias("j"), F.lit(True).alias("left")))
    right = F.transform(span(zero, F.when(F.col("own"), at - 1).otherwise(F.col("s") - 1)), lambda i: F.struct(i.alias("i"), at.alias("j"), F.lit(False).alias("left")))
    return rows.select("cell", "id", "v", F.explode(F.concat(left, right)).alias("t")).select("cell", "t.i", "t.j", "t.left", "id", "v")


def _short(units: np.ndarray) -> np.ndarray:
    """Rows of bytes: a scale, how far off the row is (both single precision), and a signed byte for each dimension."""
    scale = np.maximum(np.abs(units).max(axis=1, keepdims=True) / 127, 1e-30).astype(np.float32)
    whole = np.rint(units / scale).astype(np.int8)
    off = np.linalg.norm(units - whole * scale.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    return np.concatenate([scale.view(np.uint8), off.view(np.uint8), whole.view(np.uint8)], axis=1)


def _from_short(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors that _short's rows stand for, and how far off a product of two may be."""
    scale, off = np.ascontiguousarray(rows[:, :8]).view(np.float32).T
    e = float(off.max(initial=0))
    return rows[:, 8:].view(np.int8) * scale[:, None], 2 * e + 3 * e * e


def _hashed(nodes: DataFrame, threshold: float, bits: int, tables: int, seed: int) -> DataFrame:
    """(a, b) that meet in a block and may be similar. A block's rows meet in one task, in tiles if they are many, and are
    compared there; a pair is passed on by the first block that it meets in. As a row goes to all its blocks, it goes with a
    byte for each dimension: it is filed by the codes of that, and products have as much slack as it is off."""
    kind = nodes.schema["id"].dataType.simpleString()

    def coded(batches):
        for batch in batches:
            short = _short(directions(batch.column(1)))
            ends = np.arange(len(short) + 1, dtype=np.int32) * short.shape[1]
            held = pa.Array.from_buffers(pa.binary(), len(short), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(short))])
            units = _from_short(short)[0]
            blocks = hash_codes(units.astype(np.float64), bits, tables, seed).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(units) + 1, dtype=np.int32) * tables, blocks.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), held, lists], ["id", "v", "cells"])

    keyed = stored(nodes.select("id", "v").mapInArrow(coded, f"id {kind}, v binary, cells array<int>"), "blocks")
    sizes = keyed.select(F.explode("cells").alias("cell")).groupBy("cell").count()
    large = stored(sizes.where(F.col("count") > SLICES * TILE).select("cell", F.ceil(F.col("count") / (SLICES * TILE)).cast("int").alias("s"), F.lit(0).alias("g")), "large")
    dealt = _dealt(keyed.select(F.explode("cells").alias("cell"), F.lit(True).alias("own"), "id", "v"), large)

    def compare(tile: pa.Table) -> pa.Table:
        ids, mine = tile.column("id").combine_chunks(), tile.column("left").to_numpy()
        units, off = _from_short(np.frombuffer(b"".join(tile.column("v").to_pylist()), np.uint8).reshape(tile.num_rows, -1))
        one, other = np.flatnonzero(mine), np.flatnonzero(~mine)
        table, same = tile.column("cell")[0].as_py() >> bits, tile.column("i")[0] == tile.column("j")[0]
        found = [pa.table({"a": ids.slice(0, 0), "b": ids.slice(0, 0)})]
        for x, y in _alike(units[one], units[one if same else other], threshold - _float_slack(units.shape[1]) - off, same):
            x, y = one[x], (one if same else other)[y]
            if table and len(x):
                rows, places = np.unique(np.concatenate([x, y]), return_inverse=True)
                codes = hash_codes(units[rows].astype(np.float64), bits, tables, seed, table)
                new = ~(codes[places[: len(x)]] == codes[places[len(x) :]]).any(axis=1)
                x, y = x[new], y[new]
            found.append(_ordered(ids.take(pa.array(x)), ids.take(pa.array(y))))
        return pa.concat_tables(found)

    return dealt.groupBy("cell", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def pivots_of(nodes: DataFrame, n: int) -> np.ndarray:
    """n vectors far from each other, out of 16 n that a hash of their ids picks (1,024 and 16,384 at most)."""
    drawn = [r.v for r in nodes.orderBy(F.xxhash64("id"), "id").limit(16 * n).select("v").collect()]
    pool = directions(pa.array(drawn, pa.list_(pa.float64())))
    chosen, nearest = [0], pool @ pool[0]
    while len(chosen) < min(n, len(pool)) and nearest.min() < 1 - SLACK:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, pool @ pool[chosen[-1]])
    return pool[chosen]


def angular_cells(nodes: DataFrame, threshold: float, n_pivots: int) -> DataFrame:
    """(cell, own, id, v): each vector in the cell of its nearest pivot (own), and as a guest in lower cells in reach."""
    return stored(_angular_cells(nodes, threshold, n_pivots)[0], "cells")


def _angular_cells(nodes: DataFrame, threshold: float, n_pivots: int) -> tuple[DataFrame, DataFrame]:
    """The rows of angular_cells, not yet made, and how many there are: (cell, n_own, n_guests).

    Angles are a metric. To come from one cell into another the way leads over the great circle halfway between their
    pivots, and it ends within the other cell's radius; where either is farther off than the threshold's angle there is
    no partner in that cell. A pair over a border meets once, in the lower one of its two cells.
    """
    pivots, reach = pivots_of(nodes, n_pivots), math.acos(max(-1.0, min(1.0, threshold))) + ANGLE_SLACK
    kind, vector = nodes.schema["id"].dataType.simpleString(), nodes.schema["v"].dataType.simpleString()

    def settle(batches):
        for batch in batches:
            near = directions(batch.column(1)) @ pivots.T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(1).astype(np.int32)), pa.array(np.arccos(np.clip(near.max(1), -1, 1)))], ["id", "v", "home", "angle"])

    homes = stored(nodes.select("id", "v").mapInArrow(settle, f"id {kind}, v {vector}, home int, angle double"), "homes")
    radius = np.full(len(pivots), -np.inf)
    for r in homes.groupBy("home").agg(F.max("angle").alias("angle")).collect():  # a row a pivot
        radius[r.home] = r.angle
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    apart[apart == 0] = np.inf

    def guests(batch: pa.RecordBatch) -> np.ndarray:
        home = batch.column(2).to_numpy()
        near = np.clip(directions(batch.column(1)) @ pivots.T, -1, 1)
        border = np.arcsin(np.clip((near[np.arange(len(near)), home][:, None] - near) / apart[home], -1, 1))
        return (border <= reach) & (np.arccos(near) <= radius + reach) & (np.arange(len(pivots)) < home[:, None])

    def visit(batches):
        for batch in batches:
            home = batch.column(2).to_numpy()
            row, cell = np.nonzero(guests(batch))
            row, cell = np.concatenate([np.arange(len(home)), row]), np.concatenate([home, cell]).astype(np.int32)
            own = np.arange(len(row)) < len(home)
            for at in range(0, len(row), 4096):
                part = pa.array(row[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + 4096]), pa.array(own[at : at + 4096]), batch.column(0).take(part), batch.column(1).take(part)], ["cell", "own", "id", "v"])

    def counted(batches):
        for batch in batches:
            home = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(np.bincount(home, minlength=len(pivots))), pa.array(guests(batch).sum(axis=0))], ["cell", "n_own", "n_guests"])

    sizes = homes.mapInArrow(counted, "cell int, n_own long, n_guests long").groupBy("cell").agg(F.sum("n_own").alias("n_own"), F.sum("n_guests").alias("n_guests"))
    return homes.mapInArrow(visit, f"cell int, own boolean, id {kind}, v {vector}"), sizes


#: The pairs of a cell whose cosines are computed.
_CANDIDATES = "n_own * (n_own - 1) div 2 + n_own * n_guests"


def cell_sizes(cells: DataFrame) -> DataFrame:
    """(cell, n_own, n_guests, n_candidates): candidates are the pairs whose cosines are computed. A row a pivot."""
    sizes = cells.groupBy("cell").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_guests"))
    return sizes.withColumn("n_candidates", F.expr(_CANDIDATES))


def _angular(nodes: DataFrame, threshold: float, n: int) -> DataFrame:
    """(a, b, sim). Cells are dealt out in tiles, so a cell that holds a third of all rows is many tasks. Where cells save less
    than their guests cost, all rows are one cell: each row is then dealt out SLICES times, and all pairs are compared."""
    tile = max(TILE, min(MOST_TILE, -(-n // SLICES)))
    cells = nodes.select(F.lit(0).alias("cell"), F.lit(True).alias("own"), "id", "v")
    parts = nodes.sparkSession.range(1).select(F.lit(0).alias("cell"), F.lit(-(-n // tile)).alias("s"), F.lit(0).alias("g"))
    if n >= 512:
        rows, sizes = _angular_cells(nodes, threshold, min(PIVOTS, n // 256))
        sizes = stored(sizes.withColumns({"s": F.ceil(F.col("n_own") / tile).cast("int"), "g": F.ceil(F.col("n_guests") / tile).cast("int")}), "sizes")
        cost = sizes.agg(F.sum(F.expr(_CANDIDATES) + ROW * (F.col("n_own") * (F.col("s") + F.col("g")) + F.col("n_guests") * F.col("s")))).first()[0]
        if cost < _all_pairs(n):
            cells, parts = rows, sizes.where("n_own > 0").select("cell", "s", "g")
    kind = nodes.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(batches)
        ids, mine = tile.column("id").combine_chunks(), tile.column("left").to_numpy()
        one, other = np.flatnonzero(mine), np.flatnonzero(~mine)
        same = tile.column("i")[0] == tile.column("j")[0]
        for i, j, sim in _similar(tile, one, other, same, threshold):  # a tile of copies has as many pairs as there can be
            yield from _ordered(ids.take(pa.array(one[i])), ids.take(pa.array((one if same else other)[j])), sim=sim).to_batches()

    return _dealt(cells, parts).groupBy("cell", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, sim double")


def _all_pairs(n: int) -> float:
    """What comparing all pairs costs, in pairs."""
    tile = max(TILE, min(MOST_TILE, -(-n // SLICES)))
    return n * (n - 1) / 2 + ROW * n * -(-n // tile)


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", method: str = "auto", missed: float = MISSED, seed: int = 7, copies: bool = False) -> DataFrame:
    """JON-05: pairs (a < b, sim) with a cosine of at least ``threshold``, which is above 0.

    hash: vectors meet on the same side of random hyperplanes. At an angle two meet in a table with probability
    (1 - angle / pi) ** bits; there are as many tables as it takes to miss at most a share of ``missed`` at the threshold,
    and bits as make rows and chance meetings cheapest. What meets is compared by products of matrices, in its block.
    exact: no pair is missed, at any threshold; cells around pivots, see angular_cells. Few pairs are compared where
    vectors lie in clusters; where they spread evenly over many dimensions each cell is in reach of each other, and all
    pairs are compared instead, by products of matrices in tiles (a row is dealt out 16 times up to 2,000,000 vectors).
    auto: hash where it is expected to cost under a fifth of comparing all pairs, else exact.

    Of equal vectors the least id stands for all: it is paired with each of its copies, and only it with others. With
    ``copies`` none stands for others, and all pairs are given. Null, empty and zero vectors and those with NaN pair with
    none; unequal lengths are an error.
    """
    if copies:
        every = stored(_slim(vectors, threshold, key, vector, method), "nodes")
        return _between(every, every.count(), threshold, method, missed, seed).where("a < b")
    slim, nodes = _nodes(vectors, threshold, key, vector, method)
    between = _between(nodes, nodes.count(), threshold, method, missed, seed)
    copies = slim.join(nodes.withColumnRenamed("id", "node"), "v")
    inside = copies.where("id != node").select(F.col("node").alias("a"), F.col("id").alias("b"), cosine(F.col("v"), F.col("v")).alias("sim"))
    return between.unionByName(inside)


def _slim(vectors: DataFrame, threshold: float, key: str, vector: str, method: str) -> DataFrame:
    """(id, v) of the vectors that can pair."""
    if not 0 < threshold <= 1 or method not in ("auto", "hash", "exact"):
        raise ValueError("threshold is above 0 and at most 1; method is auto, hash or exact")
    return vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where((F.size("v") > 0) & (norm(F.col("v")) > 0) & (norm(F.col("v")) < float("inf")))


def _nodes(vectors: DataFrame, threshold: float, key: str, vector: str, method: str) -> tuple[DataFrame, DataFrame]:
    """(id, v) of the vectors that can pair, and of each different one with its least id."""
    slim = _slim(vectors, threshold, key, vector, method)
    return slim, stored(slim.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "nodes")


def _is_hashed(n: int, threshold: float, method: str, missed: float) -> bool:
    return method == "hash" or (method == "auto" and hashing_for(n, threshold, missed, ROW)[2] < _all_pairs(n) / 5)


def _between(nodes: DataFrame, n: int, threshold: float, method: str, missed: float = MISSED, seed: int = 7) -> DataFrame:
    """(a, b, sim) of n different vectors."""
    if n < 2:
        return nodes.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("sim"))
    if not _is_hashed(n, threshold, method, missed):
        return _angular(nodes, threshold, n)
    bits, tables, _ = hashing_for(n, threshold, missed, ROW)
    a, b = nodes.select(F.col("id").alias("a"), F.col("v").alias("va")), nodes.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    near = _hashed(nodes, threshold, bits, tables, seed)
    return near.join(a, "a").join(b, "b").withColumn("sim", cosine(F.col("va"), F.col("vb"))).where(F.col("sim") >= threshold).select("a", "b", "sim")


def greedy_near_duplicates(nodes: DataFrame, pairs: DataFrame, key: str = "vec_id") -> DataFrame:
    """JON-05 as the order decides: a node is kept unless an earlier kept node is similar; duplicate_of is the first such.

    nodes: (key); pairs: (a < b). Open edges only are worked on. An edge says that b goes if a is kept (says 1) or if a is
    not (says 2); with both, or once one is known to hold (3), b goes. A node that hangs on one other alone is replaced by
    that one in all edges, so a chain halves with each round: 10,000 links take 15. The first open node is decided in each
    round at least.
    """
    edges = stored(pairs.where("a < b").select("a", "b").distinct().withColumn("says", F.lit(1)), "edges")
    gone = []
    while not edges.isEmpty():
        known = edges.groupBy("b").agg(F.count("*").alias("n"), F.max("says").alias("most"), F.min("a").alias("on"), F.min("says").alias("how"))
        known = stored(known, "known")
        going = known.where("most = 3").select("b")
        gone.append(going.withColumnRenamed("b", key))
        # what hangs on a node that goes now waits a round: no new edge may come to rest on it
        of = known.join(going.select(F.col("b").alias("on"), F.lit(True).alias("falls")), "on", "left")
        of = of.select(F.col("b").alias("a"), (F.col("most") == 3).alias("a_goes"), ((F.col("n") == 1) & (F.col("most") < 3) & F.col("falls").isNull()).alias("hangs"), "on", "how")
        met = edges.join(going, "b", "left_anti").join(of, "a", "left")
        kept, goes = F.col("a_goes").isNull(), F.coalesce("a_goes", F.lit(False))
        # what an edge says once a is known: it holds (3) or falls away (0)
        says = F.when(kept, F.when(F.col("says") == 1, 3).otherwise(0)).when(goes, F.when(F.col("says") == 2, 3).otherwise(0)).when(F.col("hangs") & (F.col("how") == 1), 3 - F.col("says")).otherwise(F.col("says"))
        moved = met.select(F.when(F.col("hangs"), F.col("on")).otherwise(F.col("a")).alias("a"), "b", says.alias("says")).where("says > 0")
        edges = stored(moved.groupBy("a", "b").agg(F.bit_or("says").cast("int").alias("says")), "edges")
    dropped = reduce(DataFrame.unionByName, gone, nodes.select(key).limit(0)).distinct().withColumn("_gone", F.lit(True))
    state = stored(nodes.select(key).join(dropped, key, "left").select(key, F.col("_gone").isNull().alias("kept")), "decided")
    by = pairs.join(state.where("kept").select(F.col(key).alias("a")), "a").groupBy(F.col("b").alias(key)).agg(F.min("a").alias("duplicate_of"))
    return state.join(by, key, "left").select(key, "kept", F.when(~F.col("kept"), F.col("duplicate_of")).alias("duplicate_of"))


def _pairs_of(nodes: DataFrame, n: int, threshold: float) -> float:
    """About how many pairs there are, by a draw of vectors that a hash of their ids picks."""
    drawn = [r.v for r in nodes.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, n // PAIRS_DRAWN))) == 0).select("v").collect()]
    if len(drawn) < 2:
        return 0.0
    units = directions(pa.array(drawn, pa.list_(pa.float64())))
    return float(np.triu(units @ units.T >= threshold, 1).mean()) * n * n


def _ends(nodes: DataFrame, n: int) -> list:
    """Ids that end about the first PREFIX nodes, LONGER times as many, and so on."""
    drawn = sorted(r.id for r in nodes.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // ENDS))) == 0).select("id").collect())
    sizes = [PREFIX * LONGER**k for k in range(64) if PREFIX * LONGER**k < n]
    return sorted({drawn[size * len(drawn) // n] for size in sizes}) if drawn else []


def _first_met(kept: DataFrame, n_kept: int, late: DataFrame, n_late: int, threshold: float) -> DataFrame:
    """(id, duplicate_of) of late vectors that are similar to kept ones, with the first of these: by products of matrices in
    tiles, which pass on a row a vector at most."""
    tile = max(TILE, min(MOST_TILE, -(-(n_kept + n_late) // (2 * SLICES))))
    s, g = (F.lit(-(-n // tile)) for n in (n_kept, n_late))
    hashed, kind = F.xxhash64("id"), kept.schema["id"].dataType.simpleString()
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = kept.select(F.lit(True).alias("left"), "id", "v", F.pmod(hashed, s).cast("int").alias("i"), to(g).alias("j"))
    right = late.select(F.lit(False).alias("left"), "id", "v", to(s).alias("i"), F.pmod(hashed, g).cast("int").alias("j"))

    def compare(tile: pa.Table) -> pa.Table:
        ids, mine = tile.column("id").combine_chunks(), tile.column("left").to_numpy()
        one, other = np.flatnonzero(mine), np.flatnonzero(~mine)
        one = one[pc.sort_indices(ids.take(pa.array(one))).to_numpy()]
        first = np.full(len(other), len(one))
        for i, j, _ in _similar(tile, one, other, False, threshold):
            np.minimum.at(first, j, i)
        met = first < len(one)
        return pa.table({"id": ids.take(pa.array(other[met])), "duplicate_of": ids.take(pa.array(one[first[met]]))})

    found = left.unionByName(right).groupBy("i", "j").applyInArrow(compare, f"id {kind}, duplicate_of {kind}")
    return found.groupBy("id").agg(F.min("duplicate_of").alias("duplicate_of"))


def _decided(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, kept, duplicate_of) of n different vectors by the exact way.

    If there are many pairs, not all are made: the first ids are decided, then all that is similar to one that is kept of
    them is left out, and so on with prefixes that grow. What is left of a prefix has few pairs, whatever the number of all,
    unless similar vectors follow each other in the order of ids; then it is taken apart in the same way.
    """
    if n <= PREFIX or _pairs_of(nodes, n, threshold) <= PAIRS * n or not (ends := _ends(nodes, n)):
        pairs = stored(_between(nodes, n, threshold, "exact").select("a", "b"), "pairs")
        return stored(greedy_near_duplicates(nodes.select("id"), pairs, "id"), "states")
    states = []
    for end in [*ends, None]:
        early = nodes if end is None else stored(nodes.where(F.col("id") < F.lit(end)), "early")
        n_early = early.count()
        if n_early:
            states.append(_decided(early, n_early, threshold))
        if end is None or n_early == n:
            break
        if n_early:
            kept = stored(early.join(states[-1].where("kept").select("id"), "id", "left_semi"), "kept")
            late = nodes.where(F.col("id") >= F.lit(end))
            met = stored(_first_met(kept, kept.count(), late, n - n_early, threshold), "met")
            states.append(met.select("id", F.lit(False).alias("kept"), "duplicate_of"))
            nodes = stored(late.join(met.select("id"), "id", "left_anti"), "left")
            n = nodes.count()
    return reduce(DataFrame.unionByName, states)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", method: str = "auto", missed: float = MISSED, seed: int = 7) -> DataFrame:
    """JON-05: key, kept, duplicate_of for all vectors, in the order of their keys; method, missed and seed as in similar_pairs.

    A copy of a vector is decided by its first one: a duplicate of it if it is kept, else of what that is a duplicate of.
    By hashing all pairs are made; by the exact way only as many as there are for vectors that no earlier one rules out.
    """
    _, nodes = _nodes(vectors, threshold, key, vector, method)
    n = nodes.count()
    if _is_hashed(n, threshold, method, missed):
        pairs = stored(_between(nodes, n, threshold, method, missed, seed).select("a", "b"), "pairs")
        decided = greedy_near_duplicates(nodes.select("id"), pairs, "id")
    else:
        decided = _decided(nodes, n, threshold)
    ids = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    members = ids.join(nodes.withColumnRenamed("id", "first"), "v", "left").select("id", F.coalesce("first", "id").alias("first"))
    out = members.join(decided.withColumnRenamed("id", "first"), "first", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
    return out.select(F.col("id").alias(key), (F.col("kept") & (F.col("id") == F.col("first"))).alias("kept"), F.when((F.col("id") != F.col("first")) & F.col("kept"), F.col("first")).otherwise(F.col("duplicate_of")).alias("duplicate_of"))
