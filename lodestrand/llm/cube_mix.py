"""Mixing sources to target weights by balanced sampling (the cube method of Deville and Tille).

A source's target is a share of all words; a document then has ``target / source size`` expected copies. The whole part
is taken outright; the rest is an inclusion probability. The cube method turns these into 0 or 1: three documents at a
time move along the direction that keeps both their number and their total size (the null space of the two balancing
equations) until one of them settles. In a block all but two documents settle (the flight). One block of each source is
held back. It and the unsettled ones of the other blocks fly again, until a source has few left; these are settled with
ever smaller documents, so that the two that have to land, one constraint at a time, are small.

Blocks have a bounded number of documents whatever a source holds, so a hot source is many small groups. Draws depend
on the seed, the source and the documents only: a document's block and place in it follow from a hash of its id, source and
text, and, among rows equal in these, from a running number, which no one can tell apart. So reruns agree, however the rows
lie in files or come out of a shuffle.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_rows, free_name, materialize, numbered
from .positions import with_positions

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Documents of a block, on average.
BLOCK_ROWS = 2_000
_NEAR = 1e-9
#: Documents that are left when only the size is kept any more.
_FEW = 4


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", rid: str | None = None) -> DataFrame:
    """docs -> rid, doc_id, source, size (words; null text: 0), h (a hash of doc_id, source and text).

    rid names a column of row ids, if docs has one; else rows are numbered as they are read.
    """
    names = ["rid", "doc_id", "source", "h", "size"]
    kinds = [LongType(), docs.schema[doc_id].dataType, StringType(), LongType(), LongType()]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(t.as_buffer().to_pybytes().split()) if t.is_valid else 0 for t in batch.column(4)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64())], names)

    row = F.col(rid) if rid else F.monotonically_increasing_id()
    held = F.xxhash64(F.lit(1), doc_id, F.lit(2), source, F.lit(3), text)  # nulls are skipped, the marks between them aren't
    rows = docs.select(row.alias("rid"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), held.alias("h"), F.col(text).cast("binary").alias("t"))
    return arrow_rows(rows, work, StructType([StructField(*x) for x in zip(names, kinds)]))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``rank``, 0 for the first row in the order, without gathering all rows in one task."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranked")
    counts, before, offsets = dict(dealt.groupBy("part").count().collect()), 0, []
    for p in sorted(counts):
        offsets.append(F.when(F.col("part") == p, F.lit(before)))
        before += counts[p]
    return dealt.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + F.coalesce(*offsets, F.lit(0))).drop("part")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """sizes -> source, rank, source_size, n, target.

    Sources by code point, null last, get the weights in turn. They share all words by weight; a target stops at
    max_copies times its source, and the excess is shared again until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(ranked(sources, F.asc_nulls_last("source")).withColumn("weight", weight), "sources")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = max_copies * F.col("source_size")
    step, full = 0.0, -1
    first = sources.agg(F.sum("weight")).first()[0]
    if first:
        step = total / first
    while first:
        above = F.col("weight") * step >= cap
        now = sources.agg(F.sum(F.when(above, cap)).alias("given"), F.sum(F.when(~above, F.col("weight"))).alias("left"), F.count_if(above).alias("full")).first()
        if now["full"] == full or not now["left"]:
            break
        full, step = now["full"], (total - float(now["given"] or 0)) / now["left"]
    return sources.withColumn("target", F.least(F.col("weight") * step, cap).cast("double")).drop("weight")


def _draw(low: float, high: float, rng: random.Random) -> float:
    """A step of -low or +high that keeps the expectation."""
    return high if rng.random() * (low + high) < low else -low


def _move(units: list[list], rng: random.Random) -> list[list]:
    """Moves two or three units [probability, size, index] until one is 0 or 1; returns those that aren't."""
    if len(units) == 3:
        (_, a, _), (_, b, _), (_, c, _) = units
        along = (c - b, a - c, b - a)
        if not any(along):
            along = (1.0, -1.0, 0.0)
    else:
        along = (1.0, -1.0)
    top = max(map(abs, along))
    along = [x / top for x in along]
    high = min([(1 - u[0]) / x if x > 0 else u[0] / -x for u, x in zip(units, along) if x])
    low = min([u[0] / x if x > 0 else (1 - u[0]) / -x for u, x in zip(units, along) if x])
    step = _draw(low, high, rng)
    for u, x in zip(units, along):
        u[0] += step * x
        u[0] = 0.0 if u[0] < _NEAR else 1.0 if u[0] > 1 - _NEAR else u[0]
    return [u for u in units if 0 < u[0] < 1]


def fly(chances: np.ndarray, sizes: np.ndarray, rng: random.Random) -> np.ndarray:
    """The chances after a flight in random order: all but two are 0 or 1."""
    order = list(range(len(chances)))
    rng.shuffle(order)
    units = [[float(chances[i]), float(sizes[i]), i] for i in order]
    left: list[list] = []
    for u in units:
        if 0 < u[0] < 1:
            left.append(u)
            while len(left) == 3:
                left = _move(left, rng)
    out = np.empty(len(chances))
    out[order] = [u[0] for u in units]
    return out


def settle(chances: np.ndarray, sizes: np.ndarray, rng: random.Random) -> np.ndarray:
    """The chances after the last flight, all 0 or 1.

    Here the largest unsettled document moves against all smaller ones at once, in the direction of the null space
    that spreads the response evenly over number and size. When few are left, their number gives way, and the size is kept
    until one is left to land, as a rule a small one.
    """
    out = np.array(chances, float)
    order = sorted(range(len(out)), key=lambda i: (-sizes[i], rng.random()))
    left = np.array([i for i in order if 0 < out[i] < 1], int)
    while len(left) > 1:
        big, rest = sizes[left[0]], sizes[left[1:]]
        n, s1, s2 = len(rest), rest.sum(), (rest * rest).sum()
        if n < _FEW:
            response = -big * rest / s2 if s2 > 0 else np.zeros(n)
        elif (det := n * s2 - s1 * s1) > 1e-6 * s2:
            response = (s1 * big - s2 + (s1 - n * big) * rest) / det
        else:  # all smaller ones are of one size: their number gives way
            response = np.full(n, -big / s1 if s1 > 0 else -1.0 / n)
        along = np.concatenate([[1.0], response])
        p = out[left]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(along > 0, (1 - p) / along, np.where(along < 0, -p / along, np.inf))
            down = np.where(along > 0, p / along, np.where(along < 0, (p - 1) / along, np.inf))
        step = _draw(float(down.min()), float(up.min()), rng)
        p = p + step * along
        p[p < _NEAR], p[p > 1 - _NEAR] = 0.0, 1.0
        out[left] = p
        left = left[(p > 0) & (p < 1)]
    for i in left:
        out[i] = float(rng.random() < out[i])
    return out


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES, seed: int = 42, block_rows: int = BLOCK_ROWS, rid: str | None = None) -> DataFrame:
    """docs -> rid, doc_id, source, size, source_size, target, copies, taken (size times copies).

    A null source is a source. A document without words counts for balancing and takes no words. Each input row has
    one output row, repeated rows included; ties in size are settled by a hash of the row. Empty input gives no rows. Texts
    are read whole, and only their number of words and a hash go on. Other columns of docs are not read.
    """
    sizes = materialize(sized(docs, text, doc_id, source, rid), "sizes")
    # k tells rows apart that are equal in all that counts
    sizes = materialize(with_positions(sizes, "h", [F.asc("size")], "k", "_same", "alike").drop("_same"), "sizes")
    targets = source_targets(sizes, weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sizes.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    whole = F.floor(ratio + _NEAR)
    units = joined.withColumn("whole", whole).withColumn("chance", F.greatest(ratio - whole, F.lit(0.0)).cast("double"))
    columns = ["rid", "doc_id", "source", "size", "source_size", "target", "whole", "chance", "rank", "h", "k"]
    schema = units.select(*columns).schema
    settled, flights = None, 0
    left, most = units.select(*columns, "n"), None
    while True:
        blocks = F.ceil(F.col("n") / block_rows)
        # the running number of equal rows is part of the key, so that rows that fill a source are dealt out like any other
        dealt = left.withColumn("block", F.pmod(F.xxhash64("h", "k", F.lit(seed + flights)), blocks))
        most = left.agg(F.max("n")).first()[0] or 0
        land = most <= 2 * block_rows

        def one(group: pa.Table) -> pa.Table:
            group = group.sort_by([("h", "ascending"), ("k", "ascending")])
            rank, block = group["rank"][0].as_py(), group["block"][0].as_py()
            group = group.select(columns)
            if not land and block == 0:
                return group
            rng = random.Random(f"{seed}/{flights}/{rank}/{block}")
            chances = (settle if land else fly)(group["chance"].to_numpy(), group["size"].to_numpy().astype(float), rng)
            return group.set_column(columns.index("chance"), "chance", pa.array(chances))

        flown = materialize(dealt.groupBy("rank", "block").applyInArrow(one, schema), "flown")
        if land:
            settled = flown if settled is None else settled.unionByName(flown)
            break
        done, left = flown.where("chance in (0, 1)"), flown.where("chance not in (0, 1)")
        settled = done if settled is None else settled.unionByName(done)
        left = left.withColumn("n", F.count("*").over(W.partitionBy("rank"))) if left.count() <= block_rows else left.join(left.groupBy("rank").agg(F.count("*").alias("n")), "rank")
        flights += 1
    copies = F.col("whole") + F.col("chance").cast("long")
    return settled.select("rid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def apply_mix(docs: DataFrame, copies: str = "copies", **options) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns and how many copies it takes of each.

    A column of docs that has the new column's name gives way to it. Both sides of the join read their
    row ids from one numbered table (see common.numbered).
    """
    name = free_name(docs, "rid")
    kept = [c for c in docs.columns if c.lower() != copies.lower()]
    rows = numbered(docs, name)
    taken = mix(rows, rid=name, **options).where("copies > 0").select(F.col("rid").alias(name), F.col("copies").alias(copies))
    return rows.select(*[F.col(f"`{c}`") for c in kept], name).join(taken, name).drop(name)
