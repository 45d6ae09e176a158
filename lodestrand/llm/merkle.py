"""A Merkle manifest of a dataset, built by higher-order functions over blocks of leaves.

Each row is a leaf. The leaves of a group, in order, are the lowest level of a tree; every FANOUT consecutive nodes of a
level become one of the next until one remains, the group's root. The groups' roots are the leaves of one more tree, whose
root stands for the dataset.

FANOUT ** HEIGHT consecutive nodes make a block: one array, ordered, which ``aggregate`` collapses HEIGHT levels at a
time, each by ``transform`` over a ``sequence`` of ``slice``s. Only a block's root goes on, and blocks of roots are
collapsed in the same way: a round reads a 512th of the rows of the one before, and as many rounds as the levels of a
tree of fanout 512 do (four for 68 billion leaves). Then proofs go down: a block gets the path above its own root from the
block that holds that root, and puts its own levels before it. A path is a list of (left, right), the joined siblings on
either side, a level each; folding a leaf along it gives the root.

Text is read once, where it is hashed. Nothing is gathered by group: rows get their places by ranges (see positions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .positions import with_positions

FANOUT, HEIGHT = 8, 3
_BLOCK = FANOUT**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text, 256)


def leaf(values: list[Column]) -> Column:
    """The digest of a row's values, each with its length before it so that no two rows are written alike; null is '-'."""
    text = lambda v: v.cast("string")
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(text(v)).cast("string"), F.lit(":"), text(v)), F.lit("-")) for v in values]))


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _collapsed(level: Column) -> Column:
    """The level above one of a block."""
    last = F.floor((F.size(level) - 1) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(_joined(F.slice(level, i * FANOUT + 1, F.lit(FANOUT)))))


def _height(count: Column) -> Column:
    """How many levels a block is collapsed by, when its tree has this many nodes on the block's lowest level."""
    steps = F.when(count <= 1, 0)
    for k in range(1, HEIGHT):
        steps = steps.when(count <= FANOUT**k, k)
    return steps.otherwise(HEIGHT)


def _levels(nodes: Column, height: Column) -> Column:
    """All levels of a block, the lowest first."""
    steps = F.slice(F.array(*[F.lit(k) for k in range(HEIGHT)]), F.lit(1), height)
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.concat(done, F.array(_collapsed(F.element_at(done, -1)))))


def _path(levels: Column, at: Column) -> Column:
    """A node's siblings within its block, level by level."""

    def step(level: Column, k: Column) -> Column:
        here = F.floor(at / F.pow(F.lit(FANOUT), k)).cast("int")
        place = here % FANOUT
        left = F.slice(level, here - place + 1, place)
        return F.struct(_joined(left).alias("left"), _joined(F.slice(level, here + 2, F.lit(FANOUT - 1) - place)).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, level by level, from left to right."""
    return _joined(F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def _blocks(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """nodes (g, pos, m: the nodes of its tree on this level, node, *keep) -> g, block, m, rows, levels."""
    row = F.struct("pos", "node", *keep)
    blocks = nodes.groupBy("g", F.floor(F.col("pos") / _BLOCK).alias("block")).agg(F.max("m").alias("m"), F.sort_array(F.collect_list(row)).alias("rows"))
    return materialize(blocks.withColumn("levels", _levels(F.col("rows.node"), _height(F.col("m")))), "merkle-blocks")


def _climb(nodes: DataFrame, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, the lowest first, and each tree's root (g, root)."""
    rounds = [_blocks(nodes, keep)]
    while True:
        many = F.col("m") > _BLOCK
        top = F.element_at(F.element_at("levels", -1), 1)
        roots = rounds[-1].where(~many).select("g", top.alias("root"))
        for lower in rounds[:-1]:  # trees of fewer rounds
            roots = roots.unionByName(lower.where(~many).select("g", top.alias("root")))
        above = rounds[-1].where(many).select("g", F.col("block").alias("pos"), F.ceil(F.col("m") / _BLOCK).alias("m"), top.alias("node"))
        if above.isEmpty():
            return rounds, roots
        rounds.append(_blocks(above, []))


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The path above each block of the lowest round (g, block, above, root), given those above the trees' roots (g, above,
    root)."""
    known = None
    for blocks in reversed(rounds):
        # a tree ends in the round in which it is one block; in the rounds below, its blocks have been given their paths
        last = blocks.where(F.col("m") <= _BLOCK).select("g", "block").join(tops, "g")
        known = last if known is None else last.unionByName(known)
        if blocks is rounds[0]:
            return known
        inner = blocks.join(known, ["g", "block"]).select("g", "root", F.explode(F.transform("rows", lambda r: F.struct(r["pos"].alias("block"), F.concat(_path(F.col("levels"), (r["pos"] % _BLOCK).cast("int")), F.col("above")).alias("above")))).alias("x"))
        known = materialize(inner.select("g", "x.block", "x.above", "root"), "merkle-paths")
    raise AssertionError


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> tuple[DataFrame, str | None]:
    """docs -> (a row per document: the order column, the columns in keep, leaf, subroot, path), and the dataset's root.

    path is a list of (left, right): ``fold(leaf, path)`` is the root, ``siblings(path)`` what it is folded with. keep:
    further columns to carry along, computed where the text is read.
    Nulls: a null field is a value of its own, null groups are a group (the first), null order values come first. An empty
    text differs from a null one; long texts are hashed whole. Rows with equal order values are ordered by leaf; repeated
    rows are leaves of their own. A group of one row is its leaf. An empty table gives no rows and no root. Columns of docs
    that aren't named aren't read, so their names can't clash.
    """
    keep = keep or {}
    # a group's name that is never null and sorts as the groups do, null first
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = materialize(docs.select(named.alias("g"), F.col(order).alias("_order"), *[v.alias(f"_{k}") for k, v in keep.items()], leaf([F.col(c) for c in fields]).alias("node")), "merkle-leaves")
    carried = ["_order", *[f"_{k}" for k in keep]]
    placed = with_positions(leaves, "g", [F.asc_nulls_first("_order"), F.asc("node")], size="m", name="merkle-placed")
    rounds, subroots = _climb(placed, carried)
    subroots = materialize(subroots, "merkle-subroots")
    every = with_positions(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("node")), "g", [F.asc("name")], size="m", name="merkle-groups")
    top_rounds, roots = _climb(every, ["name"])
    found = roots.first()
    start = roots.select("g", F.lit(None).cast(_PATH).alias("above"), "root").withColumn("above", F.coalesce("above", F.array().cast(_PATH)))
    tops = _down(top_rounds, start).select(F.col("row.name").alias("g"), F.col("row.path").alias("above"), F.col("row.node").alias("root"))
    out = _down(rounds, materialize(tops, "merkle-tops"))
    return out.select(F.col("row._order").alias(order), *[F.col(f"row._{k}").alias(k) for k in keep], F.col("row.node").alias("leaf"), F.col("root").alias("subroot"), "row.path"), found and found["root"]


def _down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of the lowest blocks, each with its path to the very root: (row, root)."""
    blocks = rounds[0].join(_descend(rounds, tops), ["g", "block"])
    names = [f.name for f in rounds[0].schema["rows"].dataType.elementType.fields]
    row = lambda r: F.struct(*[r[c].alias(c) for c in names], F.concat(_path(F.col("levels"), (r["pos"] % _BLOCK).cast("int")), F.col("above")).alias("path"))
    return blocks.select("root", F.explode(F.transform("rows", row)).alias("row"))
