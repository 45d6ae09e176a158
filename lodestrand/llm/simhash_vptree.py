"""SimHash near-duplicates, paired exactly by vantage-point trees.

1. *Fingerprints.* A-Z are lower-cased, words are runs of other characters than space and \\x09-\\x0D, and every 4-word
   shingle (repeats included; fewer words: the whole sequence; none: fingerprint zero) gives an XXH64 hash, seed 42.
   A bit is 1 if set in over half of the hashes.
2. *Trees.* The 64 bits are cut into three thirds. Fingerprints at most 4 bits apart are at most 1 bit apart in some
   third, so three trees with a search radius of 1 find every pair that one tree with a radius of 4 finds, while far
   fewer points lie near a boundary: at a median split of a 21-bit third about a third of the points do, against two
   thirds at a split of 64 bits with radius 4. Each tree's upper levels come from a bounded sample of fingerprints
   (SAMPLE_ROWS); its leaves are the shards. Every fingerprint has one home shard, and it also visits each shard whose
   region, by the triangle inequality, may hold a point within the radius.
3. *Shards.* Within a shard the tree goes on, on arrays, down to small leaves; there full fingerprints are compared.
   Linked fingerprints are merged at once: a shard returns one row for each fingerprint that is linked, not all pairs.
4. *Components* over those rows (see components.py).

Identical fingerprints are collapsed to one point first, so copies cost nothing. The sample only places the
boundaries: results don't depend on it, and every row is indexed and every row is a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, free_name, materialize, numbered
from .components import connected_components

WORDS, MAX_BITS, SEED = 4, 4, 42
#: Rows that place the upper boundaries, at most.
SAMPLE_ROWS = 20_000
#: Fingerprints a shard should hold, its visitors included.
SHARD_ROWS = 100_000
#: Share of points near a boundary: at a median split of 21 bits, those at the two middle distances.
_NEAR = 0.336
#: Below so many points a leaf is compared outright.
LEAF = 48


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of one text, given in UTF-8."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxh64_intdigest(b" ".join(found), SEED)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends]
    hashes = np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rid: str | None = None) -> DataFrame:
    """docs -> one row per input row: rid, doc_id, fp (the fingerprint's bits as a long).

    rid names a column of row ids, if docs has one; else rows are numbered as they are read. Texts are read whole, one
    at a time; null and empty ones have fingerprint zero.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["rid", "doc_id", "fp"])

    row = F.col(rid) if rid else F.monotonically_increasing_id()
    rows = docs.select(row.alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return arrow_rows(rows, work, "rid long, doc_id long, fp long")


def thirds(max_bits: int) -> list[tuple[int, int]]:
    """(mask, radius) of each tree: some part of a pair within max_bits differs by its radius at most."""
    cuts = [(0, 21), (21, 42), (42, 64)]
    return [(((1 << b) - (1 << a)), max_bits // len(cuts)) for a, b in cuts]


def _split(points: np.ndarray, mask: np.uint64, turn: int) -> tuple[np.uint64, int] | None:
    """A vantage point and the median distance from it, or None if no split parts the points."""
    for k in range(8):
        vantage = points[(len(points) * (2 * k + 1) // 16 + turn * 7919) % len(points)] & mask
        far = np.bitwise_count((points & mask) ^ vantage)
        at = int(np.median(far))
        inner = np.count_nonzero(far <= at)
        if inner == len(points):
            at -= 1
            inner = np.count_nonzero(far <= at)
        if 0 < inner < len(points):
            return vantage, at
    return None


def build_tree(sample: np.ndarray, mask: int, levels: int) -> list:
    """The upper levels as nested [vantage, distance, inner, outer]; an empty list is a leaf."""
    if levels == 0 or len(sample) < 4 or not (found := _split(sample, np.uint64(mask), levels)):
        return []
    near = np.bitwise_count((sample & np.uint64(mask)) ^ found[0]) <= found[1]
    return [int(found[0]), found[1], build_tree(sample[near], mask, levels - 1), build_tree(sample[~near], mask, levels - 1)]


def route(tree: list, points: np.ndarray, mask: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf number, rows at home there, rows that only visit it) for each leaf that any point reaches."""
    todo, leaf = [(tree, np.arange(len(points)), np.zeros(0, np.int64), 1)], 1
    while todo:
        node, home, visit, leaf = todo.pop()
        if not node:
            if len(home) + len(visit):
                yield leaf, home, visit
            continue
        vantage, at = np.uint64(node[0]), node[1]
        dh, dv = (np.bitwise_count((points[x] & np.uint64(mask)) ^ vantage).astype(np.int64) for x in (home, visit))
        # A pair that parts here is found inside, where its outer point visits: the inner one needn't visit outside.
        inner_visit = np.concatenate([visit[dv <= at + radius], home[(dh > at) & (dh <= at + radius)]])
        todo += [(node[2], home[dh <= at], inner_visit, 2 * leaf), (node[3], home[dh > at], visit[dv > at - radius], 2 * leaf + 1)]


class Labels:
    """Merges linked points; a label is the least point linked so far."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.of[a], self.of[b]
            differ = la != lb
            if not differ.any():
                return
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            low = np.minimum(la, lb)
            np.minimum.at(self.of, la, low)
            np.minimum.at(self.of, lb, low)
            while (self.of != (up := self.of[self.of])).any():
                self.of = up


def link_within(points: np.ndarray, home: np.ndarray, visit: np.ndarray, mask: int, radius: int, max_bits: int, labels: Labels) -> None:
    """Links every home point to the home and visiting points within max_bits that the radius in mask can reach."""
    part, todo = np.uint64(mask), [(home, visit, 0)]
    while todo:
        home, visit, depth = todo.pop()
        if not len(home):
            continue
        found = _split(points[home], part, depth) if len(home) > LEAF and depth < 40 else None
        if found is None:
            others = np.concatenate([home, visit])
            for h in np.array_split(home, max(1, len(home) * len(others) // 2_000_000)):
                i, j = np.nonzero(np.bitwise_count(points[h][:, None] ^ points[others][None, :]) <= max_bits)
                labels.link(h[i], others[j])
            continue
        vantage, at = found
        dh, dv = (np.bitwise_count((points[x] & part) ^ vantage).astype(np.int64) for x in (home, visit))
        todo.append((home[dh <= at], np.concatenate([visit[dv <= at + radius], home[(dh > at) & (dh <= at + radius)]]), depth + 1))
        todo.append((home[dh > at], visit[dv > at - radius], depth + 1))


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """fps (fp: long, distinct; node: long, distinct) -> edges (a, b) between nodes that connect what links connect."""
    n = fps.count()
    # Every point has the same chance, and as many are drawn as the bound says, give or take a few.
    drawn = np.sort(fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(n, 1))) < sample_rows).select("fp").toArrow()["fp"].to_numpy()).view(np.uint64)
    levels = next((k for k in range(18) if n * (1 + ((1 + _NEAR) ** k - 1) / 2) / 2**k <= shard_rows), 18)
    trees = [(mask, radius, build_tree(drawn, mask, levels)) for mask, radius in thirds(max_bits)]

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, points = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        out = []
        for k, (mask, radius, tree) in enumerate(trees):
            for leaf, home, visit in route(tree, points, mask, radius):
                rows = np.concatenate([home, visit])
                out.append((np.full(len(rows), leaf * len(trees) + k), nodes[rows], points[rows].view(np.int64), np.arange(len(rows)) < len(home)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["shard", "node", "fp", "home"])

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        nodes, points, at_home = group["node"].to_numpy(), group["fp"].to_numpy(np.int64).view(np.uint64), group["home"].to_numpy(bool)
        mask, radius, _ = trees[int(group["shard"].iloc[0]) % len(trees)]
        labels = Labels(len(nodes))
        link_within(points, np.flatnonzero(at_home), np.flatnonzero(~at_home), mask, radius, max_bits, labels)
        linked = np.flatnonzero(labels.of != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[labels.of[linked]]})

    dealt = arrow_rows(fps.select("node", "fp"), deal, "shard long, node long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(pair, "a long, b long")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS, **options) -> DataFrame:
    """docs -> rid, doc_id, fp, component_id: the smallest doc_id reachable over links of max_bits or fewer.

    Also group, one fingerprint of the component, whatever the doc_ids are: the links are between fingerprints, so null
    and repeated doc_ids neither part nor join rows. Null texts and texts without words have fingerprint zero and are
    linked like any other. Repeated rows keep a row each. Empty input gives no rows. Null doc_ids are kept and never
    become a component's id unless all are null. Other columns of docs are not read, so their names can't clash. options
    go to fingerprints.
    """
    fps = materialize(fingerprints(docs, text, doc_id, **options), "fingerprints")
    points = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    parts = connected_components(link_fingerprints(points.select("fp", F.col("fp").alias("node")), max_bits))
    grouped = points.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    grouped = materialize(grouped, "grouped")
    ids = materialize(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "groupids")
    roots = grouped.select("fp", "group").join(ids, "group")
    return fps.join(roots, "fp").select("rid", "doc_id", "fp", "component_id", "group")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stand for their component: the one with the smallest doc_id (the first read, if repeated).

    Both sides of the join read their row ids from one numbered table (see common.numbered).
    """
    name = free_name(docs, "rid")
    rows = numbered(docs, name)
    groups = materialize(near_groups(rows, text, doc_id, max_bits, rid=name), "neargroups")
    kept = groups.groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "rid")).alias("first")).select(F.col("first.rid").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)
