"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg's naming, on DataFrames).

Texts are cut into fixed-size blocks. Distinct blocks are sorted and numbered; then adjacent pairs of numbers are
numbered in the same way until each document is one integer. Two documents get the same integer if and only if their
texts are equal: numbers come from comparing values, never from trusting a hash.

Only built-in functions run here. How the data moves:

* Blocks are sorted by a pair of 64-bit keys. The text is shuffled once, and only its distinct blocks: ``collect_set``
  under the pair is combined map-side, and its size proves that each pair stands for one block. Should a pair stand for
  several, the second key is drawn anew.
* All else is integers. Hot blocks or pairs are combined before each shuffle, and joins back to rows are plain
  equi-joins that adaptive execution can split.
* A round's result is a table in the shared folder. The rounds number log2 of the longest document's blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ascii_lower, free_name, materialize, numbered

BLOCK_BYTES = 4096
#: Shards of a numbering; fixed, so that names don't depend on the cluster.
SHARDS = 65536
#: Draws of the second key before giving up; one is all but sure to do.
TRIES = 8


def _seeded(raw: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), raw)


def _blocks(docs: DataFrame, text: str, block: int, keep: dict[str, Column]) -> DataFrame:
    """The columns in keep, sha on the first block only, n blocks, pos, bytes."""
    texts = docs.select(*[v.alias(k) for k, v in keep.items()], ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    n = F.greatest(F.ceil(F.octet_length("t") / block), F.lit(1)).cast("int")
    cut = texts.select(*keep, F.unhex(F.sha2("t", 256)).alias("sha"), F.col("t").cast("binary").alias("raw"), n.alias("n"))
    cut = cut.select(*keep, "sha", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("raw"), i * block + 1, F.lit(block)))).alias("pos", "bytes"))
    return cut.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))


def _number(distinct: DataFrame, keys: list[str], shard: Column) -> DataFrame:
    """A name for each distinct row: its rank in the sorted shard, interleaved with the shard's number."""
    rank = F.dense_rank().over(W.partitionBy("shard").orderBy(*keys)).cast("long")
    return distinct.withColumn("shard", F.pmod(shard, F.lit(SHARDS))).select(*keys, ((rank - 1) * SHARDS + F.col("shard")).alias("name"))


def name_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, key: Callable[[Column], Column] = F.xxhash64, second: Callable[[Column, int], Column] = _seeded, rid: str | None = None) -> DataFrame:
    """docs -> one row per input row: rid (its row id), doc_id, sha (binary), level, name.

    (level, name) identifies the text after lower-casing A-Z: equal if and only if the texts are. Null counts as
    empty, and an empty text is one empty block. Repeated rows keep a row each; an empty table gives no rows. Very long
    texts are many blocks, in one row while they are cut. Other columns of docs are not read. rid names a column of row
    ids, if docs has one; else rows are numbered as they are read. key and second spread blocks; bad ones cost speed,
    never correctness.
    """
    for seed in range(TRIES):
        pair = lambda df: df.withColumn("h", key(F.col("bytes"))).withColumn("g", second(F.col("bytes"), seed)).drop("bytes")  # noqa: B023,E731
        ids = {"rid": F.col(rid) if rid else F.monotonically_increasing_id(), "doc_id": F.col(doc_id)}
        rows = materialize(pair(_blocks(docs, text, block_bytes, ids)), "blockkeys")
        held = _blocks(docs, text, block_bytes, {}).select(key(F.col("bytes")).alias("h"), second(F.col("bytes"), seed).alias("g"), "bytes")
        if held.groupBy("h", "g").agg(F.size(F.collect_set("bytes")).alias("k")).agg(F.coalesce(F.max("k"), F.lit(0))).first()[0] <= 1:
            break
    else:
        raise RuntimeError("no pair of keys tells all blocks apart")
    named = rows.join(_number(rows.select("h", "g").distinct(), ["h", "g"], F.xxhash64("h", "g")), ["h", "g"])
    now = materialize(named.select("rid", "doc_id", "sha", "n", "pos", "name"), "blocknames")
    heads = now.where("pos = 0").select("rid", "doc_id", "sha", "n", "name")
    done = heads.where("n = 1").select("rid", F.lit(0).alias("level"), "name")
    longest = now.agg(F.max("n")).first()[0] or 1
    now, level = now.where("n > 1").select("rid", "n", "pos", "name"), 0
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = now.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.max("n").alias("n"), side(0).alias("l"), F.coalesce(side(1), F.lit(-1)).alias("r"))
        numbered_pairs = _number(pairs.select("l", "r").distinct(), ["l", "r"], F.xxhash64("l", "r"))
        now = materialize(pairs.join(numbered_pairs, ["l", "r"]).select("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"), "pairnames")
        done = done.unionByName(now.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        now = now.where("n > 1")
    return heads.select("rid", "doc_id", "sha").join(done, "rid")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs -> rid, doc_id, keep_id, group_size, kept, text_sha256: of equal texts the row with the largest doc_id stays.

    Of repeated rows with that doc_id the one read last stays, so exactly one row of each group is kept. A null doc_id is
    smaller than any other. Nulls, empty and very long texts, empty tables and other columns: see name_documents.
    """
    named = materialize(name_documents(docs, text, doc_id, **options), "named")
    top = F.max(F.struct("doc_id", "rid"))
    # A table of its own: the join then starts from two shuffles, so that adaptive execution can split a hot group.
    groups = materialize(named.groupBy("level", "name").agg(top.alias("top"), F.count("*").alias("group_size")), "groups")
    out = named.join(groups, ["level", "name"])
    return out.select("rid", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns, whatever these are called.

    Both sides of the join read their row ids from one numbered table (see common.numbered).
    """
    rid = free_name(docs, "rid")
    rows = numbered(docs, rid)
    kept = exact_groups(rows, text, doc_id, rid=rid, **options).where("kept").select(F.col("rid").alias(rid))
    return rows.join(kept, rid, "left_semi").drop(rid)
