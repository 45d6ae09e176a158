"""Entities, relationships and traversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import safe_label
from ..sources.state import cut, stored


def entity_id(doc: Column, index: Column, text: Column, start: Column, end: Column) -> Column:
    """GRA-01: the first 24 hex digits of a digest; null offsets read ``None``."""
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    return F.substring(F.sha2(F.concat_ws(":", doc.cast("string"), index.cast("string"), text, shown(start), shown(end)), 256), 1, 24)


def upsert_entities(entities: DataFrame, seq: str = "seq") -> DataFrame:
    """SNK-06: entities (label, id, attributes map, seq) merged by (label, id): of each key the last value wins."""
    rows = entities.withColumn("label", safe_label(F.col("label"), "Entity"))
    heads = rows.select("label", "id").distinct()
    last = rows.select("label", "id", seq, F.explode("attributes").alias("k", "v")).groupBy("label", "id", "k").agg(F.max_by("v", seq).alias("v"))
    merged = last.groupBy("label", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    return heads.join(merged, ["label", "id"], "left")


def merged_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-06: entities (label, id, attributes) of a table with those of a load, which come later."""
    both = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    return upsert_entities(both)


def upsert_relationships(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """SNK-07, JON-07: edges (source, relation, target) whose ends both exist, each once."""
    ids = entities.select("id").distinct()
    kept = edges.withColumn("relation", F.upper(safe_label(F.col("relation"), "RELATED_TO")))
    kept = kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.select("source", "relation", "target").distinct()


def resolve_labels(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """JON-08: subject and object of triples to ids: by exact label (the last entity wins), else by label without case
    (the first wins), else the label itself. entities: (label, id, seq)."""
    exact = entities.groupBy(F.col("label").alias("_k")).agg(F.max_by("id", "seq").alias("by_label"))
    folded = entities.groupBy(F.lower("label").alias("_kl")).agg(F.min_by("id", "seq").alias("by_folded"))
    out = triples
    for side in ("subject", "object"):
        out = out.join(exact, out[side] == exact["_k"], "left").drop("_k").join(folded, F.lower(F.col(side)) == folded["_kl"], "left").drop("_kl")
        out = out.withColumn(f"{side}_id", F.coalesce("by_label", "by_folded", side)).drop("by_label", "by_folded")
    return out


def neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """GRA-04, SET-05 at depth 1: (seed, relation, neighbor), out-edges and in-edges."""
    outward = edges.join(seeds, edges["source"] == seeds["seed"]).select("seed", "relation", F.col("target").alias("neighbor"))
    inward = edges.join(seeds, edges["target"] == seeds["seed"]).select("seed", "relation", F.col("source").alias("neighbor"))
    return outward.union(inward).distinct()


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """GRA-04: (seed, node, depth) by the shortest undirected path of at most ``depth`` edges, a wave at a time."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).union(edges.select("target", "source")).distinct()
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    wave = reached
    for d in range(1, depth + 1):
        wave = cut(wave.join(both, "node").select("seed", F.col("next").alias("node")).distinct().join(reached, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if wave.isEmpty():
            break
        reached = reached.unionByName(wave)
    return reached


def expand_users(follows: DataFrame, seeds: DataFrame, levels: int, users_per_level: int = 50, followers_per_user: int = 10) -> DataFrame:
    """GRA-05: users reached over follower edges (user, follower), bounded per user and per level: (user, level)."""
    from pyspark.sql import Window as W

    some = follows.withColumn("n", F.row_number().over(W.partitionBy("user").orderBy("follower"))).where(F.col("n") <= followers_per_user).drop("n")
    reached = seeds.select("user", F.lit(0).alias("level"))
    wave = reached
    for level in range(1, levels + 1):
        wave = cut(wave.join(some, "user").select(F.col("follower").alias("user")).distinct().join(reached, "user", "left_anti").orderBy("user").limit(users_per_level).withColumn("level", F.lit(level)))
        if wave.isEmpty():
            break
        reached = reached.unionByName(wave)
    return reached


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """SET-05: both directions of each edge, each once."""
    return edges.select(a, b).union(edges.select(b, a)).distinct()


def concatenated(*parts: DataFrame) -> DataFrame:
    """SET-10: all rows of all parts, by name; nothing is dropped."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def children_of(nodes: DataFrame, parent: str, node: str) -> DataFrame:
    """AGG-13: (parent, children in order); nodes without a parent aren't anyone's children."""
    return nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("parent")).agg(F.sort_array(F.collect_list(node)).alias("children"))


def with_authors(posts: DataFrame, users: DataFrame, author: str, name: str, default: str = "unknown") -> DataFrame:
    """JON-09: posts with the name of their author, or the default where the users don't have it."""
    return posts.join(users.select(author, F.col(name).alias("username")), author, "left").withColumn("username", F.coalesce("username", F.lit(default)))


#: What a missing verdict is called: a fixed value.
NO_VERDICT = "no verdict returned"


def with_verdicts(items: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """JON-10: items with passed and reason; one without a verdict has failed."""
    found = items.join(verdicts.select(*keys, "passed", "reason", F.lit(True).alias("_there")), keys, "left")
    reason = F.when(F.col("_there").isNull(), NO_VERDICT).otherwise(F.coalesce("reason", F.lit("")))
    return found.withColumns({"reason": reason, "passed": F.coalesce("passed", F.lit(False))}).drop("_there")


def rule_counts(verdicts: DataFrame, item: str, verdict: str, fail: str = "FAIL", unknown: str = "UNKNOWN") -> DataFrame:
    """AGG-14: how many rules an item fails and how many are open; it passes if it fails none."""
    return verdicts.groupBy(item).agg(F.count_if(F.col(verdict) == fail).alias("n_fail"), F.count_if(F.col(verdict) == unknown).alias("n_unknown")).withColumn("passed", F.col("n_fail") == 0)


def rejections(fails: DataFrame, item: str, rule: str, most: int = 3) -> DataFrame:
    """FN-33: (item, fails): the first rules that an item fails, joined by commas. Spark ranks before it shuffles."""
    from pyspark.sql import Window as W

    first = fails.withColumn("_k", F.row_number().over(W.partitionBy(item).orderBy(rule))).where(F.col("_k") <= most)
    return first.groupBy(item).agg(F.array_join(F.sort_array(F.collect_list(rule)).cast("array<string>"), ",").alias("fails"))


def path_edges(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = 500) -> DataFrame:
    """GRA-04 at depth d: (seed, source, relation, target): the edges of all undirected paths of 1 to ``depth`` edges from
    a seed, one row for each edge of each path, not distinct; a path doesn't use an edge twice.

    A wave holds the paths of one length, as lists of edge numbers. Their number can grow with each step as the degree
    does; limit (of rows, in no order) is the query's own, None for all.
    """
    rows = stored(edges.select("source", "relation", "target").withColumn("edge", F.monotonically_increasing_id()), "edges")
    steps = rows.select(F.col("source").alias("node"), F.col("target").alias("next"), "edge").union(rows.where("source != target").select("target", "source", "edge"))
    wave = seeds.select("seed", F.col("seed").alias("node"), F.array().cast("array<long>").alias("path"))
    found = None
    for _ in range(depth):
        wave = wave.join(steps, "node").where(~F.array_contains("path", F.col("edge"))).select("seed", F.col("next").alias("node"), F.array_append("path", F.col("edge")).alias("path"))
        wave = stored(wave, "paths")
        found = wave if found is None else found.unionByName(wave)
    out = found.select("seed", F.explode("path").alias("edge")).join(rows, "edge").select("seed", "source", "relation", "target")
    return out if limit is None else out.limit(limit)
