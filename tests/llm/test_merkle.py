"""Leaves, roots and proofs against a tree built level by level in plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from lodestrand.llm.merkle import FIELDS, digest, fold, manifest, siblings

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, path int, g int, pos int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes):
    """The root, and each node's path of (left, right)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        at = [p // 8 for p in at]
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, _, leaf in sorted(groups[g])]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (known, doc_id, leaf), path in zip(sorted(groups[g]), trees[g][1]):
            out.append((doc_id if known else None, leaf, trees[g][0], sha("".join(a + b for a, b in path + top))))
    return sorted(out, key=repr), root


def check(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    found, root = manifest(docs, fields=("doc_id", "source", "lang", "n_chars", "text"), keep={"other": F.lit("x")})
    found = found.select("doc_id", "leaf", "subroot", digest(siblings(F.col("path"))), fold(F.col("leaf"), F.col("path")).alias("up"), fold(F.col("other"), F.col("path")).alias("off")).collect()
    want, want_root = plain(rows)
    assert root == want_root and all(r.up == root and r.off != root for r in found)
    assert sorted((tuple(r[:4]) for r in found), key=repr) == want


def row(i, lang, text="Abc"):
    return (i, "s", lang, i, text)


def test_several_rounds_hot_group_and_many_groups(spark):
    rng = random.Random(1)
    rows = [row(i if i % 50 else None, rng.choice(["en"] * 4 + [None, "fr", "", "é", "zz"]), rng.choice(["Abc", "x é", None, "", "long " * 500])) for i in range(5000)]
    check(spark, rows + [row(i, f"l{i % 530}") for i in range(700)] + rows[:40])


def test_edges_of_runs_and_blocks(spark):
    rows = []
    for n in (1, 2, 8, 9, 64, 65, 511, 512, 513):
        rows += [row(i, f"n{n}") for i in range(n)]
    check(spark, rows)


def test_one_document_one_group_and_none(spark):
    check(spark, [row(1, None)])
    check(spark, [row(i, "en") for i in range(3)])
    docs = spark.createDataFrame([], SCHEMA)
    found, root = manifest(docs)
    assert found.collect() == [] and root is None


def test_null_is_not_empty_and_lengths_tell_values_apart(spark):
    docs = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("1:a", "b"), ("-", "b")], "lang string, text string")
    found, _ = manifest(docs, fields=("lang", "text"), order="text")
    assert len({r.leaf for r in found.collect()}) == 6


def test_fields_of_the_manifest():
    assert FIELDS == ("doc_id", "source", "lang", "n_chars", "text")
