"""Keyed tables over loads, failures, changes at once and versions."""

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import graph
from lodestrand.operators.keyed import Conflict, KeyedTable

SCHEMA = "id string, v long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def make(spark, path, **options):
    return KeyedTable(spark, str(path), ["id"], SCHEMA, **{"buckets": 4, **options})


def test_loads_deletes_versions_and_vacuum(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    assert rows(table.read()) == [] and table.version() == 0
    first = spark.createDataFrame([(f"k{i}", i) for i in range(40)] + [(None, -1)], SCHEMA)
    assert table.upsert(first) == 1
    assert table.upsert(spark.createDataFrame([("k3", 33), ("new", 1), (None, -2)], SCHEMA)) == 2
    want = {f"k{i}": i for i in range(40)} | {"k3": 33, "new": 1, None: -2}
    assert dict(rows(table.read())) == want and dict(rows(table.read(version=1)))["k3"] == 3
    again = KeyedTable(spark, str(tmp_path / "t"), ["id"], SCHEMA, buckets=99)  # another session
    assert again.buckets == 4 and dict(rows(again.read())) == want
    again.delete(spark.createDataFrame([("k5",), ("nowhere",), (None,)], "id string"))
    del want["k5"], want[None]
    assert dict(rows(table.read())) == want
    assert rows(table.lookup(spark.createDataFrame([("k3",), ("k5",)], "id string"))) == [("k3", 33)]
    assert table.vacuum() >= 1 and dict(rows(table.read())) == want and table.versions() == [3]
    table.clear()
    assert rows(table.read()) == [] and table.upsert(first.limit(0)) == table.version()


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = make(spark, tmp_path / "t", buckets=16)
    table.upsert(spark.createDataFrame([(f"k{i}", i) for i in range(200)], SCHEMA))
    before = table._manifest(1)["files"]
    table.upsert(spark.createDataFrame([("k7", 0)], SCHEMA))
    after = table._manifest(2)["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(after) == 16


def test_a_change_that_fails_leaves_the_table_and_orders_decide(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    table.upsert(spark.createDataFrame([("a", 1)], SCHEMA))
    with pytest.raises(Exception, match="gone"):
        table.upsert(spark.range(10).select(F.col("id").cast("string"), F.when(F.col("id") == 7, F.raise_error(F.lit("gone"))).otherwise(F.col("id")).alias("v")))
    (tmp_path / "t/manifest/00000000000000000002").write_text('{"buckets": 4, "fi')  # a driver that died while it wrote
    assert table.version() == 1 and rows(table.read()) == [("a", 1)]
    double = spark.createDataFrame([("a", 5, 1), ("a", 6, 3), ("a", 7, 2)], f"{SCHEMA}, seq int")
    with pytest.raises(ValueError):
        table.upsert(double)
    table.upsert(double, order="seq")
    assert rows(table.read()) == [("a", 6)]


def test_changes_at_once(spark, tmp_path):
    table, other = make(spark, tmp_path / "t"), make(spark, tmp_path / "t")
    table.upsert(spark.createDataFrame([("a", 1), ("b", 1)], SCHEMA))
    commit, done = table._commit, []

    def late(base, files):  # another change is committed while this one was being written
        if not done:
            done.append(other.upsert(spark.createDataFrame([("a", 2), ("c", 2)], SCHEMA)))
        return commit(base, files)

    table._commit = late
    table.upsert(spark.createDataFrame([("b", 3), ("d", 3)], SCHEMA))
    assert rows(table.read()) == [("a", 2), ("b", 3), ("c", 2), ("d", 3)]
    table._commit = lambda base, files: False
    with pytest.raises(Conflict):
        table.delete(spark.createDataFrame([("a",)], "id string"))
    assert len(rows(other.read())) == 4


def test_merged_entities(spark, tmp_path):
    schema = "label string, id string, attributes map<string,string>, seq long"
    table = KeyedTable(spark, str(tmp_path / "t"), ["label", "id"], "label string, id string, attributes map<string,string>")
    loads = [[("P", "1", {"a": "x", "b": "y"}), ("P", "2", {})], [("P", "1", {"b": "z", "c": "w"})]]
    for k, load in enumerate(loads):
        table.upsert(spark.createDataFrame([(*r, k) for r in load], schema).drop("seq"), merge=graph.merged_entities)
    want = graph.upsert_entities(spark.createDataFrame([(*r, k) for k, load in enumerate(loads) for r in load], schema))
    assert sorted((r.label, r.id, sorted((r.attributes or {}).items())) for r in table.read().collect()) == sorted((r.label, r.id, sorted((r.attributes or {}).items())) for r in want.collect())
