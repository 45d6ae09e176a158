"""Queries over keyed tables that last: written in two loads and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import graph as G
from ..operators.keyed import KeyedTable
from ..sources.state import scratch
from . import graph_queries, more_queries  # noqa: F401  their SQL
from .registered import SQL, query, table


def _kept(spark, name: str, keys: list[str], schema: str) -> KeyedTable:
    return KeyedTable(spark, scratch(spark, name), keys, schema)


@query("snk01_kept_upserts", SQL["snk01_upsert"])
def snk01_kept_upserts(spark, sf):
    kept = _kept(spark, "parts", ["k"], "k long, v string")
    kept.upsert(table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")))
    kept.upsert(table(spark, sf, "customer").select((F.col("c_custkey") % 500).alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("seq")), order="seq")
    return kept.read()


@query("snk04_kept_deletes", SQL["snk04_delete"])
def snk04_kept_deletes(spark, sf):
    kept = _kept(spark, "parts", ["p_partkey"], "p_partkey long")
    kept.upsert(table(spark, sf, "part").select("p_partkey"))
    kept.delete(table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))
    return kept.read()


@query("snk06_kept_entities", SQL["snk06_entity_merge"])
def snk06_kept_entities(spark, sf):
    """Two loads of entities, merged by key as the second one comes."""
    rows = table(spark, sf, "orders")
    attributes = F.map_filter(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))), lambda k, v: v.isNotNull())
    made = rows.select(F.lit("Customer").alias("label"), F.col("o_custkey").cast("string").alias("id"), attributes.alias("attributes"), F.col("o_orderkey").alias("seq"))
    kept = _kept(spark, "entities", ["label", "id"], "label string, id string, attributes map<string,string>")
    middle = rows.agg(F.avg("o_orderkey")).first()[0] or 0
    for load in (made.where(F.col("seq") <= middle), made.where(F.col("seq") > middle)):
        kept.upsert(G.upsert_entities(load), merge=G.merged_entities)
    return kept.read().select("id", F.col("attributes")["status"].alias("status"), F.col("attributes")["priority"].alias("priority"))


@query("snk07_kept_relationships", SQL["snk07_relationship_merge"])
def snk07_kept_relationships(spark, sf):
    c, s = table(spark, sf, "customer").where("c_custkey % 10 != 3"), table(spark, sf, "supplier")
    nodes = _kept(spark, "nodes", ["id"], "id string")
    nodes.upsert(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")))
    nodes.upsert(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")))
    kept = _kept(spark, "edges", ["source", "relation", "target"], "source string, relation string, target string")
    rows = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("placed "), F.lower("o_orderstatus")).alias("relation"), F.concat(F.lit("s"), (F.col("o_orderkey") % 200).cast("string")).alias("target"), "o_orderkey")
    for k in (0, 1):
        kept.upsert(G.upsert_relationships(rows.where(F.col("o_orderkey") % 2 == k), nodes.read()))
    return kept.read()


@query("snk13_kept_cache", SQL["snk13_cache_update"])
def snk13_kept_cache(spark, sf):
    docs: DataFrame = table(spark, sf, "documents").select("doc_id", F.length("text").alias("mtime"))
    kept = _kept(spark, "cache", ["doc_id"], "doc_id long, mtime int")
    kept.upsert(docs)
    kept.upsert(docs.where("doc_id % 5 = 0").select("doc_id", F.lit(-1).alias("mtime")))
    return kept.read()
