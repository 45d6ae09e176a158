"""A search provider without a network: the same results for the same query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stub_results(queries: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """SRC-18: (key, position, url, title, description) with ``limit`` results a query."""
    slug = F.substring(F.replace(F.lower(F.col(text)), F.lit(" "), F.lit("-")), 1, 30)
    rows = queries.select(key, F.col(text).alias("query"), slug.alias("slug"), F.explode(F.sequence(F.lit(1), F.lit(limit))).alias("position"))
    number = F.col("position").cast("string")
    return rows.select(key, F.col("position").cast("long").alias("position"), F.concat(F.lit("https://example.com/"), "slug", F.lit("-"), number).alias("url"), F.concat(F.lit("Result "), number, F.lit(" for "), "query").alias("title"), F.concat(F.lit("Stub result for "), "query").alias("description"))


def stub_provider(queries: DataFrame, limit: int = 5) -> DataFrame:
    """SRC-16, SRC-18: the stub as a search provider: queries (round_number, query) -> results."""
    rows = stub_results(queries.withColumn("_key", F.struct("round_number", "query")), "_key", "query", limit)
    return rows.select("_key.*", "position", "url", "title", "description")
