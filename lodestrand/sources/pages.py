"""Crawl results as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def as_documents(results: DataFrame, key: str) -> DataFrame:
    """SRC-22, SRC-23: crawl results (url, markdown, content, status_code, error) that succeeded, as documents.

    The text is the markdown, or else the content; a result with an error has failed whatever its status says.
    """
    good = results.where(F.col("error").isNull())
    return good.select(key, F.coalesce(F.nullif("markdown", F.lit("")), "content").alias("text"), F.col("url").alias("source"), F.lit("html").alias("file_type"), F.to_json(F.struct("status_code")).alias("extra"))
