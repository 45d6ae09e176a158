"""Interval joins of extracted spans and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def overlapping(chunks: DataFrame, spans: DataFrame, doc: str, width: int = 1000) -> DataFrame:
    """JON-03: chunks (doc, chunk_index, start_char, end_char) left-joined with spans (doc, span_id, s, e) they overlap.

    Both sides name the buckets of ``width`` characters they touch, so the join is an equi-join on (doc, bucket) with a
    residual test; a pair counts in the first bucket the two share.
    """
    buckets = lambda a, b: F.sequence(F.floor(a / width), F.floor((b - 1) / width))
    c = chunks.where("end_char > start_char").withColumn("bucket", F.explode(buckets(F.col("start_char"), F.col("end_char"))))
    s = spans.where("s is not null and e is not null and e > s").withColumn("bucket", F.explode(buckets(F.col("s"), F.col("e"))))
    pairs = c.join(s, [doc, "bucket"]).where("not (e <= start_char or s >= end_char)").where(F.col("bucket") == F.floor(F.greatest("start_char", "s") / width))
    found = pairs.groupBy(doc, "chunk_index").agg(F.sort_array(F.collect_list("span_id")).alias("span_ids"))
    return chunks.join(found, [doc, "chunk_index"], "left").withColumn("span_ids", F.coalesce("span_ids", F.array().cast("array<long>")))
