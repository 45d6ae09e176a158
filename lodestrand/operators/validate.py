"""Chunk validation: quality scores and exact duplicates; near duplicates are in near.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import alnum_count, strip
from ..functions.vector import cosine
from .near import greedy_near_duplicates, near_duplicates, similar_pairs  # noqa: F401  part of validation


#: What is said of a chunk: fixed values.
LOWER_START, NO_END, ODD_QUOTES = "Starts with lowercase letter (incomplete sentence)", "Does not end with proper punctuation", "Unbalanced double quotes"
PARENTHESES = "Unbalanced parentheses (%d open, %d close)"


def _count(text: str, one: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(one), F.lit("")))


def with_quality(chunks: DataFrame, text: str = "content", min_score: float = 0.3, min_density: float = 0.2, short: int = 50, long: int = 5000) -> DataFrame:
    """FLT-04: with length_score, density, complete, quality, passed, issues.

    Built in layers, so that each pass over the text stands in one place and is made once.
    """
    t, n = F.col(text), F.col("_size")
    rows = chunks.withColumns({"_size": F.length(t), "_alnum": alnum_count(t), "_bare": strip(t)})
    length = F.when(n < short, n / short * 0.5).when(n > long, F.greatest(F.lit(0.0), 1 - (n - long) / long)).otherwise(F.greatest(F.lit(0.5), 1 - F.abs(n - 1000) / 1000 * 0.5))
    rows = rows.withColumns(
        {
            "length_score": length,
            "density": F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("_alnum") / n / 0.75)),
            "_lower": F.left("_bare", F.lit(1)).rlike(r"\p{Ll}"),
            "_open_end": (F.col("_bare") != "") & ~F.right("_bare", F.lit(1)).isin(".", "!", "?", '"', "'"),
            "_odd": _count("_bare", '"') % 2 != 0,
            "_opened": _count("_bare", "("),
            "_closed": _count("_bare", ")"),
        }
    )
    uneven, poor = F.col("_opened") != F.col("_closed"), F.col("length_score") < 0.7
    rows = rows.withColumn("complete", ~(F.col("_lower") | F.col("_open_end") | F.col("_odd") | uneven))
    rows = rows.withColumn("quality", F.col("length_score") * 0.3 + F.col("density") * 0.4 + F.when(F.col("complete"), 1.0).otherwise(0.5) * 0.3)
    said = [
        (poor & (n < short), F.format_string(f"Chunk too short (%d < {short})", n)),
        (poor & (n >= short), F.format_string(f"Chunk too long (%d > {long})", n)),
        (F.col("density") < min_density, F.concat(F.lit("Low information density ("), F.format_number("density", 2), F.lit(")"))),
        (F.col("_lower"), F.lit(LOWER_START)),
        (F.col("_open_end"), F.lit(NO_END)),
        (F.col("_odd"), F.lit(ODD_QUOTES)),
        (uneven, F.format_string(PARENTHESES, F.col("_opened"), F.col("_closed"))),
    ]
    rows = rows.withColumns({"passed": (F.col("quality") >= min_score) & (F.col("density") >= min_density), "issues": F.array_compact(F.array(*[F.when(found, what) for found, what in said]))})
    return rows.drop("_size", "_alnum", "_bare", "_lower", "_open_end", "_odd", "_opened", "_closed")


def exact_duplicates(chunks: DataFrame, text: str = "content", order: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """JON-04: is_duplicate for all but the first of equal contents, in the given order.

    The first of each content is found by a grouped minimum, combined before the shuffle, so a content that a third of
    the chunks share doesn't meet in one task.
    """
    key = F.sha2(F.col(text), 256)
    first = chunks.groupBy(key.alias("content_hash")).agg(F.min(F.struct(*order)).alias("first"))
    return chunks.withColumn("content_hash", key).join(first, "content_hash").withColumn("is_duplicate", F.struct(*order) != F.col("first")).drop("first")


def new_contents(chunks: DataFrame, kept: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """JON-04 across loads: the chunks whose content no kept chunk has, but for kept ones that a chunk of this load replaces."""
    seen = kept.join(chunks.select(key), key, "left_anti").select(F.sha2(F.col(text), 256).alias("_hash")).distinct()
    return chunks.withColumn("_hash", F.sha2(F.col(text), 256)).join(seen, "_hash", "left_anti").drop("_hash")


def validation_counts(validated: DataFrame) -> DataFrame:
    """AGG-06"""
    return validated.agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.count_if("is_duplicate").alias("n_duplicates"))


def adjacent_similarity(vectors: DataFrame, group: list[str], order: str, vector: str = "embedding") -> DataFrame:
    """JON-12: similarity to the vector before, within a group; null for the first."""
    before = F.lag(vector).over(W.partitionBy(*group).orderBy(order))
    return vectors.withColumn("prev_sim", F.when(before.isNotNull(), cosine(before, F.col(vector))))
