"""The corpus pipeline: documents in, a mixed and clean corpus out, one operator a stage.

All stages keep the columns of documents, whatever these are called, and every row stands for itself: rows that are wholly
equal are repeated rows, of which exact deduplication keeps one. An empty table passes through every stage. Texts are read
whole, one at a time, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.common import materialize
from lodestrand.llm.cube_mix import apply_mix
from lodestrand.llm.decontaminate import drop_leaks
from lodestrand.llm.exact_dedup import drop_exact_copies
from lodestrand.llm.langid import keep_identified
from lodestrand.llm.simhash_vptree import drop_near_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null texts, texts without a letter, and those whose best language
    scores under 0.5. What is learned comes from the table itself, from rows with a text and a lang; without any such row
    no language is known and all documents go. A null doc_id or source changes nothing."""
    return keep_identified(docs)


def deduplicate_exactly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the one with the largest doc_id stays; a null doc_id is smaller than any. Of
    rows that tie in this, too, one stays."""
    return drop_exact_copies(docs)


def deduplicate_nearly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays; a null doc_id is larger than any. Of rows that
    tie in this, too, the first stays. All texts without a word are near copies of each other."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; without items nothing goes."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix doesn't take go; ``copies`` says how often each of the others is taken. A null source is a source
    like any other. A column that is called copies gives way."""
    return apply_mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", deduplicate_exactly),
    ("near_dedup", deduplicate_nearly),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Fingerprints, learned languages and balanced draws have no SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again before the next, so a
    lost executor costs the work of one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
