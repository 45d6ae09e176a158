"""Incremental ingestion: state that grows with a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import tokens
from ..sources.state import checkpointed, scratch
from .seen import near_deduplicated  # noqa: F401
from .windows import added, collected, table_stream


def document_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    return table_stream(spark, sf_dir, "documents", maxFilesPerTrigger=files_per_trigger)


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02: the stream's seen-set of content hashes; the first row of each content passes."""
    docs = document_stream(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256))
    return collected(docs.dropDuplicates(["content_hash"]).select("doc_id", "content_hash"), "append")


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: document frequencies and totals, kept up to date as documents come."""
    # a file of one row group is one task: its texts are dealt to all cores, and each is taken apart once
    docs = document_stream(spark, sf_dir).select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    found = docs.select(tokens(F.col("text")).alias("found"))
    # each distinct term counts the document, each occurrence counts itself
    mark = lambda terms, first: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(first).alias("first")))
    rows = found.select(F.explode(F.concat(mark(F.array_distinct("found"), 1), mark(F.col("found"), 0))).alias("e"))
    return added(rows.select("e.term", F.col("e.first").cast("long").alias("df"), (1 - F.col("e.first")).cast("long").alias("total")), ("term",))


def ingest_stream(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str) -> None:
    """STR-01, STR-04: each micro-batch is chunked and added to the table at path, with its number (batch).

    The stream's checkpoint lies beside the rows and is the ingest cache: a later run takes up where this one ended. A
    batch that is run again replaces itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    checkpointed(stream.sparkSession)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/_ingest").trigger(availableNow=True).start().awaitTermination()


def mark_processed(summaries: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """STR-06: the summary table with its flag set for pages that were processed in full."""
    done = processed.select(key).distinct().withColumn("_done", F.lit(True))
    return summaries.join(done, key, "left").withColumn("is_fully_processed", F.col("is_fully_processed") | F.coalesce("_done", F.lit(False))).drop("_done")


def clear_seen(spark: SparkSession, path: str) -> None:
    """STR-02: forgets what a stream has seen, its place in the source included."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def progressive_query(engine, pages: DataFrame, queries: DataFrame, k: int = 10, mode: str = "hybrid", key: str = "doc_id", text: str = "text", size: int = 500) -> DataFrame:
    """STR-06: summaries are ingested first and searched; the pages found are then ingested whole, and these are searched.

    Which pages were processed in full is engine.processed (key), kept from query to query.
    """
    from ..functions.text import page_summary
    from ..sources.state import stored

    summaries = type(engine)(engine.spark, engine.chunker, engine.embedder, 0.0, False, **engine.chunk_options)
    summaries.ingest(pages.select(key, page_summary(F.col(text), size).alias(text)), key, text)
    found = stored(summaries.query(queries, k, mode).select(F.col("doc_id").alias(key)).distinct(), "found")
    done = getattr(engine, "processed", engine.spark.createDataFrame([], "doc_id string").withColumnRenamed("doc_id", key))
    fresh = found.join(done, key, "left_anti")
    engine.ingest(pages.join(fresh, pages[key].cast("string") == fresh[key], "left_semi"), key, text)
    engine.processed = stored(done.union(fresh), "processed")
    return engine.query(queries, k, mode)
