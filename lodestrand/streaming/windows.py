"""Event-time windows over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..sources.state import scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A table as a stream of files; the braces make its path a pattern, so that it may be one file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{sf_dir}/{{{name}}}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; watermarks need zoned times."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: Column, key: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by window and key.

    Late data: the watermark is the latest event time less ``late``. A row is dropped if its window had ended by the
    watermark that held a batch before its own; all other rows count, in whatever order they come.
    """
    return events.withWatermark("ts", late).groupBy(window.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")


def collected(stream: DataFrame, mode: str, keys: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its result, a table in the shared folder (or at path).

    append: rows are final. update: each batch appends the rows that it changed with its number, and the latest of each
    key counts; so a batch writes no more than it changed, nothing is held by the driver, and a batch that is run again
    after a failure replaces itself.
    """
    spark = stream.sparkSession
    base = path or scratch(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    if mode != "update" or not keys:
        raise ValueError("mode is append, or update with keys")

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    writer.foreachBatch(one).outputMode("update").start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/out")
    latest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_latest", latest).where("_latest = 1").drop("_latest", "batch")


def added(stream: DataFrame, keys: tuple[str, ...], path: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns the sums of its other columns by key, from a table in the shared folder (or
    at path).

    Each batch writes its own sums with its number, so no state is kept and a batch that is run again after a failure replaces
    itself; reading adds the batches up.
    """
    spark = stream.sparkSession
    base = path or scratch(spark, "stream")
    sums = lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in stream.columns if c not in keys])
    result = sums(stream).schema

    def one(batch: DataFrame, number: int) -> None:
        sums(batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
    return sums(spark.read.schema(result).parquet(f"{base}/out"))


def _whole(out: DataFrame) -> DataFrame:
    return out.select("key", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"))


def run_windows(spark: SparkSession, sf_dir: str, size: str, slide: str | None = None) -> DataFrame:
    """All windows, open ones included."""
    return _whole(collected(windowed(event_stream(spark, sf_dir), F.window("ts", size, slide), "event_type"), "update", ("key", "window_start")))


def run_sessions(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    """All sessions, open ones included.

    Sessions merge, so their rows can't be updated by key; they come out when they have ended (append), and those still
    open at the end of the stream are closed by a last file with one row long after, which is left out of the result.
    """
    base = scratch(spark, "stream")
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema

    def follow(source: str) -> DataFrame:
        events = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
        return windowed(events, F.session_window("ts", gap), "user_id")

    # The stream reads a folder of its own: the events, and, once they are done, the row that closes what is open.
    events = spark.read.parquet(path)
    events.write.parquet(f"{base}/in/events")
    collected(follow(f"{base}/in/*"), "append", path=base)
    last = events.agg(F.max("ts").alias("ts")).where("ts is not null").select(*[(F.col("ts") + F.expr("INTERVAL 3650 DAYS")).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    last.write.parquet(f"{base}/in/last")
    return _whole(collected(follow(f"{base}/in/*"), "append", path=base))
