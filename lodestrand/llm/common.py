"""Pieces that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); where it is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestrand-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.

    Adaptive execution decides how many files there are. They go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestrand-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hadoop).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Files of a table whose names may be numbered by a broadcast.
MAX_FILES = 100_000


def is_plain_scan(df: DataFrame) -> bool:
    """Whether df is a projection or selection of one table of Parquet files, without anything random."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic() or "_metadata" in (c.lower() for c in df.columns):
        return False
    node = plan
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    if node.getClass().getSimpleName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return node.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def numbered(df: DataFrame, rid: str, name: str = "rows") -> DataFrame:
    """df with a row id (long) that is the same whenever the rows are read again.

    The usual running number isn't: it holds for one evaluation only, as rows come in another order when a shuffle is
    repeated, and even a scan is cut anew when the number of cores changes. So a plain scan of Parquet files takes its
    rows' places in their files, and anything else is written, with its numbers, as a table in the shared folder.
    Whoever joins by row id must read both sides from what this returns.
    """
    if is_plain_scan(df):
        placed = df.select("*", F.col("_metadata.file_path").alias(file := free_name(df, "_file")), F.col("_metadata.row_index").alias(row := free_name(df, "_row")))
        files = [r[0] for r in placed.select(file).distinct().limit(MAX_FILES + 1).collect()]
        if len(files) <= MAX_FILES:
            numbers = df.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(sorted(files))], f"{file} string, _base long")
            return placed.join(F.broadcast(numbers), file).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col(row)).alias(rid))
    return materialize(df.withColumn(rid, F.monotonically_increasing_id()), name)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII texts take the cheaper built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def arrow_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to one batch (None: nothing to emit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def arrow_parts(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function over all batches of a partition."""
    return df.mapInArrow(work, schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
