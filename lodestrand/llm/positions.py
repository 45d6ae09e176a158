"""Places of rows in an order within groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import free_name, materialize

#: Rows of a range, about; a table has at least as many ranges as the session has shuffle partitions.
RANGE_ROWS = 2_000_000
#: Bits that the running number leaves for rows of one partition.
_BITS = 33


def with_positions(rows: DataFrame, group: str, order: list[Column], pos: str = "pos", size: str = "group_size", name: str = "placed") -> DataFrame:
    """rows with ``pos`` (from 0, in the order given, within rows of one group) and ``size``, the group's rows.

    rows should be a table that was written, as it is read twice. One shuffle deals it out by ranges of (group, order) and
    each range is numbered as it is sorted; a row's place is its number less that of the range's first row of the group,
    plus what earlier ranges hold of the group. Rows that tie in all of the order follow each other as they are read, and
    a range may end between them, so that neither a hot group nor a hot key meets in one task. Nulls are a group.
    Empty input gives no rows.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)
    tie, at, part, first, before = (free_name(rows, x) for x in ("_tie", "_at", "_part", "_first", "_before"))
    by = [F.asc_nulls_first(group), *order, F.col(tie)]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = materialize(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()), name).withColumn(part, F.shiftright(at, _BITS))
    counts = dealt.groupBy(part, group).agg(F.min(at).alias(first), F.count("*").alias(size))
    whole = W.partitionBy(group)
    counts = counts.withColumn(before, F.sum(size).over(whole.orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(size)).withColumn(size, F.sum(size).over(whole))
    # as many rows as there are ranges and groups
    counts = materialize(counts, f"{name}-counts").withColumnsRenamed({part: f"{part}2", group: f"{group}2"})
    joined = dealt.join(counts, (F.col(part) == F.col(f"{part}2")) & F.col(group).eqNullSafe(F.col(f"{group}2")))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(at) - F.col(first) + F.col(before)).alias(pos), F.col(size))
