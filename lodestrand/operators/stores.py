"""Keyed tables as stores: upserts, deletes, incremental state. A change is a new DataFrame; writing it is the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.state import stored


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], required: str | None = None) -> DataFrame:
    """SNK-01: rows of changes replace rows with their keys; the last change (by ``seq``) of a key wins.

    required: a column that may not be null in changes, or the write fails.
    """
    if required:
        changes = changes.withColumn(required, F.when(F.col(required).isNull(), F.raise_error(F.concat(F.lit("no value: "), F.concat_ws(",", *keys)))).otherwise(F.col(required)))
    names = [c for c in changes.columns if c != "seq"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*names), "seq").alias("_row")).select("_row.*")
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*table.columns))


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-04"""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def to_process(files: DataFrame, state: DataFrame) -> DataFrame:
    """JON-11: files (path, hash, mtime) that the state doesn't have with the same hash and time."""
    return files.join(state.select("path", "hash", "mtime"), ["path", "hash", "mtime"], "left_anti")


def batch_totals(results: DataFrame) -> DataFrame:
    """AGG-05: results (source, success, error, n_chunks, n_stored, seconds) to one row; counts are of successes."""
    good = F.col("success")
    return results.agg(
        F.count("*").alias("n_files"),
        F.count_if(good).alias("n_successful"),
        F.count_if(~good).alias("n_failed"),
        F.coalesce(F.sum(F.when(good, F.col("n_chunks"))), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.sum(F.when(good, F.col("n_stored"))), F.lit(0)).alias("n_stored"),
        F.coalesce(F.avg(F.when(good, F.col("seconds"))), F.lit(0.0)).alias("avg_seconds"),
    )


def metrics(samples: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """AGG-10"""
    return samples.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def rank_within(rows: DataFrame, group: list[str], order: list[Column], into: str = "rank") -> DataFrame:
    """WIN-02: rows with their rank from 1 within their group, without gathering a group in one task.

    Rows are dealt by ranges of (group, order), ranked in each range, and moved up by how many of their group lie in the
    ranges before. ``order`` should tell rows of a group apart. A null group is a group.
    """
    dealt = rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = stored(counts.withColumn("_before", before).drop("_n"), "shifts").select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), "_before")
    same = dealt["_part"] == shifts["_p"]
    for i, c in enumerate(group):
        same = same & dealt[c].eqNullSafe(shifts[f"_g{i}"])
    ranked = dealt.join(shifts, same).withColumn(into, F.row_number().over(W.partitionBy("_part", *group).orderBy(*order)) + F.col("_before"))
    return ranked.select(*rows.columns, F.col(into).cast("int").alias(into))


def by_ids(table: DataFrame, ids: list, key: str) -> DataFrame:
    """SRC-20: the rows with these ids."""
    return table.where(F.col(key).isin(list(ids)))


def by_document(table: DataFrame, document, doc: str, position: str, limit: int | None = None) -> DataFrame:
    """SRC-20, TOP-07: a document's rows in order."""
    found = table.where(F.col(doc) == document).orderBy(position)
    return found if limit is None else found.limit(limit)


def in_position_order(rows: DataFrame, doc: str, index: str, pages: str | None = None) -> DataFrame:
    """TOP-07: by document, then position: the chunk index, or the first page where there is none."""
    place = F.col(index) if pages is None else F.coalesce(F.col(index), F.try_element_at(pages, F.lit(1)), F.lit(0))
    return rows.orderBy(doc, place)


def row_counts(table: DataFrame, *by: str) -> DataFrame:
    """SRC-20"""
    return table.groupBy(*by).agg(F.count("*").alias("n"))


def cleared(table: DataFrame) -> DataFrame:
    """SNK-05: the table's columns without its rows."""
    return table.limit(0)


def embedded(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """FLT-16: rows that have a vector."""
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0))


def normalised_attributes(attributes: Column) -> Column:
    """FLT-18: a map of JSON texts without nulls; lists and objects stay JSON, strings lose their quotes."""
    bare = lambda v: F.when(v.rlike(r'(?s)^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    return F.transform_values(F.map_filter(attributes, lambda k, v: v.isNotNull() & (v != "null")), lambda k, v: bare(v))


def scoped(attributes: Column, keys: tuple[str, ...]) -> Column:
    """FLT-17: the listed keys of a map that have values."""
    return F.map_filter(attributes, lambda k, v: k.isin(*keys) & v.isNotNull())


def flat_payload(rows: DataFrame, plain: list[str], extra: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """SNK-03: the plain columns, lists as text, and the extra columns as one JSON text."""
    return rows.select(*plain, *[F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]")).alias(c) for c in lists], F.to_json(F.struct(*extra)).alias("extra_json"))


def upserted_in_batches(rows: DataFrame, write: Callable[[list[dict]], None], size: int = 100) -> DataFrame:
    """SNK-02: hands rows to an external store ``size`` at a time, from where they are; returns (n_rows, error) a batch.

    A batch that fails is reported, not raised; as a task can run twice, ``write`` must be an upsert by key.
    """

    def send(frames):
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size].to_dict("records")
                try:
                    write(part)
                    said = None
                except Exception as x:  # noqa: BLE001
                    said = f"{type(x).__name__}: {x}"
                yield pd.DataFrame({"n_rows": [len(part)], "error": pd.Series([said], dtype=object)})

    return rows.mapInPandas(send, "n_rows long, error string")


def updated_cache(state: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-13: the ingest cache with what was seen, the last (by ``seq``) of each key."""
    return upsert(state, seen, keys)


def embedding_batches(rows: DataFrame, group: str, order: str, tokens: str, most_tokens: int = 200_000, most_items: int = 100) -> DataFrame:
    """CHK-12: rows (group, order, ...) with ``batch``: closed when the next item would overflow it.

    A group's rows pass through one task in order, one Arrow batch at a time: only two sums are held, never the group.
    """
    import pyarrow as pa

    names = rows.columns
    at = [names.index(c) for c in (group, tokens)]

    def number(batches):
        now, batch_number, total, n = object(), 0, 0, 0
        for batch in batches:
            out = []
            for key, size in zip(*(batch.column(i).to_pylist() for i in at)):
                size = size or 0
                if key != now:
                    now, batch_number, total, n = key, 0, 0, 0
                elif n and (total + size > most_tokens or n >= most_items):
                    batch_number, total, n = batch_number + 1, 0, 0
                total, n = total + size, n + 1
                out.append(batch_number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*names, "batch"])

    from pyspark.sql.types import IntegerType, StructType

    return rows.repartition(group).sortWithinPartitions(group, order).mapInArrow(number, StructType(rows.schema.fields).add("batch", IntegerType()))
