"""STR-02 with vectors: a seen-set in keyed state, filed by hash codes, so that a batch meets its own buckets only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.vector import norm
from ..operators.near import SLACK, _alike, _float_slack, greedy_near_duplicates, hash_codes, matrix, tables_for
from ..sources.state import checkpointed, scratch, stored
from .frontier import _ROCKS, _STORE

#: Vectors in one value of the state, at most.
CHUNK = 4096


class Bucket(StatefulProcessor):
    """The vectors of one block. Gives (name, at, other, other_at, row): earlier vectors of the block within the threshold,
    where the two meet in no block of an earlier table; and the rows themselves, which come in blocks below 0.

    Vectors come and are held many in a row, and are compared by products of matrices. Of equal vectors the first alone is
    held: it decides for the others, which are never kept.
    """

    def __init__(self, threshold: float, lifetime_ms: int | None, bits: int, tables: int, seed: int):
        self.threshold, self.lifetime, self.bits, self.tables, self.seed = threshold, lifetime_ms, bits, tables, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "at long, names array<string>, units binary", self.lifetime)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] < 0:
            for r in rows:
                yield Row(name=r.name, at=r.at, other=None, other_at=None, row=r.row)
            return
        names, places, parts, at = [], [], [], None
        for r in rows:
            names += r.names
            places += r.places
            parts.append(_vectors(r.units, len(r.names)))
            at = r.at
        old_names, old_ats, old_parts = [], [], []
        for then, held, units in self.held.get():
            old_names += held
            old_ats += [then] * len(held)
            old_parts.append(_vectors(units, len(held)))
        if len({part.shape[1] for part in parts + old_parts}) > 1:
            raise ValueError("vectors of unequal length")
        order = sorted(range(len(names)), key=lambda i: (places[i], names[i]))
        names, units = [names[i] for i in order], np.concatenate(parts)[order]
        old = np.concatenate(old_parts) if old_parts else units[:0]
        table, n = int(key[0]) >> self.bits, len(old)
        # every vector by its first row, the held ones before those of this batch
        first, which = np.unique(_bytes(np.concatenate([old, units])), return_index=True, return_inverse=True)[1:]
        mine = first[which.reshape(-1)[n:]]
        heads = np.flatnonzero(mine == np.arange(n, n + len(units)))
        copies = np.setdiff1d(np.arange(len(units)), heads)
        for later, to, earlier, same in ((units, None, old, False), (units[heads], heads, units[heads], True), (units[copies], copies, units[heads], False)):
            for x, y in self._near(later, earlier, table, same):
                x = x if to is None else to[x]
                if earlier is old:
                    for i, j in zip(x.tolist(), y.tolist()):
                        yield Row(name=names[i], at=at, other=old_names[j], other_at=old_ats[j], row=None)
                else:
                    for i, j in zip(x.tolist(), heads[y].tolist()):
                        if j < i:
                            yield Row(name=names[i], at=at, other=names[j], other_at=at, row=None)
        for k in range(0, len(heads), CHUNK):
            part = heads[k : k + CHUNK]
            self.held.appendValue((at, [names[i] for i in part], units[part].tobytes()))

    def _near(self, later: np.ndarray, earlier: np.ndarray, table: int, same: bool):
        """(i, j) of later and earlier rows within the threshold that meet in no earlier table."""
        if not len(later) or not len(earlier):
            return
        slack = _float_slack(later.shape[1])
        for x, y in _alike(later.astype(np.float32), earlier.astype(np.float32), self.threshold - slack, same):
            if same:
                x, y = y, x  # _alike gives the earlier row first
            good = np.einsum("ij,ij->i", later[x], earlier[y]) >= self.threshold - SLACK
            x, y = x[good], y[good]
            if table and len(x):
                (i, of_x), (j, of_y) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
                mine, theirs = (hash_codes(v, self.bits, self.tables, self.seed, table) for v in (later[i], earlier[j]))
                new = ~(mine[of_x.reshape(-1)] == theirs[of_y.reshape(-1)]).any(axis=1)
                x, y = x[new], y[new]
            yield x, y

    def close(self) -> None:
        pass


def _vectors(held: bytes, n: int) -> np.ndarray:
    return np.frombuffer(held, np.float64).reshape(n, -1)


def _bytes(rows: np.ndarray) -> np.ndarray:
    """Each row as one value; zeros of both signs are alike."""
    return np.ascontiguousarray(rows + 0.0).view(np.dtype((np.void, rows.shape[1] * 8))).reshape(-1)


def near_deduplicated(stream: DataFrame, threshold: float = 0.95, key: str = "doc_id", vector: str = "embedding", path: str | None = None, lifetime: float | None = None, bits: int = 12, missed: float = 1e-3, seed: int = 7) -> DataFrame:
    """STR-02: rows of the stream that aren't similar to a row that was kept before; returns the kept ones.

    Rows of a batch come in the order of their keys; of a batch's rows with one key but different vectors one is taken, by
    a hash. Rows with an equal key and vector are copies; with another vector a key is a new row. Each row is filed under
    the blocks of its hash codes (as many as it takes to miss a share of ``missed`` at the threshold); a batch reads and
    writes these blocks of the state only, and asks the folders of the batches that it met who was kept.
    Null, empty and zero vectors, those with NaN and null keys are kept as they come. lifetime: seconds after which a row
    is forgotten; None: never. State, place in the source and kept rows live at path; deleting the folder resets them
    (clear_seen). A batch that is run again replaces itself.
    """
    spark, schema = stream.sparkSession, stream.schema
    checkpointed(spark)
    base, tables = path or scratch(spark, "seen"), tables_for(threshold, bits, missed)
    kept_schema = StructType(list(schema.fields)).add("_name", "string").add("_at", "long")
    spark.createDataFrame([], StructType(kept_schema.fields[:-1])).write.mode("append").parquet(f"{base}/kept/_at=-1")
    kept = lambda: spark.read.schema(kept_schema).parquet(f"{base}/kept")

    length = norm(F.col(vector))
    sound = F.col(key).isNotNull() & (F.coalesce(F.size(vector), F.lit(0)) > 0) & F.coalesce((length > 0) & (length < float("inf")), F.lit(False))
    name = F.concat_ws("|", F.col(key).cast("string"), F.hex(F.xxhash64(vector)))
    rows = stream.select(name.alias("name"), F.col(key).alias("place"), F.unix_millis(F.current_timestamp()).alias("at"), F.when(sound, F.col(vector).cast("array<double>")).alias("unit"), F.struct(*schema.names).alias("row"))
    kind = rows.schema["place"].dataType.simpleString()
    filed_schema = f"block long, at long, names array<string>, places array<{kind}>, units binary"

    def coded(batches):
        for batch in batches:
            units = matrix(batch.column(3))
            units = units / np.linalg.norm(units, axis=1, keepdims=True)
            blocks = hash_codes(units, bits, tables, seed)
            for t in range(tables if len(units) else 0):  # a row for each block of the table
                order = np.argsort(blocks[:, t], kind="stable")
                own = blocks[order, t]
                ends = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)).astype(np.int32)
                name, place = (pa.ListArray.from_arrays(ends, batch.column(c).take(pa.array(order))) for c in (0, 1))
                held = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends * np.int32(units.shape[1] * 8)), pa.py_buffer(np.ascontiguousarray(units[order]))])
                yield pa.RecordBatch.from_arrays([pa.array(own[ends[:-1]]), batch.column(2).take(pa.array(order[ends[:-1]])), name, place, held], ["block", "at", "names", "places", "units"])

    # a row itself goes by a way of its own, once
    plain = rows.select((-1 - F.pmod(F.xxhash64("name"), F.lit(256))).alias("block"), "at", "name", "row")
    filed = rows.where("unit is not null").select("name", "place", "at", "unit").mapInArrow(coded, filed_schema).unionByName(plain, allowMissingColumns=True)
    given = StructType().add("name", "string").add("at", "long").add("other", "string").add("other_at", "long").add("row", schema)

    def one(batch: DataFrame, number: int) -> None:
        got = stored(batch, "met")
        head = got.select("at").first()
        if head is None:
            return
        unlike = got.where("row is not null").select("name", F.col("row.*"))
        good = unlike.where(sound)
        good = good.groupBy(key).agg(F.min_by(F.struct(*good.columns), "name").alias("_r")).select("_r.*")
        before = kept().select(F.col("_name").alias("other"), F.col("_at").alias("other_at"))
        known = got.where("other_at < at").join(before, ["other", "other_at"], "left_semi").select("name").distinct()
        left = stored(good.join(known, "name", "left_anti"), "left")
        ids = left.select("name", F.col(key).alias("k"))
        inside = got.where("other_at = at and other != name").select("name", "other").distinct()
        inside = inside.join(ids.withColumnRenamed("k", "b"), "name").join(ids.select(F.col("name").alias("other"), F.col("k").alias("a")), "other").select("a", "b")
        chosen = greedy_near_duplicates(left.select(key), stored(inside, "inside"), key).where("kept").select(key)
        out = left.join(chosen, key, "left_semi").unionByName(unlike.where(~sound))
        out.select(*schema.names, F.col("name").alias("_name")).write.mode("overwrite").parquet(f"{base}/kept/_at={head.at}")

    # without the second setting batches without rows go on for ever once a lifetime is set
    settings = {_STORE: _ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        met = filed.groupBy("block").transformWithState(Bucket(threshold, None if lifetime is None else int(lifetime * 1000), bits, tables, seed), given, "append", "none" if lifetime is None else "processingTime")
        query = met.writeStream.foreachBatch(one).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return kept().select(*schema.names)
