"""Tables by key that last: files by key bucket, and a manifest that names the current ones.

A change writes the buckets that it touches anew, under a name of its own, and then the next manifest, a small file that
must not be there yet. So a change that fails leaves the table as it was; of two changes at once, the second finds the
manifest taken and is made again on top of the first; and readers see the version they started with. Old files stay until
``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.state import stored


class Conflict(RuntimeError):
    """Too many changes at once."""


class KeyedTable:
    """SNK-01, SNK-06, SNK-07, SNK-13: a table with at most one row a key, at a path that driver and executors share.

    The number of buckets is that of the first commit. Null keys are keys like any other.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType | str, buckets: int = 16, tries: int = 8):
        self.spark, self.path, self.keys, self.tries = spark, path.rstrip("/"), keys, tries
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.buckets = (self._manifest(self.version()) or {"buckets": buckets})["buckets"]

    # the manifest

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())

    def version(self) -> int:
        """The newest version that was written in full; 0 before the first."""
        for v in reversed(self.versions()):
            if self._manifest(v) is not None:
                return v
        return 0

    def _manifest(self, version: int) -> dict | None:
        if not version:
            return None
        try:
            return json.loads(self.spark.read.text(f"{self.path}/manifest/{version:020d}", wholetext=True).first()[0])
        except (TypeError, ValueError):  # empty or cut off: never committed
            return None

    def _commit(self, base: int, files: dict[str, str]) -> bool:
        """Writes the next manifest; False if another change was first."""
        number = max([base, *self.versions()]) + 1
        if self.version() != base:
            return False
        target, fs = self._fs(f"{self.path}/manifest/{number:020d}")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as x:
            if "exist" in str(x.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps({"buckets": self.buckets, "files": files}).encode()))
        out.close()
        return True

    # reading

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, as it is now or was at a version; buckets: only these."""
        held = self._manifest(self.version() if version is None else version)
        files = {} if held is None else {b: f for b, f in held["files"].items() if buckets is None or int(b) in buckets}
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in files.items()])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """SRC-20: the rows of some keys, from their buckets."""
        return self._matching(self.read(buckets=self._touched(keys)), keys, "left_semi")

    # changing

    def _bucket(self):
        return F.pmod(F.xxhash64(F.lit(0), *self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()]

    def _matching(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """left by whether right has its key; nulls match each other."""
        named = right.select(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(self.keys)]).distinct()
        on = [left[k].eqNullSafe(named[f"_{i}"]) for i, k in enumerate(self.keys)]
        return left.join(named, on, how)

    def _change(self, made: Callable[[int, list[int]], DataFrame], touched: list[int]) -> int:
        """made: from a version and the buckets touched to these buckets' new rows."""
        if not touched:
            return self.version()
        for _ in range(self.tries):
            base = self.version()
            name = uuid.uuid4().hex
            # a bucket's rows come from all tasks; a bucket of many rows is split into several files
            rows = made(base, touched).withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
            rows.write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
            held = dict((self._manifest(base) or {"files": {}})["files"])
            held = {b: f for b, f in held.items() if int(b) not in touched}
            folder, fs = self._fs(f"{self.path}/data/{name}")
            written = [f.getPath().getName() for f in fs.listStatus(folder)]
            held |= {w.removeprefix("bucket="): name for w in written if w.startswith("bucket=")}
            if self._commit(base, held):
                return base + 1
            self._fs(f"{self.path}/data/{name}")[1].delete(folder, True)
        raise Conflict(f"{self.path}: {self.tries} changes came first")

    def upsert(self, rows: DataFrame, order: str | None = None, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Adds rows, which replace those with their key; returns the version. The rows are read once.

        Of rows with one key, that with the highest order stays (without an order, several are an error). merge: another
        rule, from the old and the new rows of the touched buckets to what they become (see graph.upsert_entities).
        """
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]
        new = stored(rows.select(*columns, *([F.col(order).alias("_order")] if order else [])), "upsert")
        if merge is None:
            if order:
                new = new.groupBy(*self.keys).agg(F.max_by(F.struct(*[f.name for f in self.schema]), "_order").alias("_r")).select("_r.*")
            elif not new.groupBy(*self.keys).count().where("count > 1").isEmpty():
                raise ValueError(f"several rows with one key in {self.keys}")
        new = new.select(*self.schema.names)

        def made(base: int, touched: list[int]) -> DataFrame:
            old = self.read(base, touched)
            return merge(old, new).select(*columns) if merge else self._matching(old, new, "left_anti").unionByName(new)

        return self._change(made, self._touched(new))

    def delete(self, keys: DataFrame) -> int:
        """SNK-04: drops the rows of some keys."""
        gone = stored(keys.select(*self.keys), "delete")
        return self._change(lambda base, touched: self._matching(self.read(base, touched), gone, "left_anti"), self._touched(gone))

    def clear(self) -> int:
        """SNK-05"""
        for _ in range(self.tries):
            base = self.version()
            if self._commit(base, {}):
                return base + 1
        raise Conflict(f"{self.path}: {self.tries} changes came first")

    def vacuum(self) -> int:
        """Deletes the files that the current version doesn't name, and older manifests; returns how many folders went.
        Readers of older versions and changes under way must have ended."""
        now = self.version()
        held = set((self._manifest(now) or {"files": {}})["files"].values())
        folder, fs = self._fs(f"{self.path}/data")
        gone = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in held] if fs.exists(folder) else []
        gone_manifests = [self._fs(f"{self.path}/manifest/{v:020d}")[0] for v in self.versions() if v < now]
        for path in [*gone, *gone_manifests]:
            fs.delete(path, True)
        return len(gone)
