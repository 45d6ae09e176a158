"""API-08, STR-09: spans and metrics of what the driver does, and progress of streams. Off unless switched on."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .operators.stores import metrics as summed


class Observer:
    """Counters, gauges, samples and spans; thread-safe, and nothing at all while it is off."""

    def __init__(self, on: bool = True):
        self.on = on
        self._lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock if hasattr(self, "_lock") else threading.Lock():
            self.counters: dict[str, float] = defaultdict(float)
            self.gauges: dict[str, float] = {}
            self.samples: list[tuple[str, float]] = []
            self.spans: list[dict] = []
            self._open: list[str] = []

    @staticmethod
    def key(name: str, labels: dict[str, str]) -> str:
        """FN-26: name{k=v,...} with sorted labels."""
        return name + ("{" + ",".join(f"{k}={v}" for k, v in sorted(labels.items())) + "}" if labels else "")

    def count(self, name: str, n: float = 1, **labels: str) -> None:
        if self.on:
            with self._lock:
                self.counters[self.key(name, labels)] += n

    def gauge(self, name: str, value: float, **labels: str) -> None:
        if self.on:
            with self._lock:
                self.gauges[self.key(name, labels)] = value

    def sample(self, name: str, value: float, **labels: str) -> None:
        if self.on:
            with self._lock:
                self.samples.append((self.key(name, labels), float(value)))

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[dict]:
        """Times a block; an error is noted and goes on. Its duration is a sample, too."""
        one = {"name": name, "parent": self._open[-1] if self._open else None, "attributes": attributes, "error": None}
        began = time.monotonic()
        if self.on:
            self._open.append(name)
        try:
            yield one
        except Exception as x:
            one["error"] = f"{type(x).__name__}: {x}"
            raise
        finally:
            one["seconds"] = time.monotonic() - began
            if self.on:
                self._open.pop()
                with self._lock:
                    self.spans.append(one)
                    self.samples.append((f"{name}_seconds", one["seconds"]))

    def summary(self, spark: SparkSession) -> DataFrame:
        """AGG-10 over the samples: key, n, total, least, most, mean."""
        return summed(spark.createDataFrame(self.samples, "key string, value double"))

    def text(self) -> str:
        """Counters and gauges, a line each."""
        with self._lock:
            return "\n".join(f"{k} {v:g}" for k, v in sorted({**self.counters, **self.gauges}.items()))


def observed(df: DataFrame, name: str, column: str | None = None) -> tuple[DataFrame, Callable[[], dict]]:
    """df with a count (and the nulls of a column) that Spark takes along the way; the second value reads it after a run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    parts = [F.count(F.lit(1)).alias("n_rows")] + ([F.count_if(F.col(column).isNull()).alias("n_null")] if column else [])
    return df.observe(seen, *parts), lambda: seen.get


class Progress(StreamingQueryListener):
    """Calls back with the rows of each micro-batch of every stream of the session."""

    def __init__(self, callback: Callable[[dict], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.callback({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.callback({"event": "progress", "id": str(event.progress.id), "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.callback({"event": "ended", "id": str(event.id), "error": event.exception})
