"""A crawl as a stream: a frontier of urls, keyed by host, whose state holds each host's queue and its next turn.

A wave is what the one before links to, without what any wave held already; it is written as files that the stream reads,
so depths are those of a breadth-first walk whatever the hosts' speeds. ``transformWithState`` groups the urls by host. A
host's state is its queue, the urls it has seen and the time of its next turn; a host asks for one url at a time, and a
timer wakes it when its delay is over, so that no task waits. Different hosts are fetched side by side.

State and place in the source lie in the stream's checkpoint, results in a table beside it: a crawl that was stopped goes on
from there and asks for nothing again but what the batch that broke off had asked for.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.url import followed, hostname, page_links, registered_domain
from ..sources.state import checkpointed, stored

Fetch = Callable[[str], tuple[int, str | None, str | None]]
PAGES = "url string, depth int, host string, status_code int, content string, error string, asked_at double"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def http_fetch(url: str) -> tuple[int, str | None, str | None]:
    """SRC-08: (status, content, error) of a page over HTTP."""
    from ..sources.fetch import _get

    try:
        status, _, raw = _get(url, {"User-Agent": "Mozilla/5.0 (compatible; lodestrand)"}, 30.0)
        return status, raw.decode("utf-8", "replace"), None if status < 400 else f"status {status}"
    except Exception as x:  # noqa: BLE001  a failed request is a row
        return 0, None, f"{type(x).__name__}: {x}"


class HostQueue(StatefulProcessor):
    """STR-08, STR-05: fetches a host's urls in the order they came, ``delay`` seconds apart."""

    def __init__(self, fetch: Fetch, delay: float):
        self.fetch, self.delay = fetch, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "url string", "depth int")
        self.queue = handle.getMapState("queue", "place long", "url string, depth int")
        self.turn = handle.getValueState("turn", "first long, after long, next double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, after, turn = self.turn.get() if self.turn.exists() else (0, 0, 0.0)
        for r in rows:
            if not self.seen.containsKey((r.url,)):
                self.seen.updateValue((r.url,), (r.depth,))
                self.queue.updateValue((after,), (r.url, r.depth))
                after += 1
        return self.serve(key, first, after, turn)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.serve(key, *self.turn.get())

    def serve(self, key: tuple, first: int, after: int, turn: float) -> Iterator[Row]:
        while first < after and time.time() >= turn:
            url, depth = self.queue.getValue((first,))
            asked = time.time()
            status, content, error = self.fetch(url)
            self.queue.removeKey((first,))
            first, turn = first + 1, time.time() + self.delay
            yield Row(url=url, depth=depth, host=key[0], status_code=status, content=content, error=error, asked_at=asked)
        self.turn.update((first, after, turn))
        if first < after:
            self.handle.registerTimer(int(turn * 1000))

    def close(self) -> None:
        pass


def sitemap_seeds(seeds: DataFrame, fetch: Fetch, rounds: int = 10) -> DataFrame:
    """SRC-19, SET-04: (url) of the pages that the sitemaps of the seeds' hosts list, sitemaps of sitemaps included."""
    spark = seeds.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(u, fetch(u)[1]) for u in frame["url"]], columns=["url", "xml"])

    now = seeds.select(F.concat(F.regexp_extract("url", r"^[^:]+://[^/?#]+", 0), F.lit("/sitemap.xml")).alias("url")).distinct()
    done, pages = spark.createDataFrame([], "url string"), spark.createDataFrame([], "url string")
    for _ in range(rounds):
        got = stored(now.repartition("url").mapInPandas(run, "url string, xml string"), "sitemaps")
        listed = got.select(F.col("xml").contains("<sitemapindex").alias("index"), F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))).alias("loc"))
        listed = listed.select("index", F.replace(F.replace(F.replace("loc", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")).alias("url")).where("url != ''")
        done = done.unionByName(got.select("url"))
        pages = pages.unionByName(listed.where("not index").select("url"))
        now = stored(listed.where("index").select("url").distinct().join(done, "url", "left_anti"), "sitemaps")
        if now.isEmpty():
            break
    return pages.distinct()


def _clean(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def crawl_web(seeds: DataFrame, path: str, fetch: Fetch = http_fetch, max_depth: int = 1, max_pages: int | None = None, follow: tuple[str, ...] = (), exclude: tuple[str, ...] = (), same_domain: bool = False, use_sitemap: bool = False, delay: float = 0.0, poll: float = 0.1) -> DataFrame:
    """GRA-06: seeds (url) -> pages (url, depth from 1, host, status_code, content, error, asked_at), a row for each url asked.

    Links of pages that were got are followed up to max_depth: those that match a follow pattern (if there are any) and no
    exclude pattern, with same_domain only those on their page's own domain. A link is told apart without its fragment.
    max_pages ends the crawl; the wave it falls in is cut by url. use_sitemap adds what the seeds' sitemaps list to the
    seeds. delay: seconds between two requests to one host. path is the crawl's folder, shared by driver and executors: the
    same call again goes on where it ended. Null urls are left out; no seeds give no pages.
    """
    spark = seeds.sparkSession
    checkpointed(spark)
    frontier, pages = f"{path}/frontier", f"{path}/pages"

    def wave(k: int) -> DataFrame | None:
        """The k-th wave, if it is there in full."""
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{frontier}/wave={k}/_SUCCESS")
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return spark.read.schema("url string, depth int").parquet(f"{frontier}/wave={k}") if there else None

    def got() -> DataFrame:
        return spark.read.schema(f"{PAGES}, batch long").parquet(pages)

    def put(urls: DataFrame, k: int, room: int | None) -> int:
        rows = urls.select("url", F.lit(k).alias("depth"))
        rows = rows if room is None else rows.orderBy("url").limit(max(0, room))
        rows.write.mode("overwrite").parquet(f"{frontier}/wave={k}")
        return wave(k).count()

    if wave(1) is None:
        first = seeds.select(_clean(F.col("url")).alias("url"))
        first = first.unionByName(sitemap_seeds(first.where("url is not null"), fetch).select(_clean(F.col("url")).alias("url"))) if use_sitemap else first
        put(first.where("url is not null and url != ''").distinct(), 1, max_pages)
    spark.createDataFrame([], PAGES).write.mode("overwrite").parquet(f"{pages}/batch=-1")
    last = 1
    while wave(last + 1) is not None:
        last += 1
    total = sum(wave(k).count() for k in range(1, last + 1))

    fetched = {r["batch"]: r["count"] for r in got().groupBy("batch").count().collect()}

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{pages}/batch={number}")  # a batch that is run again replaces itself
        fetched[number] = spark.read.schema(PAGES).parquet(f"{pages}/batch={number}").count()

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        urls = spark.readStream.schema("url string, depth int, wave int").option("basePath", frontier).parquet(f"{frontier}/wave=*")
        served = urls.select(F.coalesce(hostname(F.col("url")), F.lit("")).alias("host"), "url", "depth").groupBy("host").transformWithState(HostQueue(fetch, delay), PAGES, "append", "processingTime")
        query = served.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/state").trigger(processingTime="0 seconds").start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    try:
        while True:
            while sum(list(fetched.values())) < total:
                if not query.isActive:
                    query.awaitTermination()
                    raise RuntimeError("the crawl's stream has ended before its frontier")
                time.sleep(poll)
            if last >= max_depth or (max_pages is not None and total >= max_pages):
                break
            mine = got().where((F.col("depth") == last) & F.col("error").isNull())
            links = mine.select("url", F.explode(page_links(F.col("content"), F.col("url"))).alias("link"))
            links = links.where(followed(F.col("link"), follow, exclude))
            links = links.where(registered_domain(F.col("url")) == registered_domain(F.col("link"))) if same_domain else links
            known = spark.read.schema("url string, depth int, wave int").option("basePath", frontier).parquet(*[f"{frontier}/wave={k}" for k in range(1, last + 1)])
            fresh = links.select(_clean(F.col("link")).alias("url")).where("url != ''").distinct().join(known.select("url"), "url", "left_anti")
            new = put(fresh, last + 1, None if max_pages is None else max_pages - total)
            if not new:
                break
            last, total = last + 1, total + new
    finally:
        query.stop()
    return got().drop("batch")
