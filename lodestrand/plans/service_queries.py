"""Queries over web services that serve the given tables (see served)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import services
from ..sources.state import scratch
from ..streaming.frontier import crawl_web
from .registered import query, table
from .served import served

_EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def service(spark: SparkSession, sf: str, source: str, **options: str) -> DataFrame:
    services.register(spark)
    return spark.read.format(source).options(base=f"{served(spark, sf).url}/2", **options)


@query("src25_paged_rows", "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' AND value > 5")
def src25_paged_rows(spark, sf):
    services.register(spark)
    reader = spark.read.format("paged").schema(_EVENT).options(url=f"{served(spark, sf).url}/rows/events", rows="result.items", total="result.total", offset="offset", range_rows="2000", page_size="500")
    rows = reader.option("pushed", json.dumps({"event_type": "type", "ts": ["from", "to"]})).load()
    return rows.where("event_type = 'click' AND ts >= TIMESTAMP '2024-01-03 00:00:00Z' AND ts < TIMESTAMP '2024-01-20 00:00:00Z' AND value > 5").select("event_id", "user_id", "value")


def feed(spark: SparkSession, sf: str, **options: str) -> DataFrame:
    """The events as a feed that grows."""
    services.register(spark)
    url = f"{served(spark, sf).url}/feed/events"
    return spark.readStream.format("paged").schema(_EVENT).options(**{"url": url, "head": f"{url}/head", "range_rows": "1500", "page_size": "500", **options}).load()


@query("src25_feed", "SELECT event_id, user_id, event_type, value FROM events")
def src25_feed(spark, sf):
    base = scratch(spark, "feed")
    rows = feed(spark, sf).select("event_id", "user_id", "event_type", "value")
    for _ in range(2):  # the second run goes on from the first one's token
        rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


@query("src13_recent_posts", """
    SELECT e.event_id::VARCHAR AS id, 'user' || e.user_id AS username, p.event_type || ' ' || p.event_id AS parent_text, 'user' || p.user_id AS parent_username
    FROM events e LEFT JOIN events p ON e.event_id % 3 <> 0 AND p.event_id = e.event_id // 2 WHERE e.event_type IN ('click', 'purchase') AND e.ts >= TIMESTAMP '2024-01-02' AND e.ts < TIMESTAMP '2024-01-30'""")
def src13_recent_posts(spark, sf):
    posts = service(spark, sf, "posts", queries='["click", "purchase"]', windows="4", page_size="100").load()
    return posts.where("created_at >= TIMESTAMP '2024-01-02 00:00:00Z' AND created_at < TIMESTAMP '2024-01-30 00:00:00Z'").select("id", "username", "parent_text", "parent_username")


def _user_names(spark: SparkSession, sf: str) -> str:
    """A list of what to ask for is an option, so it is the caller's to keep short: here 20 users."""
    users = table(spark, sf, "events").select("user_id").distinct().orderBy("user_id").limit(20).collect()
    return json.dumps([f"user{r.user_id}" for r in users])


@query("src14_timelines", "SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 20) GROUP BY 1")
def src14_timelines(spark, sf):
    posts = service(spark, sf, "posts", kind="timeline", queries=_user_names(spark, sf), page_size="100").load()
    return posts.groupBy(F.col("author_id").cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first"), F.max(F.col("id").cast("long")).alias("last"))


@query("src14_profiles", "SELECT DISTINCT user_id, 'User ' || user_id AS name, user_id * 2 AS followers FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 20)")
def src14_profiles(spark, sf):
    return service(spark, sf, "posts", kind="profile", queries=_user_names(spark, sf)).load().select(F.col("id").cast("long").alias("user_id"), "name", "followers")


@query("src15_departures", """
    SELECT 'F' || event_id AS callsign, floor(epoch(ts))::BIGINT AS first_seen, 'ED' || upper(event_type[1:2]) AS departure FROM events WHERE event_type IN ('click', 'view') AND date_trunc('second', ts) >= TIMESTAMP '2024-01-05' AND date_trunc('second', ts) < TIMESTAMP '2024-01-19'""")
def src15_departures(spark, sf):
    flights = service(spark, sf, "flights", queries='["departures:edcl", "departures:EDVI"]').option("base", served(spark, sf).url).load()
    kept = flights.where("first_seen >= TIMESTAMP '2024-01-05 00:00:00Z' AND first_seen < TIMESTAMP '2024-01-19 00:00:00Z'")
    return kept.select("callsign", F.unix_timestamp("first_seen").alias("first_seen"), "departure")


@query("src17_search_results", r"""
    WITH p AS (SELECT *, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), h AS (SELECT host FROM p GROUP BY host ORDER BY count(*) DESC, host LIMIT 10)
    SELECT s.name || ' ' || host AS query, row_number() OVER (PARTITION BY s.name, host ORDER BY page_id) AS position, url, 'page ' || page_id AS title FROM p JOIN h USING (host), (VALUES ('searxng'), ('firecrawl')) s(name)
    WHERE page_id % 5 <> 0 AND url LIKE '%://' || host || '/%' QUALIFY position <= 5""")
def src17_search_results(spark, sf):
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"))
    hosts = [r.host for r in pages.groupBy("host").count().orderBy(F.desc("count"), "host").limit(10).collect()]
    out = [service(spark, sf, "web_search", provider=name, queries=json.dumps(hosts), limit="5").option("base", served(spark, sf).url).load().select(F.concat(F.lit(f"{name} "), "query").alias("query"), "position", "url", "title") for name in ("searxng", "firecrawl")]
    return out[0].unionByName(out[1])


def web_fetch(base: str):
    """A fetcher of the served pages, by their own urls."""

    def fetch(url: str) -> tuple[int, str | None, str | None]:
        answer = services.Client().get(f"{base}/web", {"url": url})
        return (404, None, "status 404") if answer is None else (200, answer["html"], None)

    return fetch


@query("gra06_fetched_crawl", """
    WITH RECURSIVE p AS (SELECT page_id AS i, regexp_replace(url, '#.*$', '') AS url FROM pages), m AS (SELECT url, min(i) AS i FROM p GROUP BY url),
    l AS (SELECT m.url, (m.i * k.a + k.b) % (SELECT count(*) FROM pages) AS v FROM m, (VALUES (3, 1), (7, 2)) k(a, b)), e AS (SELECT l.url, p.url AS link FROM l JOIN p ON p.i = l.v),
    f AS (SELECT DISTINCT p.url, 1 AS depth FROM p WHERE i % 50 = 0 UNION SELECT e.link, f.depth + 1 FROM f JOIN e USING (url) WHERE f.depth < 3)
    SELECT url, min(depth)::INT AS depth, 200 AS status_code FROM f GROUP BY url""")
def gra06_fetched_crawl(spark, sf):
    seeds = table(spark, sf, "pages").where("page_id % 50 = 0").select("url")
    return crawl_web(seeds, scratch(spark, "crawl"), web_fetch(served(spark, sf).url), max_depth=3).select("url", "depth", "status_code")
