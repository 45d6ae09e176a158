"""Streaming queries, run to completion over the tables as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental as I, windows as W
from .registered import query, table


@query("strx_tumbling", "SELECT event_type AS key, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def strx_tumbling(spark, sf):
    return W.run_windows(spark, sf, "1 day")


@query("strx_sliding", "SELECT event_type AS key, time_bucket(INTERVAL 1 DAY, ts) - to_days(k::INT) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events, unnest(range(0, 3)) u(k) GROUP BY 1, 2")
def strx_sliding(spark, sf):
    return W.run_windows(spark, sf, "3 days", "1 day")


@query("strx_session", """
    WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
    SELECT user_id AS key, min(ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""")
def strx_session(spark, sf):
    return W.run_sessions(spark, sf, "6 hours")


@query("str02_stream_dedup", "SELECT count(DISTINCT sha256(text)) AS n FROM documents")
def str02_stream_dedup(spark, sf):
    return I.deduplicated(spark, sf).agg(F.count("*").alias("n"))


@query("str03_stream_term_counts", r"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY 1")
def str03_stream_term_counts(spark, sf):
    return I.term_counts(spark, sf)


@query("str06_progressive_pages", "SELECT page_id, left(html, 100) AS summary, page_id % 10 = 0 AS is_fully_processed FROM pages")
def str06_progressive_pages(spark, sf):
    pages = table(spark, sf, "pages")
    summaries = pages.select("page_id", F.substring("html", 1, 100).alias("summary"), F.lit(False).alias("is_fully_processed"))
    return I.mark_processed(summaries, pages.where("page_id % 10 = 0").select("page_id"), "page_id")
