"""Fetching: pages over HTTP and results of search services, where the rows are.

Failures are rows, not errors: status 0 and what went wrong. Each partition fetches its urls one after the other, so the
number of partitions bounds how many requests run at once, and ``delay`` spaces a partition's requests.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.url import is_pdf
from .files import markdown
from .formats import decode

RESULT = "url string, status_code int, content string, markdown string, content_type string, error string, seconds double"


def _get(url: str, headers: dict[str, str], timeout: float, data: bytes | None = None) -> tuple[int, str, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=timeout) as answer:
            return answer.status, answer.headers.get_content_type(), answer.read()
    except urllib.error.HTTPError as x:
        return x.code, x.headers.get_content_type() if x.headers else "", x.read()


def fetched(candidates: DataFrame, headers: dict[str, str] | None = None, cookies: dict[str, str] | None = None, agent: str = "Mozilla/5.0 (compatible; lodestrand)", timeout: float = 30.0, delay: float = 0.0, parallel: int = 8) -> DataFrame:
    """SRC-08, SRC-10, STR-08: candidates (url, ...) with status_code, content, markdown, content_type, error and seconds.

    HTML becomes Markdown, a PDF (by its type or url) the text of its pages. Equal urls are fetched once. A status of 400
    or more is an error, too.
    """
    sent = {"User-Agent": agent} | (headers or {})
    if cookies:
        sent["Cookie"] = "; ".join(f"{k}={v}" for k, v in cookies.items())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, pdf in zip(frame["url"], frame["pdf"]):
                began = time.monotonic()
                try:
                    status, kind, raw = _get(url, sent, timeout)
                    if pdf or kind == "application/pdf":
                        text = decode("pdf", raw)
                        shown: str | None = text
                    else:
                        text = raw.decode("utf-8", "replace")
                        shown = markdown(text) if "html" in kind else text
                    rows.append((url, status, text, shown, kind, None if status < 400 else f"status {status}", time.monotonic() - began))
                except Exception as x:  # noqa: BLE001  a failed request is a row
                    rows.append((url, 0, None, None, None, f"{type(x).__name__}: {x}", time.monotonic() - began))
                if delay:
                    time.sleep(delay)
            yield pd.DataFrame(rows, columns=["url", "status_code", "content", "markdown", "content_type", "error", "seconds"])

    urls = candidates.select("url").where("url is not null").distinct().withColumn("pdf", F.coalesce(is_pdf(F.col("url")), F.lit(False)))
    got = urls.repartition(parallel, "url").mapInPandas(run, RESULT)
    return candidates.join(got, "url", "left")


def _at(value: Any, path: str) -> Any:
    for name in filter(None, path.split(".")):
        value = value[int(name)] if isinstance(value, list) else (value or {}).get(name)
    return value


def json_search(address: Callable[[str, int], str], results: str, fields: dict[str, str], limit: int = 10, headers: dict[str, str] | None = None, body: Callable[[str, int], dict] | None = None, timeout: float = 30.0) -> Callable[[DataFrame], DataFrame]:
    """SRC-16, SRC-17: a search provider over a service that answers in JSON.

    address makes the url of a query and a limit; results is the path of the list in the answer, and fields name the paths
    of url, title, description and snippet in each. The provider takes (round_number, query) rows and gives round_number,
    query, position (from 1, without rows that have no url), url, title, description. A query that fails has no rows.
    """

    def search(queries: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for number, query in zip(frame["round_number"], frame["query"]):
                    data = json.dumps(body(query, limit)).encode() if body else None
                    try:
                        _, _, raw = _get(address(query, limit), {"Content-Type": "application/json"} | (headers or {}), timeout, data)
                        listed = _at(json.loads(raw), results) or []
                    except Exception:  # noqa: BLE001
                        listed = []
                    kept = [{k: _at(x, p) for k, p in fields.items()} for x in listed]
                    for i, x in enumerate([x for x in kept if x.get("url")][:limit], 1):
                        rows.append((number, query, i, x["url"], x.get("title"), x.get("description") or x.get("snippet")))
                yield pd.DataFrame(rows, columns=["round_number", "query", "position", "url", "title", "description"])

        return queries.select("round_number", "query").mapInPandas(run, "round_number int, query string, position long, url string, title string, description string")

    return search


def paged(queries: DataFrame, fetch: Callable[[str, str | None], tuple[list[dict], str | None]], schema: str, key: str = "query", most: int = 100) -> DataFrame:
    """SRC-13, SRC-25: rows of an interface that answers a page at a time: fetch(query, token) -> (rows, next token).

    A query's pages are read one after the other until there is no token or ``most`` rows are there; what fails ends it.
    The query's column is part of the rows.
    """
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[dict] = []
            for query in frame[key]:
                token, mine = None, []
                while len(mine) < most:
                    try:
                        found, token = fetch(query, token)
                    except Exception:  # noqa: BLE001
                        break
                    mine += found
                    if not token or not found:
                        break
                rows += [{key: query, **x} for x in mine[:most]]
            yield pd.DataFrame(rows, columns=[f.name for f in kind])

    return queries.select(key).mapInPandas(run, kind)
