"""API-03, API-04: the engine over HTTP and over JSON-RPC on standard input, with the standard library only.

Both are thin: a request is a call of the engine, its rows are the answer, at most MOST_ROWS of them.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO

from pyspark.sql import DataFrame

from .engine import Engine
from .observability import Observer

MOST_ROWS = 1_000


def _rows(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    return [json.loads(x) for x in df.limit(min(most, MOST_ROWS)).toJSON().collect()]


class Service:
    """The calls by name; each takes and gives plain values."""

    def __init__(self, engine: Engine, observer: Observer | None = None):
        self.engine, self.observer = engine, observer or Observer()

    def health(self) -> dict:
        return {"status": "ok", "chunks": 0 if self.engine.chunks is None else self.engine.chunks.count()}

    def metrics(self) -> dict:
        return {"metrics": self.observer.text()}

    def crawl(self, url: str) -> dict:
        found = self.crawl_batch([url])["results"]
        return found[0] if found else {"url": url, "error": "nothing came back"}

    def crawl_batch(self, urls: list[str]) -> dict:
        return {"results": _rows(self.engine.crawl_many(urls).drop("content"))}

    def search(self, query: str, limit: int = 10) -> dict:
        found = self.engine.provider(self.engine.spark.createDataFrame([(1, query)], "round_number int, query string"))
        return {"results": _rows(found.orderBy("position"), limit)}

    def search_and_crawl(self, query: str, limit: int = 5) -> dict:
        from .plans.research import Strategy

        trace = self.engine.search_crawl_extract([query], strategy=Strategy(per_round=limit, max_pages=limit))
        return {"pages": _rows(trace.pages), "filtered": _rows(trace.filtered)}

    def ingest(self, documents: list[dict] | None = None, path: str | None = None) -> dict:
        if path:
            rows = _rows(self.engine.ingest_directory(path))
            return {"files": rows}
        frame = self.engine.spark.createDataFrame([(str(d["id"]), d["text"]) for d in documents or []], "doc_id string, text string")
        return {"n_chunks": self.engine.ingest(frame).count()}

    def query(self, text: str, k: int = 10, mode: str = "vector", filter: dict | None = None, window: list[int] | None = None, expansion: str | None = None) -> dict:  # noqa: A002
        asked = self.engine.spark.createDataFrame([(0, text)], "query_id int, text string")
        return {"results": _rows(self.engine.query(asked, k, mode, filter, tuple(window) if window else None, expansion))}

    def call(self, name: str, given: dict) -> dict:
        with self.observer.span(name):
            self.observer.count("requests", call=name)
            return getattr(self, name)(**given)


#: Paths and the calls they make.
GET, POST = {"/health": "health", "/metrics": "metrics"}, {"/crawl": "crawl", "/crawl/batch": "crawl_batch", "/search": "search", "/ingest": "ingest", "/query": "query"}


def http_server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that isn't started yet; serve_forever() does. Bodies and answers are JSON; a wrong call is 400, another
    failure 500."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, name: str | None, given: dict) -> None:
            status, body = 200, {}
            try:
                if name is None:
                    status, body = 404, {"error": "no such path"}
                else:
                    body = service.call(name, given)
            except (TypeError, KeyError, ValueError) as x:
                status, body = 400, {"error": f"{type(x).__name__}: {x}"}
            except Exception as x:  # noqa: BLE001
                status, body = 500, {"error": f"{type(x).__name__}: {x}"}
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            self._answer(GET.get(self.path), {})

        def do_POST(self) -> None:  # noqa: N802
            try:
                given = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                given = {"": None}
            self._answer(POST.get(self.path), given if isinstance(given, dict) else {"": given})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


#: The tools of the JSON-RPC form: name, what it does, call, and its arguments' types.
TOOLS = (
    ("crawl_url", "Fetch one page as Markdown", "crawl", {"url": "string"}),
    ("crawl_urls", "Fetch several pages as Markdown", "crawl_batch", {"urls": "array"}),
    ("search_and_crawl", "Search, then fetch what was found", "search_and_crawl", {"query": "string", "limit": "integer"}),
)


def answer(service: Service, request: dict) -> dict | None:
    """The answer to one JSON-RPC request; None to a notification."""
    method, given = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    out: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return out | {"result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestrand", "version": "1"}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": [next(iter(p))]}} for n, d, _, p in TOOLS]}}
    if method == "tools/call":
        calls: dict[str, Callable] = {n: c for n, _, c, _ in TOOLS}
        if given.get("name") not in calls:
            return out | {"error": {"code": -32602, "message": f"no tool named {given.get('name')!r}"}}
        try:
            text, failed = json.dumps(service.call(calls[given["name"]], given.get("arguments") or {}), default=str), False
        except Exception as x:  # noqa: BLE001  a tool's failure is an answer
            text, failed = f"{type(x).__name__}: {x}", True
        return out | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return out | {"error": {"code": -32601, "message": f"no method {method!r}"}}


def serve_lines(service: Service, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """JSON-RPC, one message a line, until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            said = answer(service, json.loads(line))
        except ValueError:
            said = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if said is not None:
            out.write(json.dumps(said) + "\n")
            out.flush()
