"""Web services that answer in JSON, as data sources of Spark: ``register(spark)``, then ``spark.read.format(...)`` with

* ``paged``: any interface that answers a page at a time, by page tokens or by offsets; also as a stream,
* ``posts``: posts and users of a service for short posts; recent posts also as a stream,
* ``flights``: states of aircraft and flights by aircraft, departure and arrival,
* ``web_search``: results of search services.

What is read is planned as partitions: a query, a range of rows, a window of time or a list of ids each, so that pages are
read side by side and a lost task reads its own part again, nothing else. Comparisons of columns with constants go to the
service where it has parameters for them (``pushed``), and the plan shows them. A stream's offsets are the service's own
page tokens or newest ids: a restart goes on from the last committed one.

A request that the service turns down for now (429, 5xx) or that gets no answer is made again, after the time it asks for;
then it is an error that ends the job. Only if the schema has a column ``error``, it is a row with the query and that error.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType, TimestampNTZType, TimestampType

from ..functions.social import QUERY_KINDS

#: Answers after which a request is worth making again.
_AGAIN = (408, 429, 500, 502, 503, 504)


class ServiceError(RuntimeError):
    """What a service said no with."""


@dataclass
class Client:
    """JSON over HTTP, with a key and further tries."""

    authorization: str | None = None
    timeout: float = 30.0
    tries: int = 4
    pause: float = 0.5

    @classmethod
    def of(cls, options: dict) -> Client:
        bearer = options.get("bearer")
        return cls(f"Bearer {bearer}" if bearer else options.get("authorization"), float(options.get("timeout", 30)), int(options.get("tries", 4)), float(options.get("pause", 0.5)))

    def get(self, url: str, params: dict[str, Any], body: dict | None = None) -> Any:
        """The answer, or None if there is nothing at that address."""
        asked = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None}, doseq=True)
        headers = {"Accept": "application/json", "Content-Type": "application/json"} | ({"Authorization": self.authorization} if self.authorization else {})
        address = f"{url}{'&' if '?' in url else '?'}{asked}" if asked else url
        for k in range(self.tries):
            wait = self.pause * 2**k
            try:
                request = urllib.request.Request(address, json.dumps(body).encode() if body is not None else None, headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as x:
                if x.code == 404:
                    return None
                said = f"{x.code} {x.read(500).decode('utf-8', 'replace')}"
                if x.code not in _AGAIN:
                    raise ServiceError(f"{url}: {said}") from None
                wait = float(x.headers.get("Retry-After") or wait)
            except (urllib.error.URLError, TimeoutError, ConnectionError) as x:
                said = str(x)
            if k + 1 < self.tries:
                time.sleep(wait)
        raise ServiceError(f"{url}: {said}")


def at(value: Any, path: str) -> Any:
    """What lies at a dotted path; null where the path ends early."""
    for name in filter(None, path.split(".")):
        if isinstance(value, list):
            value = value[int(name)] if name.isdigit() and int(name) < len(value) else None
        else:
            value = value.get(name) if isinstance(value, dict) else None
    return value


def typed(value: Any, kind: DataType) -> Any:
    """A JSON value as a value of the column's type; null if it isn't one."""
    if value is None:
        return None
    try:
        if isinstance(kind, StringType):
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if isinstance(kind, (LongType, IntegerType)):
            return int(value)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(value)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else str(value).lower() == "true"
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            moment = datetime.fromtimestamp(value, timezone.utc) if isinstance(value, (int, float)) else datetime.fromisoformat(value)
            zoned = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
            return zoned if isinstance(kind, TimestampType) else zoned.astimezone(timezone.utc).replace(tzinfo=None)
        if isinstance(kind, DateType):
            return datetime.fromisoformat(value).date()
        if isinstance(kind, ArrayType):
            return [typed(x, kind.elementType) for x in value] if isinstance(value, list) else None
        if isinstance(kind, StructType):
            return tuple(typed(at(value, f.name), f.dataType) for f in kind)
    except (ValueError, TypeError, OverflowError):
        return None
    return value


def _plain(value: Any) -> Any:
    """A constant of a filter as a parameter's value."""
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return value.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return value


@dataclass
class Part(InputPartition):
    """One partition: a query (if any), the parameters of its first page, and where it ends."""

    value: Any = None
    url: str = ""
    query: str | None = None
    params: dict = field(default_factory=dict)
    rows: int | None = None  # at most so many rows
    until: str | None = None  # the token that is not read any more


class Pushes:
    """Comparisons with constants that a service takes as parameters: {column: name} for equality, {column: [from, to]} for
    from <= column < to."""

    def __init__(self, names: dict[str, Any]):
        self.names, self.params = names, {}

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Yields what is left for Spark."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            name = self.names.get(column)
            if isinstance(f, EqualTo) and isinstance(name, str):
                found = name
            elif isinstance(f, (GreaterThanOrEqual, LessThan)) and isinstance(name, list):
                found = name[isinstance(f, LessThan)]
            else:
                found = None
            if found is None or found in self.params:
                yield f
            else:
                self.params[found] = _plain(f.value)


class Pages:
    """How a ``paged`` source reads: its options, and the rows of a partition."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.url, self.client = options["url"], Client.of(options)
        self.token, self.next, self.listed = options.get("token", "token"), options.get("next", "next"), options.get("rows", "rows")
        self.size, self.page = options.get("size", "limit"), int(options.get("page_size", 100))
        self.fixed = json.loads(options.get("params", "{}"))
        self.fields = json.loads(options.get("fields", "{}"))
        self.queries = json.loads(options["queries"]) if "queries" in options else [None]
        self.query, self.key = options.get("query", "query"), options.get("key", "query")
        self.most = int(options["most"]) if "most" in options else None

    def asked(self, query: str | None, params: dict) -> dict:
        return {**self.fixed, **({} if query is None else {self.query: query}), **params}

    def row(self, query: str | None, item: Any, error: str | None = None) -> tuple:
        value = lambda f: query if f.name == self.key and query is not None else error if f.name == "error" else typed(at(item, self.fields.get(f.name, f.name)), f.dataType)
        return tuple(value(f) for f in self.schema)

    def items(self, part: Part) -> Iterator[Any]:
        """The partition's items, page after page."""
        params, n = dict(part.params), 0
        while part.rows is None or n < part.rows:
            size = self.page if part.rows is None else min(self.page, part.rows - n)
            answer = self.client.get(part.url or self.url, {**self.asked(part.query, params), self.size: size})
            found = (at(answer, self.listed) or [])[:size]
            yield from found
            n += len(found)
            if "offset" in self.options and self.options["offset"] in params:
                params[self.options["offset"]] += len(found)
                if not found:
                    return
                continue
            token = at(answer, self.next)
            if not token or str(token) == part.until:
                return
            params[self.token] = token

    def read(self, part: Part) -> Iterator[tuple]:
        try:
            for item in self.items(part):
                yield self.row(part.query, item)
        except ServiceError as x:
            if "error" not in self.schema.names:
                raise
            yield self.row(part.query, {}, str(x))


class PagedReader(DataSourceReader):
    def __init__(self, pages: Pages):
        self.pages, self.pushes = pages, Pushes(json.loads(pages.options.get("pushed", "{}")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.pushes.take(filters)

    def partitions(self) -> Sequence[InputPartition]:
        """A partition a query; if the service counts its rows and takes offsets, one a range of ``range_rows``."""
        pages, pushed = self.pages, self.pushes.params
        total, offset = pages.options.get("total"), pages.options.get("offset")
        if not (total and offset):
            return [Part(None, query=q, params=pushed, rows=pages.most) for q in pages.queries]
        step, out = int(pages.options.get("range_rows", 10_000)), []
        for q in pages.queries:
            n = int(at(pages.client.get(pages.url, {**pages.asked(q, pushed), pages.size: 0}), total) or 0)
            n = n if pages.most is None else min(n, pages.most)
            out += [Part(None, query=q, params={**pushed, offset: a}, rows=min(step, n - a)) for a in range(0, n, step)]
        return out or [Part(None, rows=0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.pages.read(partition)


class PagedStream(DataSourceStreamReader):
    """A feed that only grows: ``head`` is the address that tells its newest token (at ``head_token``).

    Tokens that are numbers count the rows before them, and a batch's range is read side by side, ``range_rows`` rows a
    partition; other tokens are followed from the batch's first to its last in one partition.
    """

    def __init__(self, pages: Pages):
        self.pages = pages

    def initialOffset(self) -> dict:
        return {"token": self.pages.options.get("start", "")}

    def latestOffset(self) -> dict:
        answer = self.pages.client.get(self.pages.options["head"], self.pages.fixed)
        found = at(answer, self.pages.options.get("head_token", "token"))
        return self.initialOffset() if found is None else {"token": str(found)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, b = start["token"], end["token"]
        if a == b:
            return []
        if (a or "0").isdigit() and b.isdigit():
            low, high, step = int(a or 0), int(b), int(self.pages.options.get("range_rows", 10_000))
            return [Part(None, params={self.pages.token: str(k)}, rows=min(step, high - k)) for k in range(low, high, step)]
        return [Part(None, params={self.pages.token: a or None}, until=b)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.pages.read(partition)


class PagedSource(DataSource):
    """SRC-25, SRC-16: options url, rows, next, token, size, page_size; queries (a JSON list), query, key; total, offset,
    range_rows; params, fields, pushed (JSON objects); most (rows a query); head, head_token, start for streams; bearer or
    authorization, timeout, tries, pause. The schema is the caller's: a column takes what lies at its path in an item."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(Pages(schema, dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(Pages(schema, dict(self.options)))


POSTS = "query string, id string, text string, author_id string, username string, created_at timestamp, conversation_id string, replied_to string, parent_text string, parent_username string"
USERS = "query string, id string, username string, name string, description string, created_at timestamp, followers long, following long, posts long"
#: What is asked for with posts and users, and the largest pages and lists: fixed values of the service.
_POST_FIELDS = {"tweet.fields": "created_at,public_metrics,author_id,referenced_tweets,conversation_id", "expansions": "author_id,referenced_tweets.id,referenced_tweets.id.author_id", "user.fields": "username,name"}
_USER_FIELDS = {"user.fields": "id,username,name,description,public_metrics,created_at"}
_USER_KINDS = {"profile": 100, "followers": 1000, "following": 1000}
_POST_PAGES = {"recent": (10, 100), "timeline": (5, 100), "posts": (1, 100)}


class Posts(Pages):
    """Posts with their authors and the posts they reply to, from the answer's own includes."""

    def __init__(self, schema: StructType, options: dict):
        kind = options.get("kind", "recent")
        if kind not in _USER_KINDS and kind not in _POST_PAGES:
            raise ValueError(f"unknown kind {kind!r}")
        self.base = options.get("base", "https://api.x.com/2").rstrip("/")
        super().__init__(schema, {**options, "url": f"{self.base}/tweets/search/recent", "rows": "data", "next": "meta.next_token", "size": "max_results", "token": "next_token" if kind == "recent" else "pagination_token"})
        self.kind = kind
        if kind in _POST_PAGES:
            least, most = _POST_PAGES[kind]
            self.page = min(most, max(least, self.page))
        else:
            self.page = min(_USER_KINDS[kind], max(1, self.page))
        self.fixed = {**(_POST_FIELDS if kind in _POST_PAGES else _USER_FIELDS), **self.fixed}

    def post(self, query: str | None, x: dict, users: dict, posts: dict) -> tuple:
        parent = next((r.get("id") for r in x.get("referenced_tweets") or [] if r.get("type") == "replied_to"), None)
        above = posts.get(parent) or {}
        name = lambda i: (users.get(i) or {}).get("username")
        held = {**x, "query": query, "username": name(x.get("author_id")) or "unknown", "replied_to": parent, "parent_text": above.get("text"), "parent_username": name(above.get("author_id"))}
        return tuple(typed(held.get(f.name), f.dataType) for f in self.schema)

    def user(self, query: str | None, x: dict) -> tuple:
        counts = x.get("public_metrics") or {}
        held = {**x, "query": query, "followers": counts.get("followers_count"), "following": counts.get("following_count"), "posts": counts.get("tweet_count")}
        return tuple(typed(held.get(f.name), f.dataType) for f in self.schema)

    def rows_of(self, query: str | None, answer: Any) -> list[tuple]:
        found = at(answer, "data") or []
        found = found if isinstance(found, list) else [found]
        if self.kind in _USER_KINDS:
            return [self.user(query, x) for x in found]
        users = {u.get("id"): u for u in at(answer, "includes.users") or []}
        posts = {p.get("id"): p for p in at(answer, "includes.tweets") or []}
        return [self.post(query, x, users, posts) for x in found]

    def read(self, part: Part) -> Iterator[tuple]:
        url = part.url
        if self.kind in ("timeline", "followers", "following"):  # by the user's number
            user = at(self.client.get(f"{self.base}/users/by/username/{urllib.parse.quote(part.query)}", _USER_FIELDS), "data.id")
            if user is None:
                return
            url = f"{self.base}/users/{user}/{'tweets' if self.kind == 'timeline' else self.kind}"
        listed, params, n = self.kind in ("posts", "profile"), dict(part.params), 0
        while part.rows is None or n < part.rows:
            answer = self.client.get(url, {**self.fixed, **params, **({} if listed else {self.size: self.page})})
            rows = self.rows_of(part.query, answer)
            rows = rows if part.rows is None else rows[: part.rows - n]
            yield from rows
            n += len(rows)
            token = at(answer, self.next)
            if not token or not rows:
                return
            params[self.token] = token


class PostsReader(DataSourceReader):
    def __init__(self, posts: Posts):
        self.posts = posts
        self.pushes = Pushes({"created_at": ["start_time", "end_time"]} if posts.kind in ("recent", "timeline") else {})

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.pushes.take(filters)

    def partitions(self) -> Sequence[InputPartition]:
        """Lists of ids or names by the hundred; searches and timelines one each, or ``windows`` windows of the time that a
        filter bounds on both sides."""
        posts, pushed = self.posts, self.pushes.params
        asked = [q for q in posts.queries if q]
        if posts.kind in ("posts", "profile"):
            url, name = (f"{posts.base}/tweets", "ids") if posts.kind == "posts" else (f"{posts.base}/users/by", "usernames")
            return [Part(None, url=url, params={name: ",".join(asked[i : i + 100])}) for i in range(0, len(asked), 100)] or [Part(None, rows=0)]
        spans = [pushed]
        n = int(posts.options.get("windows", 1))
        if n > 1 and len(pushed) == 2:
            a, b = (datetime.fromisoformat(pushed[k]) for k in ("start_time", "end_time"))
            cuts = [a + (b - a) * k / n for k in range(n + 1)]
            spans = [{"start_time": _plain(x), "end_time": _plain(y)} for x, y in zip(cuts, cuts[1:]) if x < y]
        extra = lambda q: {"query": q.strip()} if posts.kind == "recent" else {}
        return [Part(None, url=posts.url, query=q, params={**extra(q), **s}, rows=posts.most) for q in asked for s in spans] or [Part(None, rows=0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.posts.read(partition)


class PostsStream(DataSourceStreamReader):
    """Recent posts of each query; offsets are the newest ids."""

    def __init__(self, posts: Posts):
        self.posts = posts

    def initialOffset(self) -> dict:
        return {q: self.posts.options.get("start", "") for q in self.posts.queries}

    def latestOffset(self) -> dict:
        out = self.initialOffset()
        for q in out:
            newest = at(self.posts.client.get(self.posts.url, {"query": q, "max_results": 10}), "meta.newest_id")
            out[q] = str(newest) if newest else out[q]
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        spans = [(q, start.get(q, ""), end[q]) for q in end if end[q] and end[q] != start.get(q, "")]
        return [Part(None, url=self.posts.url, query=q, params={"query": q, "since_id": a or None, "until_id": str(int(b) + 1)}) for q, a, b in spans]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.posts.read(partition)


class PostsSource(DataSource):
    """SRC-12 to SRC-14: options kind (recent, posts, timeline, profile, followers, following), queries (a JSON list of
    queries, ids or user names), base, bearer, most, page_size, windows; start for streams."""

    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> str:
        return USERS if self.options.get("kind", "recent") in _USER_KINDS else POSTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return PostsReader(Posts(schema, dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PostsStream(Posts(schema, dict(self.options)))


FLIGHTS = "query string, kind string, icao24 string, callsign string, first_seen timestamp, last_seen timestamp, departure string, arrival string, origin_country string, longitude double, latitude double, baro_altitude double, on_ground boolean, velocity double, true_track double"
#: A state's numbers in its list, and how many days of flights one request may ask for: fixed values of the service.
_STATE = {"icao24": 0, "callsign": 1, "origin_country": 2, "first_seen": 3, "last_seen": 4, "longitude": 5, "latitude": 6, "baro_altitude": 7, "on_ground": 8, "velocity": 9, "true_track": 10}
_FLIGHT = {"icao24": "icao24", "callsign": "callsign", "first_seen": "firstSeen", "last_seen": "lastSeen", "departure": "estDepartureAirport", "arrival": "estArrivalAirport"}
_DAYS = 2


class FlightsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.client = schema, Client.of(options)
        self.base = options.get("base", "https://opensky-network.org/api").rstrip("/")
        self.queries = json.loads(options.get("queries", "[]"))
        self.begin, self.end, self.hours = options.get("begin"), options.get("end"), float(options.get("hours", 48))
        self.pushes = Pushes({"first_seen": ["begin", "end"]})

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kept = list(filters)
        list(self.pushes.take(filters))
        return iter(kept)  # states hold times before what was asked for, so Spark compares again

    def partitions(self) -> Sequence[InputPartition]:
        """A query's states, and its flights in windows of what one request may ask for."""
        moment = lambda x: int(datetime.fromisoformat(x).timestamp())
        pushed = self.pushes.params
        end = moment(pushed["end"]) if "end" in pushed else int(self.end or time.time())
        begin = moment(pushed["begin"]) if "begin" in pushed else int(self.begin or end - self.hours * 3600)
        spans = [(a, min(a + _DAYS * 86400, end) - 1) for a in range(begin, end, _DAYS * 86400)]
        out = []
        for q in self.queries:
            kind, _, value = (x.strip() for x in q.partition(":"))
            kind, value = (kind.lower(), value) if kind.lower() in QUERY_KINDS else ("all", "")
            if kind in ("all", "area", "icao24"):
                corners = dict(zip(("lamin", "lomin", "lamax", "lomax"), value.split(","))) if kind == "area" else {"icao24": value.lower()} if value else {}
                out.append(Part(None, url=f"{self.base}/states/all", query=q, params=corners))
            if kind != "all" and kind != "area":
                path, name, value = {"icao24": ("aircraft", "icao24", value.lower()), "departures": ("departure", "airport", value.upper()), "arrivals": ("arrival", "airport", value.upper())}[kind]
                out += [Part(None, url=f"{self.base}/flights/{path}", query=q, params={name: value, "begin": a, "end": b}) for a, b in spans]
        return out or [Part(None, rows=0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.rows == 0:
            return
        answer = self.client.get(partition.url, partition.params)
        states = partition.url.endswith("/states/all")
        for x in (at(answer, "states") if states else answer) or []:
            held = {k: at(x, str(p)) for k, p in (_STATE if states else _FLIGHT).items()}
            code = (held["icao24"] or "unknown").lower()
            held |= {"query": partition.query, "kind": "state" if states else "flight", "icao24": code, "callsign": (held["callsign"] or "").strip() or code}
            yield tuple(typed(held.get(f.name), f.dataType) for f in self.columns)


class FlightsSource(DataSource):
    """SRC-15: options queries (a JSON list of ``icao24:..``, ``departures:..``, ``arrivals:..``, ``area:..`` or anything else
    for all states), begin and end (seconds) or hours before now, base, bearer."""

    @classmethod
    def name(cls) -> str:
        return "flights"

    def schema(self) -> str:
        return FLIGHTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return FlightsReader(schema, dict(self.options))


RESULTS = "query string, position long, url string, title string, description string, error string"
#: Where each search service is asked and where its answers lie: fixed values of the services.
PROVIDERS: dict[str, dict[str, Any]] = {
    "searxng": {"path": "search", "query": "q", "limit": None, "params": {"format": "json"}, "results": ("results",), "description": ("content",), "post": False},
    "tavily": {"path": "search", "query": "query", "limit": "max_results", "params": {"search_depth": "basic"}, "results": ("results",), "description": ("content",), "post": True},
    "firecrawl": {"path": "v2/search", "query": "query", "limit": "limit", "params": {"sources": ["web"]}, "results": ("data.web", "data.news"), "description": ("description", "snippet"), "post": True},
}


class SearchReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.client = schema, Client.of(options)
        self.provider, self.base = PROVIDERS[options["provider"]], options["base"].rstrip("/")
        self.queries, self.limit, self.each = json.loads(options.get("queries", "[]")), int(options.get("limit", 10)), int(options.get("queries_a_task", 8))

    def partitions(self) -> Sequence[InputPartition]:
        return [Part(json.dumps(self.queries[i : i + self.each])) for i in range(0, len(self.queries), self.each)] or [Part("[]")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p = self.provider
        for query in json.loads(partition.value):
            params = {**p["params"], p["query"]: query.strip(), **({p["limit"]: self.limit} if p["limit"] else {})}
            try:
                url = f"{self.base}/{p['path']}"
                answer = self.client.get(url, {}, params) if p["post"] else self.client.get(url, params)
            except ServiceError as x:
                yield tuple({"query": query, "error": str(x)}.get(f.name) for f in self.columns)
                continue
            listed = [x for path in p["results"] for x in at(answer, path) or []]
            kept = [x for x in listed if x.get("url") or x.get("link")][: self.limit]
            for i, x in enumerate(kept, 1):
                said = next((x[k] for k in p["description"] if x.get(k)), None)
                held = {"query": query, "position": i, "url": x.get("url") or x.get("link"), "title": x.get("title"), "description": said}
                yield tuple(typed(held.get(f.name), f.dataType) for f in self.columns)


class SearchSource(DataSource):
    """SRC-16, SRC-17: options provider (searxng, tavily, firecrawl), base, bearer, queries (a JSON list), limit. A query that
    fails is a row with its error."""

    @classmethod
    def name(cls) -> str:
        return "web_search"

    def schema(self) -> str:
        return RESULTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return SearchReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets it push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PagedSource, PostsSource, FlightsSource, SearchSource):
        spark.dataSource.register(source)
