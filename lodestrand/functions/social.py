"""Posts, users and flights as text, and small parsers around them."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, functions as F


def _said(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"**{label}:** "), value.cast("string"))


def _lines(*parts: Column) -> Column:
    """The parts that aren't null, one a line."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def post_markdown(username: Column, name: Column, text: Column, created: Column, likes: Column, reposts: Column, parent: Column | None = None) -> Column:
    """FN-18: a post with its author, time and counts; the post it replies to stands above it as a quote."""
    head = F.concat(F.lit("## Post by @"), username, F.coalesce(F.concat(F.lit(" ("), name, F.lit(")")), F.lit("")))
    quote = F.lit(None).cast("string") if parent is None else F.concat(F.lit("> "), F.regexp_replace(parent, "\n", "\n> "))
    counts = F.concat(F.format_number(F.coalesce(likes, F.lit(0)), 0), F.lit(" likes, "), F.format_number(F.coalesce(reposts, F.lit(0)), 0), F.lit(" reposts"))
    return _lines(head, quote, F.coalesce(text, F.lit("")), _said("Posted", created), counts)


def user_markdown(username: Column, name: Column, bio: Column, followers: Column, following: Column, names: Column | None = None, most: int = 100) -> Column:
    """FN-18: a profile; of the followers' names at most ``most`` are listed (TOP-10)."""
    listed = F.lit(None).cast("string") if names is None else F.when(F.size(names) > 0, F.concat(F.lit("Followers: "), F.array_join(F.transform(F.slice(names, 1, most), lambda x: F.concat(F.lit("@"), x)), ", ")))
    return _lines(F.concat(F.lit("# @"), username, F.coalesce(F.concat(F.lit(" ("), name, F.lit(")")), F.lit(""))), F.nullif(bio, F.lit("")), _said("Followers", F.format_number(followers, 0)), _said("Following", F.format_number(following, 0)), listed)


def flight_markdown(callsign: Column, icao24: Column, origin: Column, destination: Column, first_seen: Column, last_seen: Column) -> Column:
    """FN-18: a flight; times are seconds since 1970 and read in UTC."""
    at = lambda x: F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd HH:mm")
    return _lines(F.concat(F.lit("## Flight "), F.coalesce(F.nullif(F.trim(callsign), F.lit("")), icao24)), _said("Aircraft", icao24), _said("From", origin), _said("To", destination), _said("First seen", at(first_seen)), _said("Last seen", at(last_seen)))


def state_markdown(state: Column) -> Column:
    """FN-18: a state (see functions.text.state_struct) as text; what is unknown is left out."""
    place = F.concat(F.format_number(state["latitude"], 4), F.lit(", "), F.format_number(state["longitude"], 4))
    return _lines(F.concat(F.lit("## Aircraft "), F.coalesce(F.nullif(state["callsign"], F.lit("")), state["icao24"])), _said("Country", state["origin_country"]), _said("Position", place), _said("Altitude (m)", state["baro_altitude"]), _said("Speed (m/s)", state["velocity"]))


#: Hours that a day window may reach back: a fixed value.
MOST_HOURS = 48


def day_window(now: Column, hours: Column) -> Column:
    """FN-19: (begin, end) in seconds: from midnight (UTC) of the day, at most MOST_HOURS back, to that midnight."""
    end = F.unix_timestamp(F.date_trunc("day", now))
    return F.struct((end - F.least(hours, F.lit(MOST_HOURS)) * 3600).alias("begin"), end.alias("end"))


#: Prefixes of the query language over aircraft: fixed values.
QUERY_KINDS = ("icao24", "departures", "arrivals", "area")


def flight_query(query: Column) -> Column:
    """SRC-15: (kind, value) of ``icao24:``, ``departures:``, ``arrivals:`` or ``area:`` queries; else all, with the query."""
    kind = F.lower(F.regexp_extract(query, rf"(?i)^\s*({'|'.join(QUERY_KINDS)}):", 1))
    value = F.trim(F.regexp_replace(query, rf"(?i)^\s*({'|'.join(QUERY_KINDS)}):", ""))
    return F.struct(F.when(kind == "", "all").otherwise(kind).alias("kind"), value.alias("value"))


def in_area(latitude: Column, longitude: Column, area: Column) -> Column:
    """SRC-15: within ``south,west,north,east``; an area that doesn't parse holds nothing."""
    box = F.transform(F.split(area, ","), lambda x: F.trim(x).try_cast("double"))
    at = lambda i: F.try_element_at(box, F.lit(i))
    return F.coalesce((F.size(box) == 4) & latitude.between(at(1), at(3)) & longitude.between(at(2), at(4)), F.lit(False))


def plan_kind(flag: Column, kind: Column) -> Column:
    """FN-34: the kind of pipeline a plan names; an older plan has only a flag for listings."""
    return F.coalesce(F.nullif(kind, F.lit("")), F.when(F.coalesce(flag, F.lit(False)), "listings").otherwise("general"))


def extraction_record(kind: Column, text: Column, start: Column, end: Column, attributes: Column) -> Column:
    """FN-32: an extraction as one record; empty attributes are null."""
    return F.struct(kind.alias("extraction_class"), text.alias("extraction_text"), F.struct(start.alias("start_pos"), end.alias("end_pos")).alias("char_interval"), F.when(F.size(attributes) > 0, attributes).alias("attributes"))


#: Ports that store urls have where they name none: fixed values.
PORTS = {"qdrant": 6333, "chroma": 8000, "neo4j": 7687, "bolt": 7687}


def store_url(url: str) -> dict:
    """FN-24: a store's address: kind, host, port, name (the path), user and password; ``memory`` needs none."""
    if url in ("", "memory", "memory://"):
        return {"kind": "memory"}
    parts = urlsplit(url)
    kind = parts.scheme.partition("+")[0].lower()
    if kind not in PORTS:
        raise ValueError(f"no store of kind {kind!r}; there are: memory, {', '.join(PORTS)}")
    return {"kind": kind, "host": parts.hostname or "localhost", "port": parts.port or PORTS[kind], "name": parts.path.strip("/") or None, "user": parts.username, "password": parts.password}
