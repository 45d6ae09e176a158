"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}_]+"


#: What counts as white space at the ends of a text: the ASCII kinds.
SPACES = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    """Drops white space at both ends (all of it, not only spaces)."""
    return F.btrim(text, F.lit(SPACES))


def not_blank(text: Column) -> Column:
    return text.isNotNull() & text.rlike(r"\S")


def tokens(text: Column) -> Column:
    """FN-02: lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_counts(words: Column) -> Column:
    """AGG-01 inside a row: (term, tf) of each distinct token, by term; none for null."""

    def runs(sorted_words: Column) -> Column:
        heads = F.transform(sorted_words, lambda w, i: F.when((i == 0) | (w != F.get(sorted_words, i - 1)), i))
        count = lambda at, after: F.struct(F.get(sorted_words, at).alias("term"), (F.coalesce(after, F.size(sorted_words)) - at).alias("tf"))
        return let(F.array_compact(heads), lambda starts: F.transform(starts, lambda at, j: count(at, F.get(starts, j + 1))))

    return let(F.sort_array(F.coalesce(words, F.array().cast("array<string>"))), runs)


def sentences(text: Column) -> Column:
    """CHK-01: cut after . ! or ? and white space; stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """CHK-02: cut at blank lines; stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda s: s != "")


def word_count(text: Column) -> Column:
    """FN-28"""
    clean = strip(text)
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, r"\s+")))


def token_estimate(text: Column) -> Column:
    """FN-04: four characters a token."""
    return F.floor(F.length(text) / 4).cast("long")


def alnum_count(text: Column) -> Column:
    """FN-05"""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def query_slug(text: Column) -> Column:
    """FN-06: a file name for a query: lower case, words joined by single underscores, at most 120 characters."""
    out = F.regexp_replace(F.lower(strip(text)), r"\s+", "_")
    out = F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_]", "_"), r"_+", "_")
    out = F.substring(F.regexp_replace(out, r"^_+|_+$", ""), 1, 120)
    return F.when(out == "", F.lit("query")).otherwise(out)


def file_stem(url: Column) -> Column:
    """FN-07: a file name for a url, without its scheme, at most 200 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"[^\p{L}\p{N}_.-]", "_"), 1, 200)


def file_type(path: Column) -> Column:
    """FN-27"""
    return F.lower(F.regexp_extract(path, r"[.]([^./]+)$", 1))


#: What marks a cut text: a fixed value.
TRUNCATED = "\n\n[... truncated ...]"


def clipped(text: Column, size: int, marker: str = TRUNCATED) -> Column:
    """FN-16: at most size characters, with a marker if any were cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(marker))).otherwise(text)


def page_summary(text: Column, size: int = 500) -> Column:
    """CHK-13 by the first characters."""
    head = strip(F.substring(text, 1, size))
    return F.when(F.length(text) > size, F.concat(head, F.lit("..."))).otherwise(head)


def page_headings(text: Column) -> Column:
    """CHK-13 by metadata: those of the first five lines that aren't blank, else the first 200 characters."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 5), strip), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.array_join(lines, " | ")).otherwise(F.substring(text, 1, 200))


def without_front_matter(text: Column) -> Column:
    """FN-15"""
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n+", "")


def listed_queries(answer: Column, most: int) -> Column:
    """FN-12: the lines of a model's list, without numbering and bullets."""
    bare = lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), r"^\d+[.)]\s*", ""), r"^[-*•>] ", ""))
    return F.slice(F.filter(F.transform(F.split(answer, "\n"), bare), lambda x: x != ""), 1, most)


def unfenced_json(answer: Column) -> Column:
    """FN-13: what stands inside a fenced block, or the whole answer."""
    inner = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return strip(F.when(inner != "", inner).otherwise(answer))


def judged_good(answer: Column) -> Column:
    """FN-14: a verdict of BAD alone drops; GOOD or anything unclear keeps."""
    upper = F.upper(strip(answer))
    return ~(upper.contains("BAD") & ~upper.contains("GOOD"))


def augmented_query(query: Column, excluded: Column, sites: Column) -> Column:
    """FN-11: excluded terms and sites as search operators."""
    return F.concat_ws(" ", query, F.transform(excluded, lambda x: F.concat(F.lit("-"), x)), F.transform(sites, lambda x: F.concat(F.lit("site:"), x)))


def safe_label(label: Column, default: str) -> Column:
    """FN-21"""
    out = F.regexp_replace(label, r"[^A-Za-z0-9_]", "_")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(default)).otherwise(out)


def metric_key(name: Column, labels: Column) -> Column:
    """FN-26: name{k=v,...} with sorted labels (a map)."""
    parts = F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(parts) > 0, F.concat(name, F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(name)


def status_post_id(url: Column) -> Column:
    """FN-17: the id of a post from its url, or null."""
    found = F.regexp_extract(url, r"(?:x|twitter)\.com/[^/]+/status(?:es)?/(\d+)", 1)
    return F.when(found != "", found)


def status_user(url: Column) -> Column:
    """FN-17: the author from a post's url, or null."""
    found = F.regexp_extract(url, r"(?:x|twitter)\.com/([^/?#]+)/status", 1)
    return F.when((found != "") & (found != "i"), found)


def listing_line(*parts: Column) -> Column:
    """FN-22: the parts that aren't null, as a bullet."""
    return F.concat(F.lit("- "), F.concat_ws(" — ", *parts))


#: Slots of a positional state vector that are projected, and their types: fixed values.
STATE_FIELDS = (("icao24", 0, "string"), ("callsign", 1, "string"), ("origin_country", 2, "string"), ("time_position", 3, "long"), ("last_contact", 4, "long"), ("longitude", 5, "double"), ("latitude", 6, "double"), ("baro_altitude", 7, "double"), ("on_ground", 8, "boolean"), ("velocity", 9, "double"), ("true_track", 10, "double"), ("vertical_rate", 11, "double"), ("geo_altitude", 13, "double"), ("squawk", 14, "string"))


def state_struct(state: Column) -> Column:
    """FN-20: a positional array of strings as a struct; missing slots are null, the call sign is trimmed."""
    at = lambda i: F.try_element_at(state, F.lit(i + 1))
    return F.struct(*[(F.trim(at(i)) if name == "callsign" else at(i).try_cast(kind)).alias(name) for name, i, kind in STATE_FIELDS])


def replied_to(references: Column) -> Column:
    """FN-25: the id of the post that a post replies to; references is an array of (type, id)."""
    return F.try_element_at(F.filter(references, lambda r: r["type"] == "replied_to"), F.lit(1))["id"]
