"""Crawl and search analytics: candidate filters, orders, frontiers, traces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import clipped, strip
from ..functions.url import followed, hostname, page_links, registered_domain
from ..sources.state import cut

#: Words in a listing's status that mean it is gone: fixed values.
STALE = ("sold", "ended", "expired", "pending", "closed", "completed")


def blocked_by(host: Column, domains: tuple[str, ...]) -> Column:
    """FLT-10: the first listed domain that the host lies on, or null."""
    return F.coalesce(*[F.when((host == d) | host.endswith(f".{d}"), F.lit(d)) for d in domains], F.lit(None).cast("string"))


def split_blocked(rows: DataFrame, domains: tuple[str, ...], url: str = "url") -> tuple[DataFrame, DataFrame]:
    """FLT-10: (allowed, filtered with a reason)."""
    by = rows.withColumn("blocked_by", blocked_by(hostname(F.col(url)), domains))
    return by.where("blocked_by is null").drop("blocked_by"), by.where("blocked_by is not null").withColumn("reason", F.lit("blocked_domain"))


def preferred_order(host: Column, domains: tuple[str, ...]) -> Column:
    """TOP-06: the index of the first preferred domain that the host lies on, else their number."""
    return F.coalesce(*[F.when((host == d) | host.endswith(f".{d}"), F.lit(i)) for i, d in enumerate(domains)], F.lit(len(domains)))


def repaired(pattern: str) -> str | None:
    """FLT-11: a mistyped inline flag is mended; a pattern that doesn't compile is skipped (null)."""
    pattern = re.sub(r"^\(\?i>", "(?i)", pattern)
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def first_stale(text: Column, patterns: tuple[str, ...]) -> Column:
    """FLT-11: the first pattern found (case ignored, dots match line ends), or null."""
    good = [(p, r) for p in patterns if (r := repaired(p))]
    return F.coalesce(*[F.when(text.rlike(f"(?is){r}"), F.lit(p)) for p, r in good], F.lit(None).cast("string"))


def has_required(text: Column, patterns: tuple[str, ...]) -> Column:
    """FLT-12: any pattern is found, or there is none that compiles."""
    good = [r for p in patterns if (r := repaired(p))]
    out = F.lit(not good)
    for r in good:
        out = out | text.rlike(f"(?is){r}")
    return out


def live_listing(status: Column) -> Column:
    """FLT-13: an unknown status is kept."""
    return ~F.coalesce(F.lower(status).rlike("|".join(STALE)), F.lit(False))


def bad_words(criteria: Column) -> Column:
    """FLT-14: the words after ``Bad:`` on its line."""
    line = F.regexp_extract(criteria, r"(?i)bad:[^\S\n]*([^\n]*)", 1)
    return F.filter(F.transform(F.split(F.lower(line), ","), strip), lambda x: x != "")


def relevant(url: Column, title: Column, snippet: Column, words: Column) -> Column:
    """FLT-14: none of the words occurs in url, title and snippet."""
    text = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    return ~F.exists(words, lambda w: text.contains(w))


def page_text(markdown: Column, content: Column) -> Column:
    """FLT-19"""
    return strip(F.concat_ws("\n", F.coalesce(markdown, F.lit("")), F.coalesce(content, F.lit(""))))


def link_graph(pages: DataFrame, follow: tuple[str, ...] = (), exclude: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """FN-08, FLT-06: (keys, url, position, link) of the links a crawl may follow.

    A url may stand for several pages, so what tells them apart (keys) comes along here; a join by url would mix them.
    """
    links = pages.select(*keys, "url", F.posexplode(page_links(F.col("html"), F.col("url"))).alias("position", "link"))
    return links.where(followed(F.col("link"), follow, exclude))


def same_domain(links: DataFrame) -> DataFrame:
    """FLT-07"""
    return links.where(registered_domain(F.col("url")) == registered_domain(F.col("link")))


def keep_first(rows: DataFrame, key: Column, order: Column, done: DataFrame | None = None, done_key: Column | None = None) -> DataFrame:
    """SET-01 to SET-03, SET-07, SET-09: the first row of each key, without keys that are done already; null and empty keys go.

    First means least by ``order``, found by a grouped minimum that is combined before the shuffle.
    """
    keyed = rows.withColumn("_key", key).where("_key is not null and _key != ''")
    if done is not None:
        keyed = keyed.join(done.select(done_key.alias("_key")).distinct(), "_key", "left_anti")
    names = [c for c in keyed.columns if c != "_key"]
    return keyed.groupBy("_key").agg(F.min_by(F.struct(*names), order).alias("_row")).select("_row.*")


def listing_key(url: Column, fold: bool = True) -> Column:
    """SET-02 (fold) and SET-03."""
    return F.regexp_replace(F.lower(url) if fold else strip(url), "/+$", "")


def host_counts(pages: DataFrame, url: str = "url", most: int = 15) -> DataFrame:
    """AGG-08"""
    return pages.groupBy(hostname(F.col(url)).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(most)


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """GRA-06, JON-06, TOP-09: (url, depth) of pages reached breadth-first, a wave at a time.

    pages (url) and links (url, link) are the web; seeds (url). A wave is what the last one links to and no earlier wave
    has reached: an equi-join, a distinct and an anti-join, cut by a checkpoint. At most max_pages, by depth, then url.
    """
    web = pages.select("url").distinct()
    reached = cut(web.join(seeds.select("url").distinct(), "url", "left_semi").select("url", F.lit(0).alias("depth")))
    wave = reached
    for depth in range(1, max_depth + 1):
        wave = cut(wave.select("url").join(links, "url").select(F.col("link").alias("url")).distinct().join(web, "url", "left_semi").join(reached, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if wave.isEmpty():
            break
        reached = cut(reached.unionByName(wave))
        if reached.count() >= max_pages:
            break
    return reached.orderBy("depth", "url").limit(max_pages)


def trace_lines(trace: DataFrame, rounds: DataFrame, pages: DataFrame, filtered: DataFrame) -> DataFrame:
    """SNK-12, STR-07: one JSON line per record of a search trace, with its place in the file.

    trace (trace_id, goal), rounds (round_number, query), pages (round_number, position, url, summary), filtered
    (round_number, position, url, reason).
    """
    line = lambda kind, *cols: F.to_json(F.struct(F.lit(kind).alias("type"), *cols))
    zero = F.lit(0)
    parts = [
        trace.select(zero.alias("r"), zero.alias("k"), zero.cast("long").alias("p"), line("trace_header", "trace_id", "goal").alias("line")),
        rounds.select(F.col("round_number").alias("r"), F.lit(1).alias("k"), zero.cast("long").alias("p"), line("round_header", "round_number", "query").alias("line")),
        pages.select(F.col("round_number").alias("r"), F.lit(2).alias("k"), F.col("position").alias("p"), line("page", "round_number", "url", "summary").alias("line")),
        filtered.select(F.col("round_number").alias("r"), F.lit(3).alias("k"), F.col("position").alias("p"), line("filtered", "round_number", "url", "reason").alias("line")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_content(pages: DataFrame, group: str, order: str, url: str = "url", text: str = "text", size: int = 2000, separator: str = "\n\n---\n\n") -> DataFrame:
    """AGG-11: the distinct pages' texts, cut to size, joined in order."""
    first = keep_first(pages, F.concat_ws("\x01", F.col(group).cast("string"), F.col(url)), F.col(order))
    return first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), clipped(F.col(text), size).alias("t")))).alias("all")).select(group, F.array_join(F.transform("all", lambda x: x["t"]), separator).alias("content"))


def page_batches(pages: DataFrame, group: str, order: str, size: int = 8) -> DataFrame:
    """AGG-12: pages of a group, ``size`` at a time."""
    from .stores import rank_within

    return rank_within(pages, [group], [F.col(order)], "_rank").withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


def long_pages(pages: DataFrame, text: str = "text", least: int = 80) -> DataFrame:
    """FLT-20: pages with enough text to hold a listing."""
    return pages.where(F.length(text) >= least)


def trace_urls(records: DataFrame, kind: str = "page") -> DataFrame:
    """FLT-22: (round_number, position, url) of a trace's records (type, round_number, position, url) of one kind: page for
    what was crawled, filtered for what was left out."""
    return records.where(F.col("type") == kind).select("round_number", "position", "url")


def provider_rows(rows: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """FN-31, SRC-17: a provider's rows (key, order, url, title, description, snippet) as results, numbered from 1 in order.

    Rows without a url go; the description is the provider's, or else its snippet.
    """
    kept = rows.where("url is not null and url != ''").withColumn("description", F.coalesce("description", "snippet")).drop("snippet")
    ranked = kept.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return ranked if limit is None else ranked.where(F.col("position") <= limit)


def capped_links(pages: DataFrame, most: int = 100, html: str = "html", url: str = "url") -> DataFrame:
    """TOP-10: pages with at most so many of their links."""
    return pages.withColumn("links", F.slice(page_links(F.col(html), F.col(url)), 1, most))


def within_budget(candidates: DataFrame, order: list, per_round: int, max_pages: int, n_crawled: int) -> DataFrame:
    """TOP-08: the first candidates, as many as a round and the whole run still allow."""
    return candidates.orderBy(*order).limit(max(0, min(per_round, max_pages - n_crawled)))


def expansion_posters(posts: DataFrame, url: str = "url", failed: str | None = None) -> DataFrame:
    """SET-08: the distinct authors of posts by their urls, without failed posts and unknown authors."""
    from ..functions.text import status_user

    kept = posts if failed is None else posts.where(F.col(failed).isNull())
    return kept.select(status_user(F.col(url)).alias("username")).where("username is not null and username != 'unknown'").distinct()


def matched_results(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """JON-14: candidates with their crawl result, by url: neither order nor number of the results matters."""
    first = results.groupBy("url").agg(F.min_by(F.struct(*[c for c in results.columns if c != "url"]), F.coalesce("status_code", F.lit(0))).alias("_r"))
    return candidates.join(first.select("url", "_r.*"), "url", "left")
