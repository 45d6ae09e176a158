"""The multi-round search, crawl and filter loop, over pluggable providers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.url import hostname
from ..operators import web
from ..sources.state import cut

#: A provider answers queries (round_number, query) with results (round_number, position, url, title, description).
Provider = Callable[[DataFrame], DataFrame]
#: A fetcher adds status_code, markdown, content and error to candidates (url).
Fetcher = Callable[[DataFrame], DataFrame]


@dataclass
class Strategy:
    """FLT-10 to FLT-14, TOP-06, TOP-08: what a run may crawl and keep."""

    blocked: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()
    stale: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    bad_words: tuple[str, ...] = ()
    per_round: int = 10
    max_pages: int = 50
    max_rounds: int = 3


@dataclass
class Trace:
    """What a run did, as tables: rounds, pages kept, candidates filtered with their reason."""

    rounds: DataFrame
    pages: DataFrame
    filtered: DataFrame
    queries: list[str] = field(default_factory=list)


def search_and_crawl(spark, queries: list[str], search: Provider, fetch: Fetcher, strategy: Strategy) -> Trace:
    """GRA-07: a round for each query until the pages are enough, the rounds are over, or no candidate is left.

    Each round is a chain of lazy steps: search, first of each url, anti-join with what was crawled, blocked domains,
    preferred order, relevance, the page budget, fetching, content filters. Rounds are cut by a checkpoint; only counts
    reach the driver.
    """
    page_schema = "round_number int, position long, url string, title string, summary string"
    pages = spark.createDataFrame([], page_schema)
    filtered = spark.createDataFrame([], "round_number int, position long, url string, reason string")
    crawled, n_pages, asked = spark.createDataFrame([], "url string"), 0, []
    for number, query in enumerate(queries[: strategy.max_rounds], 1):
        budget = min(strategy.per_round, strategy.max_pages - n_pages)
        if budget <= 0:
            break
        asked.append(query)
        found = search(spark.createDataFrame([(number, query)], "round_number int, query string"))
        found = web.keep_first(found, F.col("url"), F.col("position"), crawled, F.col("url"))
        by = found.withColumn("blocked_by", web.blocked_by(hostname(F.col("url")), strategy.blocked))
        good = web.relevant(F.col("url"), F.col("title"), F.col("description"), F.array(*[F.lit(w.lower()) for w in strategy.bad_words]).cast("array<string>"))
        judged = by.withColumn("reason", F.when(F.col("blocked_by").isNotNull(), "blocked_domain").when(~good, "irrelevant"))
        order = web.preferred_order(hostname(F.col("url")), strategy.preferred) if strategy.preferred else F.lit(0)
        candidates = cut(judged.where("reason is null").withColumn("p", order).orderBy("p", "position").limit(budget).drop("p"))
        dropped = judged.where("reason is not null").select("round_number", "position", "url", "reason")
        if candidates.isEmpty():
            filtered = cut(filtered.union(dropped))
            break
        text = web.page_text(F.col("markdown"), F.col("content"))
        got = fetch(candidates).withColumn("text", text)
        why = F.when(F.col("error").isNotNull(), "fetch_failed").when(web.first_stale(F.col("text"), strategy.stale).isNotNull(), "stale_content").when(~web.has_required(F.col("text"), strategy.required), "missing_required")
        got = cut(got.withColumn("reason", why))
        pages = cut(pages.union(got.where("reason is null").select("round_number", "position", "url", "title", F.substring("text", 1, 500).alias("summary"))))
        filtered = cut(filtered.union(dropped).union(got.where("reason is not null").select("round_number", "position", "url", "reason")))
        crawled = cut(crawled.union(candidates.select("url")))
        n_pages = pages.count()
    rounds = spark.createDataFrame(list(enumerate(asked, 1)), "round_number int, query string")
    return Trace(rounds, pages, filtered, asked)


@dataclass
class Listings:
    """What a listing run found: the listings kept, what was left out with its reason, and the queries asked."""

    kept: DataFrame
    rejected: DataFrame
    queries: list[str]


def research_listings(spark, goal: str, search: Provider, fetch: Fetcher, model, strategy: Strategy, wanted: int = 10, max_rounds: int = 5, progress: Callable[[dict], None] | None = None) -> Listings:
    """GRA-08: queries one after the other until enough listings hold; when they are used up, the model proposes more.

    A round searches, crawls what is new, gathers the listings of its pages, leaves out those that are there already (SET-02)
    or gone (FLT-13), and has the model judge the rest. progress hears of each round (STR-09).
    """
    from ..operators import answers

    planner = answers.Planner(lambda prompt: model([prompt])[0])
    waiting, asked = planner.plan(goal), []
    schema = "listing_url string, title string, price string, status string, page string, passed boolean, reason string"
    kept = rejected = spark.createDataFrame([], schema)
    crawled = spark.createDataFrame([], "url string")
    for number in range(1, max_rounds + 1):
        if not waiting:
            titles = "\n".join(r[0] or "" for r in kept.select("title").limit(20).collect())
            waiting = planner.more(goal, asked, titles)
            if not waiting:
                break
        query = waiting.pop(0)
        asked.append(query)
        found = web.keep_first(search(spark.createDataFrame([(number, query)], "round_number int, query string")), F.col("url"), F.col("position"), crawled, F.col("url"))
        found = found.where(web.blocked_by(hostname(F.col("url")), strategy.blocked).isNull())
        chosen = cut(web.within_budget(found, ["position"], strategy.per_round, strategy.max_pages, crawled.count()))
        if not chosen.isEmpty():
            pages = cut(fetch(chosen).where("error is null").withColumn("text", web.page_text(F.col("markdown"), F.col("content"))))
            listed = answers.gathered_listings(pages, model)
            known = kept.select("listing_url").union(rejected.select("listing_url"))
            fresh = web.keep_first(listed, web.listing_key(F.col("listing_url")), F.col("listing_url"), known, web.listing_key(F.col("listing_url")))
            fresh = cut(fresh.withColumn("live", web.live_listing(F.col("status"))))
            judged = cut(answers.validated_items(fresh.where("live").withColumn("round", F.lit(number)), model, "listing_url", "title", "round").select(*kept.columns))
            gone = fresh.where("not live").withColumns({"passed": F.lit(False), "reason": F.lit("gone")}).select(*kept.columns)
            kept = cut(kept.unionByName(judged.where("passed")))
            rejected = cut(rejected.unionByName(judged.where("not passed")).unionByName(gone))
            crawled = cut(crawled.union(chosen.select("url")))
        n = kept.count()
        if progress:
            progress({"round": number, "query": query, "listings": n})
        if n >= wanted:
            break
    return Listings(kept.limit(wanted), rejected, asked)


def search_and_expand(posts: DataFrame, follows: DataFrame, top: int = 10, levels: int = 1, users_per_level: int = 50) -> tuple[DataFrame, DataFrame]:
    """GRA-09: posts found by a search (url, score, error) -> the best ``top`` of them, and the users reached from their
    authors over follower edges (user, follower), with their level."""
    from ..operators.graph import expand_users

    best = cut(posts.where("error is null").orderBy(F.desc("score"), "url").limit(top))
    seeds = web.expansion_posters(best).select(F.col("username").alias("user"))
    return best, expand_users(follows, seeds, levels, users_per_level)


def result_rows(posts: DataFrame, replies: DataFrame) -> DataFrame:
    """SRC-13: posts (post_id, text, author, replied_to) with the text of the post they reply to, which is fetched once
    however many reply to it; replies (post_id, text) is what was fetched."""
    parents = replies.groupBy(F.col("post_id").alias("replied_to")).agg(F.min("text").alias("parent_text"))
    return posts.join(parents, "replied_to", "left")


def offline_web(pages: DataFrame, html: str = "html") -> Fetcher:
    """A fetcher that answers from a table of pages (url, html); a url that isn't there has failed."""

    def fetch(candidates: DataFrame) -> DataFrame:
        known = pages.select("url", F.col(html).alias("content"))
        return candidates.join(known, "url", "left").withColumns({"status_code": F.when(F.col("content").isNotNull(), 200).otherwise(0), "markdown": F.lit(None).cast("string"), "error": F.when(F.col("content").isNull(), "not found")})

    return fetch
