"""URL filters: pattern rules, indexed by their rarest literal token, with built-in functions only.

A rule is a regular expression over ``host + path`` and the whole tokens that any url it matches must have: labels of
the host (``h:``) and complete segments of the path (``p:``). How often the rules' tokens occur is counted over all
urls, each rule is filed under its rarest token, and a url's tokens fetch their rules from the index by an equi-join.
Only these rules' expressions run on the url. A rule without a whole token is filed under ``*``, which every url
has while there is such a rule.

The index is broadcast while there are at most MAX_BROADCAST rules, so that a token most urls have doesn't gather them;
beyond that it is an equi-join between shuffles, which adaptive execution splits. Both sides of the last join read their
row ids from one numbered table (see common.numbered).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, numbered

ANY = "*"
#: Rules whose index may be broadcast, about 200 bytes each.
MAX_BROADCAST = 100_000


@dataclass(frozen=True)
class Rule:
    """rule: its name in results, or None for one that only gives a verdict. Of the rules that match a url the one
    with the highest rank wins."""

    regex: str
    tokens: tuple[str, ...]
    verdict: str
    rank: tuple
    rule: str | None = None
    pattern: str = ""


def _quote(text: str) -> str:
    return re.sub(r"([^\w/-])", r"\\\1", text, flags=re.ASCII)


def host_path_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and all its subdomains where the url's path starts with the rule's. Longest wins."""
    host, _, path = text.partition("/")
    path = f"/{path}" if "/" in text else ""
    end = _quote(path) if path else r"(?:/|\z)"
    segments = path.split("/")[1:-1]  # what follows the last slash may go on in the url
    tokens = [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in segments if x]
    return Rule(rf"\A(?:[^/]*\.)?{_quote(host)}{end}", tuple(tokens), verdict, (1, len(text), text), text, text)


def segment_rule(segment: str, verdict: str = "block") -> Rule:
    """A complete segment anywhere in the path."""
    return Rule(rf"/{_quote(segment)}(?:/|\z)", (f"p:{segment}",), verdict, (0, len(segment), segment), None, f"*/{segment}/*")


#: Pages without prose of their own: blocked where no host rule says otherwise.
SEGMENTS = ("login", "signup", "register", "cart", "checkout", "wp-admin", "cgi-bin", "casino", "porn")
HOST_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def default_rules() -> list[Rule]:
    return [host_path_rule(*x) for x in HOST_RULES] + [segment_rule(x) for x in SEGMENTS]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column, any_too: bool) -> Column:
    labels = F.transform(F.split(host, "[.]"), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(ANY))) if any_too else F.concat(labels, segments))


def rule_index(spark: SparkSession, urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """rules -> token, regex, priority, rule, verdict, pattern; urls (tokens) decide which token of a rule is rarest."""
    ordered = sorted(rules, key=lambda r: r.rank)
    table = spark.createDataFrame([(i, list(r.tokens), r.regex, r.rule, r.verdict, r.pattern) for i, r in enumerate(ordered)], "priority int, tokens array<string>, regex string, rule string, verdict string, pattern string")
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    # Counted before the join: each task sums its own urls' tokens, so one that most urls have is a few rows.
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(wanted, "token", "left_semi")
    choices = table.select("priority", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = choices.groupBy("priority").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return table.join(rarest, "priority", "left").withColumn("token", F.coalesce("token", F.lit(ANY))).drop("tokens")


def judge_urls(pages: DataFrame, url: str = "url", rules: list[Rule] | None = None, keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """pages -> the columns in keep, host, path, rule, verdict, pattern (what decided, if anything).

    A null url or one without ``://`` has an empty host and path, which rules may still match. One row for each input
    row, repeated rows included; equal ranks can't occur among different rules, and the same rule twice counts once.
    Whole urls are read, however long. Empty tables give no rows. Columns of pages that aren't in keep are not read, so
    their names can't clash; columns in keep may have any name but those of the results.
    """
    spark, rules = pages.sparkSession, list({r.rank: r for r in (default_rules() if rules is None else rules)}.values())
    urls = pages.select(*[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = numbered(urls, "rid", "urls")
    tokens = urls.select("rid", F.concat("host", "path").alias("subject"), tokens_of(F.col("host"), F.col("path"), not all(r.tokens for r in rules)).alias("tokens"))
    index = rule_index(spark, tokens, rules)
    small = F.broadcast if len(rules) <= MAX_BROADCAST else (lambda df: df)
    fetched = tokens.select("rid", "subject", F.explode("tokens").alias("token")).join(small(index.select("token", "regex", "priority")), "token")
    best = fetched.where(F.expr("subject rlike regex")).groupBy("rid").agg(F.max("priority").alias("priority"))
    found = urls.join(best, "rid", "left").join(small(index.select("priority", "rule", "verdict", "pattern")), "priority", "left")
    return found.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "pattern")
