"""Rules fetched by their rarest token against all rules on all urls."""

import itertools
import random
import re

from lodestrand.llm.url_rules import Rule, default_rules, host_path_rule, judge_urls, rule_index, segment_rule, tokens_of
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, rid string, verdict string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


def urls():
    rng = random.Random(5)
    hosts = ["example.com", "a.example.com", "EXAMPLE.com", "badexample.com", "net", "x.net", "example.net", "b.example.org", "com", "host.com:80", "é.com", ""]
    paths = ["", "/", "/en/", "/en", "/en/7", "/en/71?q=/de/8", "/de/8", "/de/80#x", "/de/", "/es/1", "/login", "/a/login/b", "/loginx", "/EN/7"]
    made = [f"{rng.choice(['http', 'https'])}://{h}{p}" for h, p in itertools.product(hosts, paths)]
    return made + [None, "", "no scheme/en/7", "://com/en/1", "x://y://com/en/7", "http://example.com/en/7", "http://h/" + "a/" * 5000 + "login"]


def plain(url, rules):
    host, path = parts(url)
    best = max((r for r in rules if re.search(r.regex.replace(r"\z", r"\Z"), host + path)), key=lambda r: r.rank, default=None)
    return host, path, best.rule if best else None, best.verdict if best else "allow"


def test_all_rules_on_all_urls(spark):
    rules = [*default_rules(), host_path_rule("example.com", "allow"), Rule(r"/\d+\z", (), "block", (0, 0, "number"), None, "number"), host_path_rule("é.com/de", "block")]
    pages = spark.createDataFrame([(i, u, "x", None) for i, u in enumerate(urls())] + [(0, urls()[0], "x", None)], SCHEMA)
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules=rules).collect())
    assert got == sorted((i, *plain(u, rules)) for i, u in [*enumerate(urls()), (0, urls()[0])])


def test_longest_wins(spark):
    pages = spark.createDataFrame([(1, "http://www.example.com/en/77"), (2, "http://www.example.com/en/8"), (3, "https://example.net/de/81"), (4, "https://q.net/de/81"), (5, "http://com/fr/1")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: ("example.net/de/8", "block"), 4: ("net/de/", "allow"), 5: (None, "allow")}


def test_rarest_token_files_the_rule(spark):
    rows = spark.createDataFrame([("a.com", "/x/"), ("b.com", "/x/"), ("c.com", "/y/")], "host string, path string").select(tokens_of(F.col("host"), F.col("path"), False).alias("tokens"))
    index = {r.rule or r.pattern: r.token for r in rule_index(spark, rows, [host_path_rule("com/x/", "block"), segment_rule("y"), host_path_rule("never.com/x/", "block")]).collect()}
    assert index == {"com/x/": "p:x", "*/y/*": "p:y", "never.com/x/": "h:never"}


def test_no_rules_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id long, url string")
    assert judge_urls(pages, rules=[]).first().verdict == "allow" and judge_urls(pages.where("page_id > 1")).count() == 0
