"""The fetching frontier against a breadth-first walk, with delays, failures and restarts."""

import os

import pytest

from lodestrand.streaming.frontier import crawl_web

SITES = {
    "http://a.example.com/": '<a href="/1">1</a><a href="http://b.example.com/x#top">b</a><a href="/private/z">z</a>',
    "http://a.example.com/1": '<a href="/2">2</a><a href="/">home</a><a href="http://www.example.net/far">far</a>',
    "http://a.example.com/2": '<a href="/3">3</a>',
    "http://a.example.com/3": '<a href="/4">4</a>',
    "http://a.example.com/private/z": "",
    "http://b.example.com/x": '<a href="http://a.example.com/2">2</a><a href="http://gone.example.com/">gone</a>',
    "http://www.example.net/far": "",
    "http://b.example.com/listed": '<a href="/x">x</a>',
    "http://a.example.com/sitemap.xml": "<sitemapindex><sitemap><loc>http://b.example.com/more.xml</loc></sitemap><sitemap><loc>http://a.example.com/sitemap.xml</loc></sitemap></sitemapindex>",
    "http://b.example.com/more.xml": "<urlset><url><loc> http://b.example.com/listed </loc></url></urlset>",
}


def fetcher(log=None, fails=None):
    sites = SITES

    def fetch(url):
        if log:
            with open(log, "a") as f:
                f.write(url + "\n")
        if fails and url.endswith("/3") and not os.path.exists(fails):
            open(fails, "w").close()
            raise RuntimeError("power cut")
        return (200, sites[url], None) if url in sites else (404, None, "status 404")

    return fetch


def walk(seeds, depth):
    import re
    from urllib.parse import urljoin

    seen, wave = dict.fromkeys(seeds, 1), list(seeds)
    for d in range(2, depth + 1):
        found = [urljoin(u, x).partition("#")[0] for u in wave for x in re.findall('href="(.*?)"', SITES.get(u, ""))]
        wave = [u for u in dict.fromkeys(found) if u not in seen]
        seen |= dict.fromkeys(wave, d)
    return seen


def run(spark, path, urls=("http://a.example.com/", None), **options):
    options.setdefault("fetch", fetcher())
    return crawl_web(spark.createDataFrame([(u,) for u in urls], "url string"), str(path), **options).collect()


def test_depths_failures_and_page_limit(spark, tmp_path):
    rows = run(spark, tmp_path / "x", max_depth=4)
    assert {r.url: r.depth for r in rows} == walk(["http://a.example.com/"], 4) and len(rows) == len({r.url for r in rows})
    gone = next(r for r in rows if "gone" in r.url)
    assert (gone.status_code, gone.content, gone.error) == (404, None, "status 404")
    first = run(spark, tmp_path / "y", max_depth=9, max_pages=3)
    assert sorted(r.url for r in first) == ["http://a.example.com/", "http://a.example.com/1", "http://a.example.com/private/z"]


def test_patterns_scope_and_sitemap(spark, tmp_path):
    rows = run(spark, tmp_path / "x", max_depth=9, exclude=("/private/",), same_domain=True, use_sitemap=True)
    assert {r.url for r in rows} == set(walk(["http://a.example.com/", "http://b.example.com/listed"], 9)) - {"http://a.example.com/private/z", "http://www.example.net/far"}
    rows = run(spark, tmp_path / "y", max_depth=9, follow=(r"/\d$",))
    assert {r.url for r in rows} == {"http://a.example.com/", "http://a.example.com/1", "http://a.example.com/2", "http://a.example.com/3"} | {u for u in ("http://a.example.com/4",)}


def test_a_host_s_requests_keep_their_distance(spark, tmp_path):
    urls = [f"http://a.example.com/{k}" for k in range(4)] + ["http://b.example.com/x"]
    rows = run(spark, tmp_path / "x", urls=urls, delay=1.0)
    times = sorted(r.asked_at for r in rows if r.host == "a.example.com")
    assert len(times) == 4 and all(b - a >= 1.0 for a, b in zip(times, times[1:])) and len(rows) == 5


def test_a_restart_goes_on(spark, tmp_path):
    log, fails = str(tmp_path / "log"), str(tmp_path / "fails")
    fetch = fetcher(log, fails)
    with pytest.raises(Exception, match="power cut"):
        run(spark, tmp_path / "x", max_depth=5, fetch=fetch)
    before = open(log).read().split()
    rows = run(spark, tmp_path / "x", max_depth=5, fetch=fetch)
    after = open(log).read().split()[len(before) :]
    assert {r.url: r.depth for r in rows} == walk(["http://a.example.com/"], 5) and len(rows) == len({r.url for r in rows})
    assert set(before) & set(after) <= {"http://a.example.com/3"}  # what the broken batch had asked for
    assert run(spark, tmp_path / "x", max_depth=5, fetch=fetch) and len(open(log).read().split()) == len(before) + len(after)


def test_no_seeds(spark, tmp_path):
    assert run(spark, tmp_path / "x", urls=(None,), max_depth=3) == []
