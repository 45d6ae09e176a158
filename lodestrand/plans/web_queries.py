"""Queries over crawled pages: links, filters, orders, frontiers, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T, url as U
from ..operators import web as X
from ..sources.state import checkpointed
from ..sources.stub import stub_results
from .registered import query, table

HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
ROOT_SQL = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
LINKS_SQL = f"""
    h AS (SELECT page_id, url, list_filter(regexp_extract_all(html, 'href=["''](.*?)["'']', 1), lambda x: NOT regexp_matches(x, '^(#|javascript:|mailto:|tel:)')) AS raw FROM pages),
    a AS (SELECT page_id, url, list_filter(list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN x WHEN starts_with(x, '/') THEN {ROOT_SQL} || x ELSE x END), lambda x: regexp_matches(x, '^https?://')) AS ls FROM h),
    links AS (SELECT page_id, url, link, min(i) AS i FROM (SELECT page_id, url, i, ls[i] AS link FROM a, unnest(range(1, len(ls) + 1)) u(i)) GROUP BY ALL)"""
BLOCKED = ("example.net", "m.tharesh.example.com", "tionsh.example.net")
PREFERRED = ("example.org", "blog.tionble.example.com")


def _on(host: str, domain: str) -> str:
    return f"({host} = '{domain}' OR ends_with({host}, '.{domain}'))"


@query("fn08_links", f"WITH {LINKS_SQL} SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position FROM links")
def fn08_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(U.page_links(F.col("html"), F.col("url"))).alias("position", "link"))


@query("fn10_url_parts", f"""SELECT page_id, {HOST_SQL} AS host, array_to_string(string_split({HOST_SQL}, '.')[-2:], '.') AS domain,
    ends_with(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '.pdf') AS pdf FROM pages""")
def fn10_url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", U.hostname(u).alias("host"), U.registered_domain(u).alias("domain"), U.is_pdf(u).alias("pdf"))


@query("fn07_file_stems", r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[^\p{L}\p{N}_.-]', '_', 'g')[1:200] AS stem, lower(regexp_extract(url, '[.]([^./]+)$', 1)) AS file_type FROM pages")
def fn07_file_stems(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.file_stem(F.col("url")).alias("stem"), T.file_type(F.col("url")).alias("file_type"))


@query("flt06_followed_links", f"WITH {LINKS_SQL} SELECT page_id, link FROM links WHERE regexp_matches(link, '/[a-t]') AND NOT regexp_matches(link, 'tion') AND NOT regexp_matches(link, '\\.pdf$')")
def flt06_followed_links(spark, sf):
    return X.link_graph(table(spark, sf, "pages"), follow=("/[a-t]",), exclude=("tion", r"\.pdf$"), keys=("page_id",)).select("page_id", "link")


@query("flt07_same_domain", f"WITH {LINKS_SQL} SELECT page_id, link FROM links WHERE array_to_string(string_split({HOST_SQL}, '.')[-2:], '.') = array_to_string(string_split({HOST_SQL.replace('url', 'link')}, '.')[-2:], '.')")
def flt07_same_domain(spark, sf):
    return X.same_domain(X.link_graph(table(spark, sf, "pages"), keys=("page_id",))).select("page_id", "link")


@query("flt08_safe_urls", """
    WITH u AS (SELECT page_id, page_id % 6 AS k, url FROM pages), v AS (SELECT page_id, CASE k WHEN 0 THEN url WHEN 1 THEN 'file:///etc/x' WHEN 2 THEN 'http://user:pw@host.example/' WHEN 3 THEN 'http://10.0.0.' || page_id WHEN 4 THEN 'http://localhost/' || page_id ELSE 'https://8.8.8.8/' END AS url, k FROM u)
    SELECT page_id, k IN (0, 5) AS safe FROM v""")
def flt08_safe_urls(spark, sf):
    k, i = F.col("page_id") % 6, F.col("page_id").cast("string")
    url = F.when(k == 0, F.col("url")).when(k == 1, "file:///etc/x").when(k == 2, "http://user:pw@host.example/").when(k == 3, F.concat(F.lit("http://10.0.0."), i)).when(k == 4, F.concat(F.lit("http://localhost/"), i)).otherwise("https://8.8.8.8/")
    return table(spark, sf, "pages").select("page_id", U.safe_url(url).alias("safe"))


@query("flt09_live_urls", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 451 END AS status, page_id % 5 IN (0, 1, 3) AS live FROM pages")
def flt09_live_urls(spark, sf):
    k = F.col("page_id") % 5
    status = F.when(k == 1, 200).when(k == 2, 404).when(k == 3, 500).when(k == 4, 451)
    return table(spark, sf, "pages").select("page_id", status.alias("status"), (~U.dead(status, U.safe_url(F.col("url")))).alias("live"))


@query("flt10_blocked_domains", f"""SELECT page_id, CASE {' '.join(f"WHEN {_on(HOST_SQL, d)} THEN '{d}'" for d in BLOCKED)} END AS blocked_by FROM pages""")
def flt10_blocked_domains(spark, sf):
    allowed, filtered = X.split_blocked(table(spark, sf, "pages"), BLOCKED)
    return allowed.select("page_id", F.lit(None).cast("string").alias("blocked_by")).union(filtered.select("page_id", "blocked_by"))


@query("top06_preferred_order", f"""SELECT page_id, row_number() OVER (ORDER BY CASE {' '.join(f"WHEN {_on(HOST_SQL, d)} THEN {i}" for i, d in enumerate(PREFERRED))} ELSE {len(PREFERRED)} END, page_id) AS place FROM pages QUALIFY place <= 50""")
def top06_preferred_order(spark, sf):
    from pyspark.sql import Window as W

    first = table(spark, sf, "pages").select("page_id", X.preferred_order(U.hostname(F.col("url")), PREFERRED).alias("p")).orderBy("p", "page_id").limit(50)  # the report's length
    return first.select("page_id", F.row_number().over(W.orderBy("p", "page_id")).alias("place"))


@query("flt11_stale_content", """SELECT page_id, CASE WHEN regexp_matches(html, '(?is)no longer') THEN 'no longer' WHEN regexp_matches(html, '(?is)(?i)TIONSH.*the') THEN '(?i>TIONSH.*the' WHEN regexp_matches(html, '(?is)queen') THEN 'queen' END AS stale_by,
    regexp_matches(html, '(?is)nicht') OR regexp_matches(html, '(?is)the') AS required FROM pages""")
def flt11_stale_content(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", X.first_stale(h, ("no longer", "(?i>TIONSH.*the", "[broken", "queen")).alias("stale_by"), X.has_required(h, ("nicht", "the")).alias("required"))


@query("flt13_live_listings", "SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'SOLD out' WHEN 'P' THEN NULL ELSE 'open' END AS o_orderstatus FROM orders) WHERE o_orderstatus IS NULL OR NOT regexp_matches(lower(o_orderstatus), 'sold|ended|expired|pending|closed|completed')")
def flt13_live_listings(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "SOLD out").when(F.col("o_orderstatus") != "P", "open")
    return table(spark, sf, "orders").select("o_orderkey", status.alias("o_orderstatus")).where(X.live_listing(F.col("o_orderstatus")))


@query("flt14_relevance", "SELECT page_id, NOT (contains(t, 'xqtionsh') OR contains(t, '.html') OR contains(t, 'verein')) AS relevant FROM (SELECT page_id, lower(url || '  ' || html) AS t FROM pages)")
def flt14_relevance(spark, sf):
    words = X.bad_words(F.lit("Good: prose\nBad: xqTionsh, .html , verein"))
    return table(spark, sf, "pages").select("page_id", X.relevant(F.col("url"), F.lit(None), F.col("html"), words).alias("relevant"))


@query("flt15_verdicts", "SELECT doc_id, NOT (quality = 0 AND toxic = 0) AS kept FROM labels")
def flt15_verdicts(spark, sf):
    answer = F.when(F.col("quality") == 1, "GOOD").when(F.col("toxic") == 0, " bad.").otherwise("hard to say: good or bad")
    return table(spark, sf, "labels").select("doc_id", T.judged_good(answer).alias("kept"))


@query("flt19_page_texts", r"SELECT doc_id, regexp_replace(coalesce(CASE WHEN doc_id % 3 <> 0 THEN text END, '') || chr(10) || coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, ''), '^\s+|\s+$', '', 'g') AS content FROM documents")
def flt19_page_texts(spark, sf):
    md, raw = F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return table(spark, sf, "documents").select("doc_id", X.page_text(md, raw).alias("content"))


@query("flt20_long_pages", "SELECT doc_id FROM documents WHERE length(text) >= 80 AND text IS NOT NULL")
def flt20_long_pages(spark, sf):
    return X.long_pages(table(spark, sf, "documents")).select("doc_id")


@query("src18_stub_search", """SELECT item_id, i AS position, 'https://example.com/' || replace(lower(text), ' ', '-')[1:30] || '-' || i AS url FROM benchmark, unnest(range(1, 6)) u(i)""")
def src18_stub_search(spark, sf):
    return stub_results(table(spark, sf, "benchmark"), "item_id", "text", 5).select("item_id", "position", "url")


@query("src22_page_documents", "SELECT page_id AS document_id, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN '' ELSE url END, ''), html) AS text, url AS source FROM pages")
def src22_page_documents(spark, sf):
    from ..sources.pages import as_documents

    rows = table(spark, sf, "pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, "").otherwise(F.col("url")).alias("markdown"), F.col("html").alias("content"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("error"))
    return as_documents(rows, "page_id").select(F.col("page_id").alias("document_id"), "text", "source")


@query("set01_first_results", f"SELECT min(page_id) AS page_id, {HOST_SQL} AS host FROM pages WHERE {HOST_SQL} NOT IN (SELECT {HOST_SQL} FROM pages WHERE page_id < 10) GROUP BY 2")
def set01_first_results(spark, sf):
    p = table(spark, sf, "pages")
    out = X.keep_first(p, U.hostname(F.col("url")), F.col("page_id"), p.where("page_id < 10"), U.hostname(F.col("url")))
    return out.select("page_id", U.hostname(F.col("url")).alias("host"))


@query("set02_listing_keys", "SELECT regexp_replace(lower(regexp_extract(url, '^[^?#]*')), '/+$', '') AS url_key, min(page_id) AS page_id FROM pages GROUP BY 1")
def set02_listing_keys(spark, sf):
    key = X.listing_key(F.regexp_extract("url", "^[^?#]*", 0))
    return X.keep_first(table(spark, sf, "pages"), key, F.col("page_id")).select(key.alias("url_key"), "page_id")


@query("set04_sitemap_union", f"WITH {LINKS_SQL} SELECT url FROM pages UNION SELECT link FROM links")
def set04_sitemap_union(spark, sf):
    p = table(spark, sf, "pages")
    found = p.select(F.explode(U.page_links(F.col("html"), F.col("url"))).alias("url"))
    return p.select("url").union(found).distinct()


@query("agg07_distinct_hosts", f"SELECT count(DISTINCT {HOST_SQL}) AS n_hosts, count(DISTINCT url) AS n_urls FROM pages")
def agg07_distinct_hosts(spark, sf):
    return table(spark, sf, "pages").agg(F.countDistinct(U.hostname(F.col("url"))).alias("n_hosts"), F.countDistinct("url").alias("n_urls"))


@query("agg08_top_hosts", f"SELECT {HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 15")
def agg08_top_hosts(spark, sf):
    return X.host_counts(table(spark, sf, "pages"))


@query("agg11_merged_content", "WITH f AS (SELECT source, lang, min_by(text, doc_id) AS t, min(doc_id) AS o FROM documents GROUP BY 1, 2) SELECT source, string_agg(CASE WHEN length(t) > 300 THEN t[1:300] || chr(10) || chr(10) || '[... truncated ...]' ELSE t END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY o) AS content FROM f GROUP BY source")
def agg11_merged_content(spark, sf):
    return X.merged_content(table(spark, sf, "documents"), "source", "doc_id", "lang", "text", 300)


@query("agg12_page_batches", "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents")
def agg12_page_batches(spark, sf):
    return X.page_batches(table(spark, sf, "documents"), "source", "doc_id").select("doc_id", "source", "batch")


@query("gra06_crawl_waves", """
    WITH RECURSIVE l AS (SELECT page_id AS u, (page_id * 3 + 1) % 250 AS v FROM pages UNION ALL SELECT page_id, (page_id * 7 + 2) % 250 FROM pages),
    w AS (SELECT page_id AS u FROM pages), f AS (SELECT 0 AS u, 0 AS depth UNION SELECT l.v, f.depth + 1 FROM f JOIN l ON l.u = f.u JOIN w ON w.u = l.v WHERE f.depth < 4)
    SELECT url, depth FROM (SELECT u, min(depth) AS depth FROM f GROUP BY u) JOIN pages ON page_id = u ORDER BY depth, url LIMIT 12""")
def gra06_crawl_waves(spark, sf):
    checkpointed(spark)
    p = table(spark, sf, "pages").select("page_id", "url")
    to = p.select(F.col("page_id").alias("v"), F.col("url").alias("link"))
    links = p.select("url", F.explode(F.array((F.col("page_id") * 3 + 1) % 250, (F.col("page_id") * 7 + 2) % 250)).alias("v")).join(to, "v").select("url", "link")
    return X.crawl(p, links, p.where("page_id = 0"), 4, 12)


@query("snk12_trace_lines", """
    SELECT 0 AS r, 0 AS k, 0::BIGINT AS p, '{"type":"trace_header","trace_id":"t1","goal":"hosts"}' AS line
    UNION ALL SELECT DISTINCT (page_id % 3)::INT, 1, 0, '{"type":"round_header","round_number":' || page_id % 3 || ',"query":"q' || page_id % 3 || '"}' FROM pages
    UNION ALL SELECT (page_id % 3)::INT, 2, page_id, '{"type":"page","round_number":' || page_id % 3 || ',"url":"' || url || '","summary":"' || page_id || '"}' FROM pages WHERE page_id % 5 <> 0
    UNION ALL SELECT (page_id % 3)::INT, 3, page_id, '{"type":"filtered","round_number":' || page_id % 3 || ',"url":"' || url || '","reason":"blocked_domain"}' FROM pages WHERE page_id % 5 = 0""")
def snk12_trace_lines(spark, sf):
    p = table(spark, sf, "pages").withColumn("round_number", (F.col("page_id") % 3).cast("int")).withColumn("position", F.col("page_id"))
    trace = spark.range(1).select(F.lit("t1").alias("trace_id"), F.lit("hosts").alias("goal"))
    rounds = p.select("round_number", F.concat(F.lit("q"), F.col("round_number").cast("string")).alias("query")).distinct()
    good, bad = p.where("page_id % 5 != 0").withColumn("summary", F.col("page_id").cast("string")), p.where("page_id % 5 = 0").withColumn("reason", F.lit("blocked_domain"))
    return X.trace_lines(trace, rounds, good, bad)


@query("fn11_augmented_queries", "SELECT item_id, text || ' -sold -expired site:example.com' AS q FROM benchmark")
def fn11_augmented_queries(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.augmented_query(F.col("text"), F.array(F.lit("sold"), F.lit("expired")), F.array(F.lit("example.com"))).alias("q"))


@query("top08_crawl_budget", "SELECT page_id FROM pages ORDER BY page_id LIMIT 30")
def top08_crawl_budget(spark, sf):
    return X.within_budget(table(spark, sf, "pages").select("page_id"), ["page_id"], 40, 100, 70)