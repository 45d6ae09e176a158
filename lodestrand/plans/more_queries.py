"""Queries for the remaining small operators: set forms, windows, store reads, caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T, url as U
from ..operators import chunk as C, graph as G, retrieve as R, stores as S, web as X
from .registered import query, table
from .retrieval_queries import kept_index
from .web_queries import HOST_SQL, LINKS_SQL


@query("src20_store_reads", "SELECT conv_id, turn, text FROM conversations WHERE conv_id IN (3, 5, 8)")
def src20_store_reads(spark, sf):
    return S.by_ids(table(spark, sf, "conversations"), [3, 5, 8], "conv_id").select("conv_id", "turn", "text")


@query("src20_store_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def src20_store_counts(spark, sf):
    return S.row_counts(table(spark, sf, "documents"), "lang")


@query("flt16_embedded", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def flt16_embedded(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return S.embedded(docs).select("doc_id")


@query("flt18_normalised_attributes", "SELECT event_id, event_type AS kind, '[' || user_id || ',' || event_id || ']' AS pair, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR END AS maybe FROM events")
def flt18_normalised_attributes(spark, sf):
    rows = table(spark, sf, "events")
    given = F.create_map(F.lit("kind"), F.to_json(F.struct("event_type")).substr(15, 10**6), F.lit("pair"), F.to_json(F.array("user_id", "event_id")), F.lit("maybe"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")))
    given = F.transform_values(given, lambda k, v: F.when(k == "kind", F.regexp_replace(v, r"\}$", "")).otherwise(v))
    return rows.select("event_id", S.normalised_attributes(given).alias("m")).select("event_id", *[F.col("m")[k].alias(k) for k in ("kind", "pair", "maybe")])


@query("flt22_trace_urls", "SELECT page_id % 3 AS round_number, page_id AS position, url FROM pages WHERE page_id % 5 <> 0")
def flt22_trace_urls(spark, sf):
    kind = F.when(F.col("page_id") % 5 != 0, "page").otherwise("filtered")
    records = table(spark, sf, "pages").select(kind.alias("type"), (F.col("page_id") % 3).alias("round_number"), F.col("page_id").alias("position"), "url")
    return X.trace_urls(records)


@query("jon06_frontier", f"WITH {LINKS_SQL} SELECT DISTINCT link AS url FROM links WHERE link NOT IN (SELECT link FROM links WHERE page_id < 50)")
def jon06_frontier(spark, sf):
    links = X.link_graph(table(spark, sf, "pages"), keys=("page_id",))
    return links.select(F.col("link").alias("url")).distinct().join(links.where("page_id < 50").select(F.col("link").alias("url")), "url", "left_anti")


@query("set03_gathered_listings", "SELECT regexp_replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '/+$', '') AS url_key, min(page_id) AS page_id FROM (SELECT page_id, '  ' || regexp_extract(url, '^[^?#]*') || '/ ' AS url FROM pages) GROUP BY 1")
def set03_gathered_listings(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit("  "), F.regexp_extract("url", "^[^?#]*", 0), F.lit("/ ")).alias("url"))
    key = X.listing_key(F.col("url"), fold=False)
    return X.keep_first(rows, key, F.col("page_id")).select(key.alias("url_key"), "page_id")


@query("set05_undirected", "SELECT n_nationkey AS a, n_regionkey + 100 AS b FROM nation UNION SELECT n_regionkey + 100, n_nationkey FROM nation")
def set05_undirected(spark, sf):
    return G.undirected(table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 100).alias("b")), "a", "b")


@query("set06_distinct_links", f"WITH {LINKS_SQL} SELECT page_id, count(*) AS n FROM links GROUP BY 1")
def set06_distinct_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(U.page_links(F.col("html"), F.col("url"))).cast("long").alias("n")).where("n > 0")


@query("set07_new_queries", "SELECT lower(trim(o_orderpriority)) AS q, min(o_orderkey) AS o_orderkey FROM orders WHERE lower(trim(o_orderpriority)) <> '1-urgent' GROUP BY 1")
def set07_new_queries(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" "), F.col("o_orderpriority")).alias("q"))
    tried = spark.createDataFrame([("1-URGENT ",)], "q string")
    key = lambda c: F.lower(T.strip(c))
    return X.keep_first(rows, key(F.col("q")), F.col("o_orderkey"), tried, key(F.col("q"))).select(key(F.col("q")).alias("q"), "o_orderkey")


@query("set09_trace_pages", f"SELECT {HOST_SQL} AS url, min(page_id) AS page_id FROM pages GROUP BY 1")
def set09_trace_pages(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", U.hostname(F.col("url")).alias("url"))
    return X.keep_first(rows, F.col("url"), F.col("page_id")).select("url", "page_id")


@query("win02_ranks", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank FROM documents")
def win02_ranks(spark, sf):
    return S.rank_within(table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n")), ["lang"], [F.desc("n"), F.col("doc_id")]).select("doc_id", "lang", "rank")


@query("win03_last_above", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM conversations")
def win03_last_above(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return C.last_above(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "last_user").drop("role")


@query("win04_section_ends", "SELECT conv_id, turn, lead(turn, 1, 99) OVER (PARTITION BY conv_id ORDER BY turn) AS section_end, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS chars FROM conversations")
def win04_section_ends(spark, sf):
    return C.section_ends(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text"), 99).select("conv_id", "turn", "section_end", "chars")


@query("top07_position_order", "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn")
def top07_position_order(spark, sf):
    return S.in_position_order(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("top10_capped_links", f"WITH {LINKS_SQL} SELECT page_id, least(count(*), 5)::BIGINT AS n FROM links GROUP BY 1")
def top10_capped_links(spark, sf):
    return X.capped_links(table(spark, sf, "pages"), 5).select("page_id", F.size("links").cast("long").alias("n")).where("n > 0")


@query("fn27_document_types", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1")
def fn27_document_types(spark, sf):
    kind = T.file_type(F.concat(F.lit("/in/x."), F.upper("lang")))
    return table(spark, sf, "documents").groupBy(kind.alias("lang")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("fn31_provider_rows", "SELECT page_id, url, coalesce(CASE WHEN page_id % 2 = 0 THEN 'd' || page_id END, 's' || page_id) AS description, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS position FROM pages WHERE page_id % 7 <> 0 QUALIFY position <= 20")
def fn31_provider_rows(spark, sf):
    i = F.col("page_id").cast("string")
    rows = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 50).alias("query_id"), F.when(F.col("page_id") % 7 != 0, F.col("url")).otherwise("").alias("url"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("d"), i)).alias("description"), F.concat(F.lit("s"), i).alias("snippet"))
    return X.provider_rows(rows, "query_id", "page_id", 20).select("page_id", "url", "description", "position")


@query("fn33_rejections", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS fails FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k <= 3 GROUP BY 1")
def fn33_rejections(spark, sf):
    return G.rejections(table(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey")


@query("agg13_children", "SELECT n_regionkey AS parent, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS children FROM nation GROUP BY 1")
def agg13_children(spark, sf):
    return G.children_of(table(spark, sf, "nation"), "n_regionkey", "n_nationkey").select("parent", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


@query("agg02_incremental_index", r"""
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY 1""")
def agg02_incremental_index(spark, sf):
    """Two loads of an index; the second reads its own documents only, and the counts come from the blocks' heads."""
    return kept_index(spark, sf).terms()


@query("snk03_flat_payload", """SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '"}' AS extra_json FROM documents""")
def snk03_flat_payload(spark, sf):
    return S.flat_payload(table(spark, sf, "documents"), ["doc_id"], ["lang", "source"])


@query("snk13_cache_update", "SELECT doc_id, length(text) AS mtime FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id % 5 = 0")
def snk13_cache_update(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").alias("mtime"))
    changes = docs.where("doc_id % 5 = 0").select("doc_id", F.lit(-1).alias("mtime"), F.lit(1).alias("seq"))
    return S.updated_cache(docs, changes, ["doc_id"])