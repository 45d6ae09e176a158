"""Queries over a text model's answers (by stand-ins that SQL can restate), files, streams and small parsers."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import social, text as T
from ..models import facts_add_on
from ..operators import answers as A, retrieve as R, web as X
from ..sources import sinks
from .registered import query, table
from .text_queries import SENTENCES


@query("fn13_unfenced_json", "SELECT doc_id, '{\"k\": ' || doc_id || '}' AS answer FROM documents")
def fn13_unfenced_json(spark, sf):
    bare = F.concat(F.lit('{"k": '), F.col("doc_id").cast("string"), F.lit("}"))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), bare, F.lit("\n```\nDone."))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```\n"), bare, F.lit("```"))).otherwise(F.concat(F.lit("  "), bare, F.lit("\n")))
    return table(spark, sf, "documents").select("doc_id", T.unfenced_json(said).alias("answer"))


@query("fn15_bodies", "SELECT doc_id, regexp_replace(text, '^\\n+', '') AS body FROM documents WHERE NOT starts_with(text, '---')")
def fn15_bodies(spark, sf):
    docs = table(spark, sf, "documents").where(~F.startswith("text", F.lit("---")))
    return docs.select("doc_id", T.without_front_matter(F.concat(sinks.front_matter({"id": F.col("doc_id"), "none": F.lit(None)}), "text")).alias("body"))


@query("fn25_replied_to", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id::VARCHAR END AS parent FROM events")
def fn25_replied_to(spark, sf):
    quoted = F.struct(F.lit("quoted").alias("type"), F.lit("0").alias("id"))
    reply = F.struct(F.when(F.col("event_id") % 3 != 0, "replied_to").otherwise("retweeted").alias("type"), F.col("user_id").cast("string").alias("id"))
    return table(spark, sf, "events").select("event_id", T.replied_to(F.array(quoted, reply)).alias("parent"))


@query("fn18_post_texts", "SELECT event_id, '## Post by @user' || user_id || CASE WHEN event_id % 2 = 0 THEN ' (' || event_type || ')' ELSE '' END || chr(10) || event_type || chr(10) || '**Posted:** ' || event_id || chr(10) || format('{:,}', user_id) || ' likes, 0 reposts' AS post FROM events")
def fn18_post_texts(spark, sf):
    name = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    post = social.post_markdown(F.concat(F.lit("user"), F.col("user_id").cast("string")), name, F.col("event_type"), F.col("event_id"), F.col("user_id"), F.lit(None).cast("int"))
    return table(spark, sf, "events").select("event_id", post.alias("post"))


@query("fn19_day_windows", "SELECT event_id, epoch(date_trunc('day', ts))::BIGINT AS end_s, epoch(date_trunc('day', ts))::BIGINT - least(event_id % 100, 48) * 3600 AS begin_s FROM events")
def fn19_day_windows(spark, sf):
    w = social.day_window(F.col("ts").cast("timestamp"), F.col("event_id") % 100)
    return table(spark, sf, "events").select("event_id", w["end"].alias("end_s"), w["begin"].alias("begin_s"))


@query("fn34_plan_kinds", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus WHEN o_orderkey % 4 = 1 THEN 'listings' ELSE 'general' END AS kind FROM orders")
def fn34_plan_kinds(spark, sf):
    k = F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select("o_orderkey", social.plan_kind(F.when(k < 3, k == 1), F.when(k == 0, F.col("o_orderstatus")).otherwise("")).alias("kind"))


@query("src15_area_states", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'area' WHEN 1 THEN 'icao24' ELSE 'all' END AS kind, event_id % 3 = 0 AND event_id % 90 BETWEEN 10 AND 50 AND user_id % 180 BETWEEN 0 AND 60 AS inside FROM events")
def src15_area_states(spark, sf):
    k = F.col("event_id") % 3
    q = social.flight_query(F.when(k == 0, " Area: 10, 0,50,60").when(k == 1, "icao24:abc").otherwise("plain"))
    inside = (q["kind"] == "area") & social.in_area((F.col("event_id") % 90).cast("double"), (F.col("user_id") % 180).cast("double"), q["value"])
    return table(spark, sf, "events").select("event_id", q["kind"].alias("kind"), inside.alias("inside"))


@query("flt03_conditions", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source = 'src4'")
def flt03_conditions(spark, sf):
    return table(spark, sf, "documents").where(R.matches_where({"lang": {"$in": ["en", "fr"]}, "source": {"$eq": "src4"}})).select("doc_id")


@query("flt02_top_level_keys", "SELECT event_id FROM events WHERE event_type = 'click'")
def flt02_top_level_keys(spark, sf):
    rows = table(spark, sf, "events")
    nested = rows.where(R.matches_payload(rows.columns, {"event_type": "click", "k": "1"}))  # k is inside props: no match
    return rows.where(R.matches_payload(rows.columns, {"event_type": "click"})).select("event_id").unionByName(nested.select("event_id"))


@query("jon14_results_by_url", "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 200 END AS status_code FROM pages")
def jon14_results_by_url(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    results = pages.where("page_id % 3 != 0").select("url", F.lit(200).alias("status_code")).unionByName(spark.createDataFrame([("https://else.where/", 200)], "url string, status_code int"))
    return X.matched_results(pages, results).select("page_id", "status_code")


def _rewordings(prompts):
    return ["\n".join(f"{i}. {p.splitlines()[-1][:20].strip()} {i}" for i in (1, 2)) for p in prompts]


@query("llm02_expanded_queries", r"""WITH q AS (SELECT item_id, string_split(text, chr(10)) AS ls, text FROM benchmark),
    w AS (SELECT item_id, text, regexp_replace(ls[len(ls)][1:20], '^\s+|\s+$', '', 'g') AS last FROM q)
    SELECT item_id AS query_id, 0 AS position, text FROM w UNION ALL SELECT item_id, 1, last || ' 1' FROM w UNION ALL SELECT item_id, 2, last || ' 2' FROM w""")
def llm02_expanded_queries(spark, sf):
    return A.expanded_queries(table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), _rewordings, 2)


@query("llm03_drafts", "SELECT item_id AS query_id, k AS position, CASE k WHEN 0 THEN 'draft at 0.5' WHEN 1 THEN 'draft at 0.7' ELSE 'draft at 0.9' END AS draft FROM benchmark, unnest(range(0, 3)) u(k)")
def llm03_drafts(spark, sf):
    return A.drafts(table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), lambda prompts, bold: [f"draft at {bold:.1f}"] * len(prompts), 3)


def _lengths(prompts):
    pages = [p.split("\n\n", 1)[1].split("\n\nThis answer was not valid JSON", 1)[0] for p in prompts]
    return [json.dumps({"n": len(t), "first": t[:5]}) if len(p) % 5 or "not valid" in p else "no JSON" for p, t in zip(prompts, pages)]


@query("llm04_extracted", "SELECT doc_id, text[1:5] AS first FROM documents")
def llm04_extracted(spark, sf):
    return A.extracted(table(spark, sf, "documents"), _lengths, "n int, first string").select("doc_id", F.col("data.first").alias("first"))


@query("llm05_facts", f"SELECT doc_id, array_to_string(list_filter({SENTENCES}, lambda x: length(x) > 10)[1:10], '|') AS facts FROM documents")
def llm05_facts(spark, sf):
    return facts_add_on(table(spark, sf, "documents"), text="text").select("doc_id", F.array_join("facts", "|").alias("facts"))


def _first_words(prompts):
    found = [re.findall(r"[a-z]{3,}", p.split("\n", 1)[1])[:1] for p in prompts]
    return [json.dumps([{"kind": "Word", "text": w} for w in ws]) for ws in found]


@query("llm06_grounded_entities", """
    WITH w AS (SELECT doc_id, k, text[k * 1000 + 1 : k * 1000 + 1000] AS part FROM documents, unnest(range(0, greatest(ceil((length(text) - 1000) / 1000.0)::INT, 0) + 1)) u(k)),
    e AS (SELECT doc_id, k, part, regexp_extract(part, '[a-z]{3,}') AS t FROM w WHERE regexp_matches(part, '[a-z]{3,}'))
    SELECT doc_id AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS position, 'Word' AS kind, t AS text, k * 1000 + instr(part, t) - 1 AS start, k * 1000 + instr(part, t) - 1 + length(t) AS "end" FROM e""")
def llm06_grounded_entities(spark, sf):
    return A.grounded_entities(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), _first_words)


def _chain(prompts):
    words = [re.findall(r"[A-Za-z]+", p.split("\n", 1)[1])[:3] for p in prompts]
    return [json.dumps([dict(zip(("subject", "predicate", "object"), w)), {"subject": "", "predicate": "p", "object": "o"}]) for w in words]


@query("llm07_triples", "WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents) SELECT doc_id AS chunk_id, 0 AS position, ws[1] AS subject, ws[2] AS predicate, ws[3] AS object FROM w WHERE len(ws) >= 3")
def llm07_triples(spark, sf):
    return A.relation_triples(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), _chain)


@query("llm08_chosen_strategies", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'hierarchical' WHEN lang = 'en' THEN 'semantic' ELSE 'sliding_window' END AS strategy FROM documents")
def llm08_chosen_strategies(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "a.md").otherwise("a.txt").alias("path"), F.when(F.col("lang") == "en", "EN").otherwise("xx").alias("text"))
    return A.chosen_strategies(docs, lambda prompts: ["Semantic!" if p.endswith("EN") else "a sliding window" for p in prompts]).select("doc_id", "strategy")


@query("llm09_relevant_pages", "SELECT page_id, NOT contains(url, '7') AS relevant FROM pages")
def llm09_relevant_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("text"))
    return A.relevant_pages(pages, "sevens", lambda prompts: ["BAD" if "7" in p.split("\n", 1)[1] else None for p in prompts]).select("page_id", "relevant")


def _offers(prompts):
    return [json.dumps([{"url": f"http://offer/{len(p.split(chr(10), 1)[1]) % 40}/", "title": "t"}, {"url": " "}]) for p in prompts]


@query("llm11_listings", "SELECT 'http://offer/' || length(html[1:10000]) % 40 || '/' AS listing_url, min(page_id) AS page FROM pages WHERE length(html) >= 80 GROUP BY 1")
def llm11_listings(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("url"), F.col("page_id").alias("position"), F.col("html").alias("text"))
    return A.gathered_listings(pages, _offers).select("listing_url", "page")


def _even(prompts):
    return [json.dumps([{"index": i, "passed": i % 2 == 0, "reason": f"i{i}"} for i in range(15)]) for _ in prompts]


@query("llm12_validated_items", """
    WITH r AS (SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 20 AS i FROM documents)
    SELECT doc_id, i < 15 AND i % 2 = 0 AS passed, CASE WHEN i < 15 THEN 'i' || i ELSE 'no verdict returned' END AS reason FROM r""")
def llm12_validated_items(spark, sf):
    return A.validated_items(table(spark, sf, "documents").select("doc_id", "lang", "source"), _even, "doc_id", "source", "lang").select("doc_id", "passed", "reason")


@query("llm13_reports", r"""
    WITH r AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, text[1:1250] AS t FROM documents),
    p AS (SELECT source, b, regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY k), '^\s+|\s+$', '', 'g')[1:500] AS part FROM r GROUP BY 1, 2)
    SELECT source, string_agg(part, chr(10) || chr(10) ORDER BY b) AS report FROM p GROUP BY 1""")
def llm13_reports(spark, sf):
    return A.report(table(spark, sf, "documents"), lambda prompts: [None] * len(prompts), "source", "doc_id")


@query("llm14_post_queries", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'about ' || item_id ELSE text[1:512] END AS query FROM benchmark")
def llm14_post_queries(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("#"), F.col("item_id").cast("string"))).otherwise(F.col("text")).alias("text"))
    said = lambda prompts: [f" about {p.rsplit('#', 1)[1]}\nmore" if re.search(r"#\d+$", p) else " " for p in prompts]
    return A.post_queries(rows, said).select("item_id", "query")
