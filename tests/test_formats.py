"""Document formats, fetching over HTTP from a local server, sinks, and operators over a text model."""

import io
import json
import threading
import zipfile
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodestrand import models, plugins
from lodestrand.engine import Engine, process_directory, query
from lodestrand.functions import social
from lodestrand.operators import answers, graph, stores
from lodestrand.sources import fetch, files, formats, sinks


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def pdf(*pages, packed=True):
    objects, kids = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}, []
    for i, text in enumerate(pages):
        content = b"BT /F1 12 Tf 72 700 Td (" + text.replace("(", r"\(").replace(")", r"\)").encode("cp1252") + b") Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET"
        data = zlib.compress(content) if packed else content
        page, body = 10 + 2 * i, 11 + 2 * i
        kids.append(b"%d 0 R" % page)
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % body
        objects[body] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if packed else b"", data)
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(reversed(kids)) + b"] /Count %d >>" % len(kids)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"%%EOF"


DOCX = zipped({"word/document.xml": '<w:document xmlns:w="x"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
PPTX = zipped({f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="x" xmlns:a="y"><a:p><a:r><a:t>Point {i}</a:t></a:r></a:p></p:sld>' for i in (1, 2, 10)})
XLSX = zipped({"xl/workbook.xml": '<workbook><sheets><sheet name="Data"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>x|y</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>'})


def test_formats():
    assert formats.decode("docx", DOCX) == "## Title\n\nOne two\n\n| a | b |\n| --- | --- |"
    assert formats.decode("pptx", PPTX) == "## Slide 1\n\nPoint 1\n\n## Slide 2\n\nPoint 2\n\n## Slide 3\n\nPoint 10"
    assert formats.decode("xlsx", XLSX) == "## Data\n\n| name |  | 7 |\n| --- | --- | --- |\n| x\\|y |  |  |"
    assert formats.decode("csv", b"a,b\n1,\"2,3\"\n") == "| a | b |\n| --- | --- |\n| 1 | 2,3 |"
    assert formats.decode("rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9 \u233?t\par {\*\x y}end\{\}}") == "Café ét\nend{}"
    for packed in (True, False):
        assert formats.pdf_pages(pdf("page (one)", "page two", packed=packed)) == ["page two\nsecond line", "page (one)\nsecond line"]
    assert formats.pdf_pages(b"not a pdf") == []


def test_files_with_errors_and_batches(spark, tmp_path):
    prose = "A good sentence that is long enough to pass every check of quality easily. " * 3
    for name, raw in {"a.docx": DOCX, "b.pdf": pdf("p1", "p2"), "bad.docx": b"broken", "c.txt": prose.encode(), "d.md": ("# T\n\n" + prose.replace("good", "fine")).encode(), "skip.bin": b"x", "blank.txt": b" \n"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.docx", "b.pdf", "bad.docx", "c.txt", "d.md", "blank.txt"} and got["bad.docx"].text is None and "BadZipFile" in got["bad.docx"].error
    assert files.load_files(spark, str(tmp_path)).count() == 5
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/b.pdf")
    assert [(r.page_no, r.text) for r in files.pdf_page_rows(raw).orderBy("page_no").collect()] == [(1, "p2\nsecond line"), (2, "p1\nsecond line")]
    engine = Engine(spark)
    first = {r.source.rsplit("/", 1)[1]: r for r in engine.ingest_directory(str(tmp_path)).collect()}
    assert {n for n, r in first.items() if not r.success} == {"bad.docx", "blank.txt"} and not any(r.skipped for r in first.values()) and first["c.txt"].n_stored == 1
    (tmp_path / "c.txt").write_bytes(prose.replace("good", "new").encode())
    again = {r.source.rsplit("/", 1)[1]: r for r in engine.ingest_directory(str(tmp_path)).collect()}
    assert {n for n, r in again.items() if not r.skipped} == {"bad.docx", "c.txt"} and again["c.txt"].n_stored == 1
    assert {r.content[:6] for r in engine.chunks.where("doc_id like '%c.txt'").collect()} == {"A new "}
    whole, totals = process_directory(spark, str(tmp_path))
    row = totals.first()
    assert (row.n_files, row.n_successful, row.n_failed) == (6, 4, 2)
    assert query(whole, "new sentence", 1, mode="bm25").first().content.startswith("A new")
    assert sum(r.count() for r in Engine(spark).process_directory_streaming(f"{tmp_path}/d.md")) == 1
    index = {r.name: r.size for r in sinks.directory_index(spark, str(tmp_path), "d.md").collect()}
    assert "d.md" not in index and index["bad.docx"] == 6


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        kind, body, status = "text/html", b"<h1>Hello</h1><p>world</p>", 200
        if self.path.startswith("/search"):
            kind, body = "application/json", json.dumps({"data": {"items": [{"link": "", "name": "no url"}, {"link": "http://a/1", "name": "one", "text": "t"}, {"link": "http://a/2", "name": "two", "snip": "s"}]}}).encode()
        elif self.path == "/file.pdf":
            kind, body = "application/octet-stream", pdf("from pdf")
        elif self.path == "/gone":
            status = 404
        elif self.path == "/me":
            body = f"{self.headers['User-Agent']}|{self.headers['Cookie']}".encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetching(spark, site):
    urls = [f"{site}/a", f"{site}/file.pdf", f"{site}/gone", "http://127.0.0.1:9/none", None, f"{site}/me"]
    rows = fetch.fetched(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string"), cookies={"k": "v"}, agent="me", timeout=5).collect()
    got = {r.id: r for r in rows}
    assert len(got) == 6 and got[0].markdown == "# Hello\n\nworld" and got[0].status_code == 200 and got[1].markdown == "from pdf\nsecond line"
    assert got[2].error == "status 404" and got[3].status_code == 0 and got[3].error and got[4].status_code is None and got[5].content == "me|k=v"
    search = fetch.json_search(lambda q, n: f"{site}/search?q={q}&n={n}", "data.items", {"url": "link", "title": "name", "description": "text", "snippet": "snip"}, 5)
    found = search(spark.createDataFrame([(1, "x")], "round_number int, query string")).collect()
    assert [(r.position, r.url, r.description) for r in found] == [(1, "http://a/1", "t"), (2, "http://a/2", "s")]
    engine = Engine(spark, min_quality=0.0)
    assert engine.crawl_and_ingest_many([f"{site}/a", f"{site}/gone"]).count() == 1
    with pytest.raises(RuntimeError, match="404"):
        engine.crawl_and_ingest_one(f"{site}/gone")


def test_pages_of_an_interface(spark):
    def answer(query, token):
        start = int(token or 0)
        if query == "bad":
            raise ValueError
        return [{"n": start + i} for i in range(4)], str(start + 4) if start < 8 else None

    rows = fetch.paged(spark.createDataFrame([("a",), ("bad",)], "query string"), answer, "query string, n int", most=10).collect()
    assert sorted((r.query, r.n) for r in rows) == [("a", i) for i in range(10)]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.b/x", "T", 200, "# md", "<p>", ["l"] * 300, 1), ("https://a.b/y", None, 200, None, "raw", [], 2)], "url string, title string, status_code int, markdown string, content string, links array<string>, round_number int")
    sinks.save_crawl(pages, f"{tmp_path}/c", "all")
    got = {r.file: r.text for r in sinks.read_texts(spark, f"{tmp_path}/c").collect()}
    assert len(got) == 6 and got["a.b_x.md"] == "---\nurl: https://a.b/x\ntitle: T\nstatus_code: 200\n---\n\n# md" and got["a.b_y.html"] == "raw"
    held = json.loads(got["a.b_x.json"])
    assert len(held["links"]) == 100 and held["raw"] == "<p>"
    sinks.save_crawl(pages, f"{tmp_path}/j", "json")
    assert "raw" not in json.loads({r.file: r.text for r in sinks.read_texts(spark, f"{tmp_path}/j").collect()}["a.b_x.json"])
    docs = spark.createDataFrame([("d1", "text"), ("d2", "more")], "doc_id string, text string")
    chunks = spark.createDataFrame([("d1", 1, "b"), ("d1", 0, "a")], "doc_id string, chunk_index int, content string")
    sinks.save_documents(docs, f"{tmp_path}/d", "json", chunks)
    saved = {r.file: json.loads(r.text) for r in sinks.read_texts(spark, f"{tmp_path}/d").collect()}
    assert [c["content"] for c in saved["d1.json"]["chunks"]] == ["a", "b"] and saved["d2.json"]["text"] == "more"
    sinks.save_documents(docs, f"{tmp_path}/m", "md", chunks)
    assert {r.file: r.text for r in sinks.read_texts(spark, f"{tmp_path}/m").collect()}["d1.md"].endswith("text\n\n### Chunk 0\n\na\n\n### Chunk 1\n\nb")
    assert sinks.save_structured(docs, f"{tmp_path}/s", "yaml") == "json" and spark.read.json(f"{tmp_path}/s").count() == 2
    slim = sinks.spill_pages(pages, f"{tmp_path}/p").select("url", "content_file").collect()
    back = {r.content_file: r.content for r in sinks.content_of(spark, f"{tmp_path}/p").collect()}
    assert {r.url: back[r.content_file] for r in slim} == {"https://a.b/x": "<p>", "https://a.b/y": "raw"}
    said = stores.upserted_in_batches(docs.coalesce(1), lambda rows: None if rows[0]["doc_id"] != "d2" else 1 / 0, 1).collect()
    assert [(r.n_rows, r.error is None) for r in said] == [(1, True), (1, False)]
    assert stores.cleared(docs).count() == 0


def broken(prompts):
    raise ValueError("no answer")


def test_expansion_and_drafts(spark):
    queries = spark.createDataFrame([(1, "red car"), (2, "boat")], "query_id int, text string")
    out = answers.expanded_queries(queries, lambda p: ["1. a red auto\n- red car\n2) crimson car"] * len(p), 3).orderBy("query_id", "position")
    assert [r.text for r in out.where("query_id = 1").collect()] == ["red car", "a red auto", "crimson car"]
    assert [r.text for r in answers.expanded_queries(queries, broken).orderBy("query_id").collect()] == ["red car", "boat"]
    with pytest.raises(Exception, match="blank"):
        answers.expanded_queries(spark.createDataFrame([(1, "  ")], "query_id int, text string"), None).collect()
    got = answers.drafts(queries, lambda prompts, bold: [f"draft {bold:.1f}"] * len(prompts), 3).where("query_id = 1").orderBy("position").collect()
    assert [r.draft for r in got] == ["draft 0.5", "draft 0.7", "draft 0.9"]
    assert {r.draft for r in answers.drafts(queries, broken).collect()} == {"red car", "boat"}


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "alpha page"), (2, "beta page")], "position int, text string")

    def stubborn(prompts):
        return ['```json\n{"name": "x"}\n```' if "not valid" in p or "alpha" in p else "sorry" for p in prompts]

    assert {r.position: r.data and r.data.name for r in answers.extracted(pages, stubborn, "name string").collect()} == {1: "x", 2: "x"}
    assert {r.data for r in answers.extracted(pages, stubborn, "name string", attempts=1).where("position = 2").collect()} == {None}
    assert answers.described("a int, b array<string>") == "- a (int)\n- b (array<string>)"
    chunks = spark.createDataFrame([("c", "They saw Paris and Rome. " + "x " * 600 + "then Oslo"), ("d", None)], "chunk_id string, content string")
    found = answers.grounded_entities(chunks, models.capitalised_entities, window=500).orderBy("position").collect()
    text = chunks.first().content
    assert [r.text for r in found] == ["Paris", "Rome", "Oslo"] and all(text[r.start : r.end] == r.text for r in found)
    triples = answers.relation_triples(chunks, lambda p: ['[{"subject":"a","predicate":"is","object":"b"},{"subject":"","predicate":"is","object":"b"}]'] * len(p))
    assert triples.count() == 2
    assert [r.relevant for r in answers.relevant_pages(pages, "x", lambda p: ["BAD" if "alpha" in x else None for x in p]).orderBy("position").collect()] == [False, True]


def test_listings_items_and_reports(spark):
    pages = spark.createDataFrame([("p1", 1, "offer " * 20), ("p2", 2, "offer " * 20), ("p3", 3, "short")], "url string, position int, text string")
    listed = answers.gathered_listings(pages, lambda p: ['[{"url":"http://x/1/","title":"t"},{"url":"","title":"no"},{"url":"http://x/2","title":"u"}]'] * len(p)).collect()
    assert sorted((r.listing_url, r.page) for r in listed) == [("http://x/1/", "p1"), ("http://x/2", "p1")]
    items = spark.createDataFrame([(1, "g", f"item {i}", i) for i in range(45)], "k int, g string, text string, id int")
    judge = lambda prompts: [json.dumps([{"index": i, "passed": i % 2 == 0, "reason": "r"} for i in range(p.count("\n") - 1)]) for p in prompts]
    out = {r.id: (r.passed, r.reason) for r in answers.validated_items(items, judge, "id", "text", "g", 20).collect()}
    assert len(out) == 45 and out[0] == (True, "r") and out[1] == (False, "r") and out[19] == (False, graph.NO_VERDICT) and out[20][0]
    made = answers.report(spark.createDataFrame([("g", i, f"note {i}") for i in range(20)], "g string, o int, text string"), lambda p: [f"{x.count('note')} notes" for x in p], "g", "o").first()
    assert made.report == "4 notes"  # three batches, and the word in the prompt
    assert answers.report(spark.createDataFrame([("g", 1, "note")], "g string, o int, text string"), broken, "g", "o").first().report == "note"
    goals = spark.createDataFrame([("find cats",)], "text string")
    assert answers.post_queries(goals, lambda p: ["cats lang:en\nmore"]).first().query == "cats lang:en" and answers.post_queries(goals, None).first().query == "find cats"
    planner = answers.Planner(lambda p: {"Write up to 5": "1. one\n- two", "Goal: g\nFound": "yes, go on"}.get(p[:13], "one\nThree"))
    assert planner.plan("g") == ["one", "two"] and planner.go_on("g", "") and planner.more("g", ["ONE "], "") == ["Three"]
    assert answers.Planner(broken).plan("goal") == ["goal"] and not answers.Planner(broken).go_on("g", "")


def test_expansion_in_queries(spark):
    engine = Engine(spark, model=lambda prompts: ["green boat\nblue ship"] * len(prompts), min_quality=0.0)
    docs = [(i, f"The {c} {t} sails over the wide and quiet sea on every single day of the long year.") for i, (c, t) in enumerate([("green", "boat"), ("blue", "ship"), ("old", "cart")])]
    engine.ingest(spark.createDataFrame(docs, "doc_id int, text string"))
    asked = spark.createDataFrame([(7, "vessel")], "query_id int, text string")
    for expansion in ("multi_query", "hyde"):
        got = engine.query(asked, 3, "bm25", expansion=expansion).collect()
        assert {r.query_id for r in got} == {"7"} or {r.query_id for r in got} == {7}
        assert len(got) <= 3 and all(r.rrf > 0 for r in got)
    with pytest.raises(ValueError):
        engine.query(asked, expansion="other")


def test_registries_and_add_ons(spark):
    assert {"sentence", "sliding_window", "hierarchical", "semantic"} <= set(plugins.chunkers.names()) and "pdf" in plugins.extractors
    assert plugins.chunker_for("nothing") is plugins.chunkers.get("hierarchical")
    with pytest.raises(KeyError):
        plugins.chunker_for("nothing", strict=True)
    docs = spark.createDataFrame([(1, "One sentence is here. Another follows it. " * 8)], "doc_id int, text string")
    chunks = plugins.chunker_for("semantic")(docs, least=10, most=200)
    assert chunks.count() > 1
    plugins.add_ons.register("fails", lambda c: 1 / 0)
    out = plugins.run_add_ons(chunks, ["fails", "facts"])
    assert all(len(r.facts) >= 1 for r in out.collect())
    with pytest.raises(KeyError):
        plugins.run_add_ons(chunks, ["unknown"])


def test_posts_and_flights(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(social.post_markdown(lit("al"), lit("Al"), lit("hi\nthere"), lit("2024"), lit(1200), lit(None).cast("int"), lit("a\nb"))) == "## Post by @al (Al)\n> a\n> b\nhi\nthere\n**Posted:** 2024\n1,200 likes, 0 reposts"
    assert one(social.user_markdown(lit("al"), lit(None).cast("string"), lit(""), lit(3), lit(1000), F.array(lit("x"), lit("y")), 1)) == "# @al\n**Followers:** 3\n**Following:** 1,000\nFollowers: @x"
    window = one(social.day_window(F.to_timestamp(lit("2024-03-05 13:00:00")), lit(99)))
    assert window.end - window.begin == 48 * 3600 and window.end % 86400 == 0
    assert tuple(one(social.flight_query(lit(" Area: 1,2,3,4")))) == ("area", "1,2,3,4") and tuple(one(social.flight_query(lit("x")))) == ("all", "x")
    assert one(social.in_area(lit(2.0), lit(3.0), lit("1,2,3,4"))) and not one(social.in_area(lit(2.0), lit(3.0), lit("1,2,x")))
    assert one(social.plan_kind(lit(True), lit(""))) == "listings" and one(social.plan_kind(lit(None).cast("boolean"), lit(None).cast("string"))) == "general"
    assert social.store_url("bolt://u:p@h:1/db") == {"kind": "bolt", "host": "h", "port": 1, "name": "db", "user": "u", "password": "p"} and social.store_url("memory")["kind"] == "memory"
    with pytest.raises(ValueError):
        social.store_url("ftp://x")


def test_all_paths(spark):
    edges = [("a", "x", "b"), ("b", "x", "c"), ("c", "x", "a"), ("c", "y", "d"), ("a", "z", "b")]
    frame = spark.createDataFrame(edges, "source string, relation string, target string")

    def paths(node, used, left):
        for i, (s, _, t) in enumerate(edges):
            if left and i not in used and node in (s, t):
                yield [*used, i]
                yield from paths(t if node == s else s, [*used, i], left - 1)

    want = sorted(edges[i] for p in paths("a", [], 3) for i in p)
    got = sorted((r.source, r.relation, r.target) for r in graph.path_edges(frame, spark.createDataFrame([("a",)], "seed string"), 3, None).collect())
    assert got == want and len(got) > 20


def test_rank_and_batches(spark):
    rows = [(i, "hot" if i % 3 else None, (i * 7919) % 1000) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, g string, v int").repartition(6)
    got = {r.id: r.rank for r in stores.rank_within(frame, ["g"], [F.desc("v"), F.col("id")]).collect()}
    want = {}
    for g in ("hot", None):
        for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            want[r[0]] = k
    assert got == want
    batches = {r.id: r.batch for r in stores.embedding_batches(frame, "g", "id", "v", 2000, 5).collect()}
    for g in ("hot", None):
        now = total = n = 0
        for i, _, v in sorted(r for r in rows if r[1] == g) if g else sorted((r for r in rows if r[1] is None), key=lambda r: r[0]):
            if n and (total + v > 2000 or n >= 5):
                now, total, n = now + 1, 0, 0
            total, n = total + v, n + 1
            assert batches[i] == now
