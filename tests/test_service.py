"""The services, streams with late and repeated rows, the research loops and what is observed."""

import datetime
import io
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodestrand import cli
from lodestrand.engine import Engine
from lodestrand.observability import Observer, Progress, observed
from lodestrand.operators import retrieve as R, web
from lodestrand.plans import research
from lodestrand.service import Service, answer, http_server, serve_lines
from lodestrand.streaming import incremental, windows

PROSE = "The quick brown fox number {} jumps over the lazy dog on each and every single day of the year."


def offline(spark, n=6):
    pages = spark.createDataFrame([(f"https://example.com/cats-{i}", f"<p>{PROSE.format(i)}</p>") for i in range(1, n)], "url string, html string")
    return research.offline_web(pages)


@pytest.fixture(scope="module")
def service(spark):
    engine = Engine(spark, min_quality=0.0, crawler=offline(spark))
    return Service(engine)


def test_http(service):
    server = http_server(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, None if body is None else json.dumps(body).encode())) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as x:
            return x.code, json.loads(x.read())

    assert call("/health")[1]["status"] == "ok" and call("/nothing")[0] == 404
    assert call("/ingest", {"documents": [{"id": 1, "text": PROSE.format("one")}, {"id": 2, "text": PROSE.format("two")}]}) == (200, {"n_chunks": 2})
    status, got = call("/query", {"text": "fox number two", "k": 1, "mode": "bm25"})
    assert status == 200 and len(got["results"]) == 1 and call("/query", {"nothing": 1})[0] == 400
    assert call("/crawl", {"url": "https://example.com/cats-1"})[1]["status_code"] == 200
    assert len(call("/crawl/batch", {"urls": ["https://example.com/cats-1", "https://no.where/"]})[1]["results"]) == 2
    assert [r["position"] for r in call("/search", {"query": "cats", "limit": 2})[1]["results"]] == [1, 2]
    assert "requests{call=query} 2" in call("/metrics")[1]["metrics"]
    server.shutdown()


def test_lines(service):
    asked = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "search_and_crawl", "arguments": {"query": "cats", "limit": 2}}}]
    out = io.StringIO()
    serve_lines(service, io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in said] == [1, 2, 3, None] and len(said[1]["result"]["tools"]) == 3
    assert len(json.loads(said[2]["result"]["content"][0]["text"])["pages"]) == 2
    assert answer(service, {"id": 5, "method": "tools/call", "params": {"name": "crawl_url", "arguments": {}}})["result"]["isError"]
    assert "error" in answer(service, {"id": 6, "method": "x"}) and answer(service, {"id": 7, "method": "tools/call", "params": {"name": "x"}})["error"]


def test_command_line(spark, tmp_path, capsys):
    cli.main(["list"])
    assert "top03_hybrid" in capsys.readouterr().out
    spark.createDataFrame([(i, PROSE.format(i)) for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    for command in ("query", "progressive-query"):
        cli.main([command, f"{tmp_path}/d", "fox number 3", "-k", "2", "--mode", "bm25"])
        assert "fox number 3" in capsys.readouterr().out
    spark.createDataFrame([("a", "x", "b"), ("b", "x", "c")], "source string, relation string, target string").write.parquet(f"{tmp_path}/e")
    cli.main(["graph-query", "neighbors", f"{tmp_path}/e", "--node", "a", "--depth", "2"])
    assert capsys.readouterr().out.count("|a ") >= 2
    spark.createDataFrame([("City", "1", {"name": "Oslo"}, 1), ("City", "2", {"name": "Rome"}, 1)], "label string, id string, attributes map<string,string>, seq long").write.parquet(f"{tmp_path}/n")
    cli.main(["graph-query", "entities", f"{tmp_path}/n", "--label", "City", "--attr", "name=Rome"])
    shown = capsys.readouterr().out
    assert "Rome" in shown and "Oslo" not in shown


def test_late_rows(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)
    schema = "ts timestamp, user string, value double"
    files = [[(at(5), "u", 1.0)], [(at(200), "u", 1.0)], [(at(201), "u", 1.0)], [(at(6), "u", 1.0), (at(150), "u", 1.0)], [(at(900), "u", 1.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        threading.Event().wait(1.1)  # files are taken by their time

    def run(mode):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = windows.collected(windows.windowed(stream, F.window("ts", "1 hour"), "user"), mode, ("key", "window_start"))
        return {(r.window_start.hour, r.n) for r in out.collect()}

    # the row of minute 6 comes after its window has ended by more than the allowed hour; that of minute 150 doesn't
    assert run("update") == {(10, 1), (13, 2), (12, 1), (1, 1)}
    assert run("append") == {(10, 1), (12, 1), (13, 2)}
    with pytest.raises(ValueError):
        run("complete")


def test_stream_of_vectors(spark, tmp_path):
    schema = "doc_id long, embedding array<double>"
    batches = [[(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0])], [(4, [0.995, 0.005]), (5, [0.995, 0.005]), (6, [-1.0, 0.0]), (7, [-1.0, 0.0])], [(8, [0.0, 2.0]), (1, [1.0, 0.0])]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = f"{tmp_path}/seen"
    for _ in range(2):
        got = incremental.near_deduplicated(stream(), 0.95, path=seen)
        assert sorted(r.doc_id for r in got.collect()) == [1, 3, 6]
        assert sorted(r.doc_id for r in incremental.near_deduplicated(stream(), 0.95, path=seen).collect()) == [1, 3, 6]
        incremental.clear_seen(spark, seen)


def test_ingest_stream_is_its_own_cache(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/in/1")
    cut = lambda df: df.select("doc_id", F.explode(F.split("text", " ")).alias("content"))
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    incremental.ingest_stream(stream(), cut, f"{tmp_path}/out")
    spark.createDataFrame([(2, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/in/2")
    incremental.ingest_stream(stream(), cut, f"{tmp_path}/out")
    assert sorted(r.content for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_progressive(spark):
    engine = Engine(spark, min_quality=0.0)
    pages = spark.createDataFrame([(i, (f"topic{i} intro words stand here at the start of it. " + f"detail{i} comes much later in this long page. " * 30)) for i in range(6)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "topic3 intro")], "query_id int, text string")
    assert incremental.progressive_query(engine, pages, asked, 1, "bm25", size=60).count() == 1
    assert [r.doc_id for r in engine.processed.collect()] == ["3"] and {r.doc_id for r in engine.chunks.select("doc_id").distinct().collect()} == {"3"}
    incremental.progressive_query(engine, pages, spark.createDataFrame([(0, "topic4 intro")], "query_id int, text string"), 1, "bm25", size=60)
    assert sorted(r.doc_id for r in engine.processed.collect()) == ["3", "4"]


def test_listing_loop(spark):
    heard = []

    def model(prompts):
        out = []
        for p in prompts:
            if p.startswith("Write up to 5"):
                out.append("cats")
            elif "other queries" in p:
                out.append("CATS\ndogs")
            elif p.startswith("List the offers"):
                out.append(json.dumps([{"url": f"http://o/{p.count('number 1')}", "title": "good one", "price": "1", "status": "open"}, {"url": f"http://o/{p.count('number 1')}9", "title": "t", "price": "1", "status": "SOLD"}]))
            else:
                out.append(json.dumps([{"index": i, "passed": True, "reason": ""} for i in range(5)]))
        return out

    from lodestrand.sources.stub import stub_provider

    pages = spark.createDataFrame([(f"https://example.com/{x}-{i}", f"<p>{PROSE.format(i)}</p>") for x in ("cats", "dogs") for i in range(1, 6)], "url string, html string")
    out = research.research_listings(spark, "find pets", stub_provider, research.offline_web(pages), model, research.Strategy(per_round=3), wanted=5, progress=heard.append)
    assert out.queries == ["cats", "dogs"] and [h["round"] for h in heard] == [1, 2]
    assert {r.listing_url for r in out.kept.collect()} == {"http://o/0", "http://o/1"} and {r.reason for r in out.rejected.collect()} == {"gone"}


def test_search_and_expand(spark):
    posts = spark.createDataFrame([("https://x.com/ann/status/1", 5, None), ("https://x.com/bob/status/2", 9, None), ("https://x.com/cy/status/3", 1, None), ("https://x.com/dan/status/4", 99, "failed")], "url string, score int, error string")
    follows = spark.createDataFrame([("ann", "eve"), ("bob", "fay"), ("cy", "gus")], "user string, follower string")
    best, users = research.search_and_expand(posts, follows, top=2)
    assert [r.score for r in best.orderBy("score").collect()] == [5, 9]
    assert {(r.user, r.level) for r in users.collect()} == {("ann", 0), ("bob", 0), ("eve", 1), ("fay", 1)}
    rows = spark.createDataFrame([("1", "re", "9"), ("2", "also re", "9"), ("3", "new", None)], "post_id string, text string, replied_to string")
    parents = spark.createDataFrame([("9", "root"), ("9", "root")], "post_id string, text string")
    assert sorted((r.post_id, r.parent_text) for r in research.result_rows(rows, parents).collect()) == [("1", "root"), ("2", "root"), ("3", None)]


def test_results_by_url_and_filters(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "url string, position int")
    results = spark.createDataFrame([("b", 200), ("a", 404), ("extra", 200)], "url string, status_code int")
    assert sorted((r.position, r.status_code) for r in web.matched_results(wanted, results).collect()) == [(1, 404), (2, 200), (3, 404)]
    rows = spark.createDataFrame([("x", {"k": "1"}), ("y", None)], "kind string, extra map<string,string>")
    assert rows.where(R.matches_payload(rows.columns, {"kind": "x"})).count() == 1 and rows.where(R.matches_payload(rows.columns, {"k": "1"})).count() == 0
    assert rows.where(R.matches_where({"kind": {"$in": ["x", "z"]}})).count() == 1 and rows.where(R.matches_where({"kind": {"$eq": "y"}})).count() == 1
    with pytest.raises(ValueError):
        R.matches_where({"kind": {"$gt": 1}})


def test_observed(spark):
    seen = Observer()
    with seen.span("outer", x=1), seen.span("inner"):
        seen.count("n", 2, kind="a")
        seen.gauge("g", 1.5)
    with pytest.raises(ValueError), seen.span("bad"):
        raise ValueError("x")
    assert [(s["name"], s["parent"], s["error"]) for s in seen.spans] == [("inner", "outer", None), ("outer", None, None), ("bad", None, "ValueError: x")]
    assert seen.text() == "g 1.5\nn{kind=a} 2" and {r.key for r in seen.summary(spark).collect()} == {"inner_seconds", "outer_seconds", "bad_seconds"}
    off = Observer(on=False)
    with off.span("x"):
        off.count("n")
    assert not off.spans and off.text() == ""
    df, read = observed(spark.createDataFrame([(1,), (None,)], "a int"), "rows", "a")
    df.collect()
    assert read() == {"n_rows": 2, "n_null": 1}


def test_progress_of_streams(spark, tmp_path):
    heard = []
    listener = Progress(heard.append)
    spark.streams.addListener(listener)
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/in/1")
    windows.collected(spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), "append")
    for _ in range(50):
        if any(h["event"] == "ended" for h in heard):
            break
        threading.Event().wait(0.1)
    spark.streams.removeListener(listener)
    assert {"started", "ended"} <= {h["event"] for h in heard} and sum(h.get("rows", 0) for h in heard) == 1
