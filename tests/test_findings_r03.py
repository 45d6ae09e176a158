"""Odd inputs and larger tables of the third round's findings."""

from pyspark.sql import functions as F

from lodestrand.functions import url as U
from lodestrand.operators import answers, retrieve as R
from lodestrand.plans import catalog
from lodestrand.plans.served import Served
from lodestrand.sources import sinks


def page_folder(spark, path, rows):
    """A folder of tables with these (page_id, url, html) only."""
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


TWICE = [(1, "https://e.com/a", '<a href="/one"><a href="https://z.org/x">'), (60, "https://e.com/a", '<a href="/two">'), (61, "https://f.com/", '<a href="/three">')]


def test_links_of_pages_with_one_url(spark, tmp_path):
    sf = page_folder(spark, tmp_path, TWICE)
    followed = sorted(tuple(r) for r in catalog.QUERIES["flt06_followed_links"](spark, sf).collect())
    assert followed == [(1, "https://e.com/one"), (60, "https://e.com/two"), (61, "https://f.com/three")]
    assert sorted(r.url for r in catalog.QUERIES["jon06_frontier"](spark, sf).collect()) == ["https://e.com/two", "https://f.com/three"]


def test_same_domain_links_of_pages_with_one_url(spark, tmp_path):
    got = catalog.QUERIES["flt07_same_domain"](spark, page_folder(spark, tmp_path, TWICE)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "https://e.com/one"), (60, "https://e.com/two"), (61, "https://f.com/three")]


def test_numbers_as_hosts(spark):
    bad = ["http://10.0.0.1234", "http://10.0.0.10005/x", "http://127.1/", "http://2130706433/", "http://0x7f000001", "http://010.0.0.1/", "http://256.1.1.1", "http://1.2.3.4.5", "http://10.0.0.1./", "http://localhost./"]
    good = ["https://8.8.8.8/", "http://10.0.0.com", "https://1.2.3.4.example.org", "http://v2.example.com:8080/"]
    rows = spark.createDataFrame([(u,) for u in bad + good], "url string")
    assert {r.url: r.safe for r in rows.select("url", U.safe_url(F.col("url")).alias("safe")).collect()} == {u: u in good for u in bad + good}


def test_extraction_of_short_and_missing_pages(spark, tmp_path):
    rows = [(i, "a" * i) for i in range(12)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.first for r in catalog.QUERIES["llm04_extracted"](spark, str(tmp_path)).collect()}
    assert got == {i: t and t[:5] for i, t in rows} | {0: ""}

    def failing(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no answer")
        return ['{"name": "x"}'] * len(prompts)

    pages = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good")], "position int, text string").coalesce(1)
    assert {r.position: r.data and r.data.name for r in answers.extracted(pages, failing, "name string").collect()} == {1: "x", 2: None, 3: "x"}


def test_saved_pages_of_one_name(spark, tmp_path):
    sf = page_folder(spark, tmp_path, TWICE)
    got = sorted(tuple(r) for r in catalog.QUERIES["snk08_saved_pages"](spark, sf).select("file", "text").collect())
    want = sorted(("_".join(u.removeprefix("https://").split("/")) + ".md", f"---\nurl: {u}\nstatus_code: 200\n---\n\n{html}") for _, u, html in TWICE)
    assert got == want


def test_spilled_pages_of_one_url(spark, tmp_path):
    rows = [(3, "https://e.com/a", "one"), (6, "https://e.com/a", "two"), (9, "https://e.com/a", "one"), (10, "https://e.com/a", "one")]
    assert sorted(tuple(r) for r in catalog.QUERIES["snk14_spilled_pages"](spark, page_folder(spark, tmp_path / "sf", rows)).collect()) == [(i, x) for i, _, x in rows]
    pages = spark.createDataFrame([("https://e.com/a", 1, "one")], "url string, round_number int, content string")
    for _ in range(2):
        slim = sinks.spill_pages(pages, f"{tmp_path}/twice")
    assert slim.join(sinks.content_of(spark, f"{tmp_path}/twice"), "content_file").count() == 1


def test_a_question_is_looked_up_once(monkeypatch):
    from lodestrand.plans import served

    looked = []
    monkeypatch.setattr(served.pc, "greater_equal", lambda *a, real=served.pc.greater_equal: looked.append(1) or real(*a))
    server, asked = Served("/root/testdata/sf0.001"), {"query": "click", "start_time": "2024-01-02T00:00:00Z", "end_time": "2024-01-20T00:00:00Z", "max_results": "10"}
    ids, token = [], "0"
    while token:
        answer = server.answer("/2/tweets/search/recent", {**asked, "next_token": token})
        ids, token = ids + [int(x["id"]) for x in answer["data"]], answer["meta"].get("next_token")
    assert ids == sorted(set(ids)) and len(ids) > 20 and len(looked) == 1


def test_flights_are_told_in_pieces():
    answer = Served("/root/testdata/sf0.001").answer("/flights/departure", {"airport": "EDCL", "begin": "1704412800", "end": "1704585599"})
    assert not isinstance(answer, list) and {f["estDepartureAirport"] for f in answer} == {"EDCL"}


def test_bm25_with_k_passes_few_pairs_on(spark, monkeypatch):
    monkeypatch.setattr(R, "_SCORES", 60)  # several blocks a task
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(1 + i % 11))) for i in range(300)] + [(1000, None), (1001, "")], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "w1 w2 w2 nowhere"), (2, "w3"), (3, "nothing"), (4, "w5 w6 w1")], "item_id long, text string")
    for standard in (False, True):
        ranked = lambda rows: sorted(tuple(r) for r in R.top_k(rows, 5, "item_id", "doc_id").select("item_id", "rank", "doc_id", "score").collect())
        few = R.bm25(asked, docs, standard=standard, k=5)
        whole = R.bm25(asked, docs, standard=standard)
        assert ranked(few) == ranked(whole) and few.count() < whole.count()


def test_vector_scores_pass_on_what_a_task_may_still_need(spark):
    """A task holds each query's best k over its batches, so later batches pass on little."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        vectors = spark.range(600).selectExpr("id AS vec_id", "array(cos(id * 0.1D), sin(id * 0.1D), cos(id * 7.3D)) AS embedding").coalesce(1)
        asked = vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query_embedding")
        few, whole = R.vector_scores(asked, vectors, k=5), R.vector_scores(asked, vectors)
        ranked = lambda rows: sorted(tuple(r) for r in R.top_k(rows, 5, "query_id", "vec_id").select("query_id", "rank", "vec_id", "score").collect())
        assert ranked(few) == ranked(whole) and few.count() < 12 * 600 * 5 // 20 * 3 // 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_model_is_given_few_prompts_at_once(spark):
    """an Arrow batch of many long texts is not in Python as a whole; a failure costs the prompts that were given with it."""

    def sized(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no answer")
        return [str(len(prompts))] * len(prompts)

    rows = spark.range(1000).coalesce(1).selectExpr("id", "CASE WHEN id = 999 THEN 'bad' WHEN id > 0 THEN 'good' END AS text")
    got = {r.id: r.answer for r in answers.asked(rows, F.col("text"), "answer", sized).collect()}
    assert len(got) == 1000 and max(int(a) for a in got.values() if a) <= 256 and got[0] == "256" and got[999] is None


def test_terms_of_one_file_are_counted_by_many_tasks(spark, tmp_path, monkeypatch):
    """a batch is a file of one row group; its texts are dealt out, and the batches' counts add up."""
    from lodestrand.streaming import incremental

    texts = [None, "", "...", "Wörter b_1 b_1 9"] + [f"W{i % 7} w{i % 3} all all" for i in range(196)]
    for k in (0, 1):
        rows = spark.createDataFrame([(k * 200 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    batches = []

    def recorded(stream, keys, real=getattr(incremental, "added", None)):
        tell = lambda batch, number: batches.append(batch.select(F.spark_partition_id()).distinct().count())
        stream.writeStream.foreachBatch(tell).option("checkpointLocation", f"{tmp_path}/told").trigger(availableNow=True).start().awaitTermination()
        return real(stream, keys)

    monkeypatch.setattr(incremental, "added", recorded, raising=False)
    got = {r.term: (r.df, r.total) for r in incremental.term_counts(spark, str(tmp_path)).collect()}
    words = [(t or "").lower().split() for t in texts if t != "..."]
    want = {w: (2 * sum(w in x for x in words), 2 * sum(x.count(w) for x in words)) for x in words for w in x}
    assert got == want and got["all"] == (392, 784)
    assert len(batches) == 2 and min(batches) == spark.sparkContext.defaultParallelism
