"""Golden facts of retrieval, web, graph, store and file operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand import models, plugins
from lodestrand.engine import Engine
from lodestrand.functions import text as T, url as U, vector as V
from lodestrand.operators import graph as G, retrieve as R, spans as S, stores, validate, web
from lodestrand.sources import files
from lodestrand.sources.state import checkpointed


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def one(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()], F.lit(1).alias("_")).select(column.alias("x")).first().x


def test_text_scalars(spark):
    assert one(spark, T.tokens(F.lit("Version 2.0 released"))) == ["version", "2", "0", "released"]
    slugs = {"what is 2+2?": "what_is_2_2", "C++ programming": "c_programming", "???": "query", " Café au lait ": "café_au_lait"}
    assert {k: one(spark, T.query_slug(F.lit(k))) for k in slugs} == slugs
    assert one(spark, T.listed_queries(F.lit("1. one\n- two\n\n3) three\n* four"), 3)) == ["one", "two", "three"]
    assert one(spark, T.unfenced_json(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert [one(spark, T.judged_good(F.lit(x))) for x in ("GOOD", "BAD", "bad, not good", "")] == [True, False, True, True]
    assert one(spark, T.without_front_matter(F.lit("---\na: b\n---\n\nbody"))) == "body"
    state = one(spark, T.state_struct(F.array(F.lit("abc"), F.lit("BAW123 "))))
    assert state.callsign == "BAW123" and state.longitude is None


def test_urls(spark):
    base = "https://example.com/a/b.html?q=1"
    html = """<a href="https://x.com/1"><a href='/r'><a href="#x"><a href="javascript:1"><a href="rel"><a href="//cdn.net/z"><a href="/r">"""
    assert one(spark, U.page_links(F.lit(html), F.lit(base))) == ["https://x.com/1", "https://example.com/r", "https://example.com/a/rel", "https://cdn.net/z"]
    bad = ["file:///etc/x", "javascript:alert(1)", "http://u:p@h.com/", "http://localhost/", "http://127.0.0.1/", "http://10.0.0.1/x", "http://192.168.3.4", "http://", None]
    good = ["https://example.com", "http://8.8.8.8/a", "http://172.15.0.1/", "HTTP://Example.com"]
    assert [one(spark, U.safe_url(F.lit(x).cast("string"))) for x in bad + good] == [False] * len(bad) + [True] * len(good)
    rows = spark.createDataFrame([(1, "https://en.wikipedia.org/x"), (2, "https://notwikipedia.org"), (3, "https://wikipedia.org")], "id int, url string")
    allowed, blocked = web.split_blocked(rows, ("wikipedia.org",))
    assert values(allowed, "id") == [(2,)] and values(blocked, "id", "reason") == [(1, "blocked_domain"), (3, "blocked_domain")]


def test_links_with_dots(spark):
    from urllib.parse import urljoin

    for base in ("https://e.com/a/b/c.html?x=1", "https://e.com", "https://e.com/a/"):
        for link in ("../x", "./y?q=../1", "../../../z", "/p/../q/./r", "..", ".", "d/e/..", "a..b/c", "/..", "x#../y"):
            assert one(spark, U.resolve(F.lit(link), F.lit(base))) == urljoin(base, link), (base, link)


def test_filters(spark):
    assert one(spark, web.first_stale(F.lit("the MANUAL"), ("[", "(?i>manual"))) == "(?i>manual"
    assert [one(spark, web.live_listing(F.lit(x).cast("string"))) for x in (None, "unknown", "Sold!")] == [True, True, False]
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, id int")
    assert values(rows.where(R.matches({"k": ["a", "b"], "id": 2})), "id") == [(2,)]
    assert rows.where(R.matches({"k": None})).count() == 0


def test_rank_fusion(spark):
    lists = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (2, 1), (3, 2), (1, 3)], "id int, rank int")
    got = {r.id: r.rrf for r in R.fuse_ranks(lists, None, "id").collect()}
    assert max(got, key=got.get) == 2 and got[2] == pytest.approx(1 / 62 + 1 / 61)


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, V.cosine(v(1, 0), v(0.99, 0.01))) == pytest.approx(0.99995, abs=1e-4)
    assert one(spark, V.cosine(v(0, 0), v(1, 1))) == 0 and one(spark, V.cosine(v(1, 0, 5), v(1, 0), truncate=True)) == pytest.approx(1)
    with pytest.raises(Exception, match="unequal length"):
        one(spark, V.cosine(v(1, 0, 5), v(1, 0)))


def test_quality(spark):
    rows = spark.createDataFrame([(1, "-----.....-----"), (2, "lower case (open"), (3, 'A "good" sentence that is long enough to pass the length check easily.')], "id int, content string")
    got = {r.id: r for r in validate.with_quality(rows).collect()}
    assert not got[1].passed and got[1].density == 0 and got[3].passed and got[3].complete
    assert "Unbalanced parentheses (1 open, 0 close)" in got[2].issues


def test_near_duplicates(spark):
    checkpointed(spark)
    rng = random.Random(1)
    ids = list(range(60))
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(80)) if a != b})
    kept, by = set(), {}
    for i in ids:
        earlier = sorted(a for a, b in pairs if b == i and a in kept)
        if earlier:
            by[i] = earlier[0]
        else:
            kept.add(i)
    out = validate.greedy_near_duplicates(spark.createDataFrame([(i,) for i in ids], "vec_id int"), spark.createDataFrame(pairs, "a int, b int")).collect()
    assert {r.vec_id for r in out if r.kept} == kept and {r.vec_id: r.duplicate_of for r in out if not r.kept} == by


def brute_pairs(rows, threshold):
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    sims = v @ v.T
    return {(min(a, b), max(a, b)) for i, (a, _) in enumerate(rows) for j, (b, _) in enumerate(rows[:i]) if sims[i, j] >= threshold}


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.4])
def test_blocked_pairs_against_all_pairs(spark, threshold):
    """Recall at 0.4, where a registered query asks, and above."""
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(60)]
    rows = list(enumerate(base)) + [(100 + i, [x + rng.gauss(0, (0.02, 0.1, 0.6, 1.2)[i % 4]) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    want, got = brute_pairs(rows, threshold), set(values(validate.similar_pairs(df, threshold), "a", "b"))
    assert len(want) >= 15 and got <= want and len(got) >= 0.99 * len(want)


def test_near_duplicates_with_copies(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, rng.choice(base) if i % 3 else [x + rng.gauss(0, 0.1) for x in rng.choice(base)]) for i in range(90)]
    rows += [(200, [0.0] * 16), (201, [0.0] * 16)]
    kept, by = [], {}
    pairs = brute_pairs(rows[:-2], 0.95)
    for i, _ in rows:
        if found := [k for k in kept if (k, i) in pairs]:
            by[i] = found[0]
        else:
            kept.append(i)
    df = spark.createDataFrame([*rows, (300, None), (301, [])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in validate.near_duplicates(df, 0.95).collect()}
    assert len(got) == 94 and sorted(i for i, r in got.items() if r.kept) == sorted([*kept, 300, 301]) and {i: r.duplicate_of for i, r in got.items() if not r.kept} == by


def test_vector_search_in_blocks(spark):
    rng = np.random.default_rng(4)
    vectors, asked = rng.integers(-2, 3, (300, 6)).astype(float), rng.integers(-2, 3, (40, 6)).astype(float)
    unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1)[:, None], out=np.zeros_like(x), where=np.linalg.norm(x, axis=1)[:, None] > 0)
    sims = np.round(unit(asked) @ unit(vectors).T, 6)
    want = {(q, sorted(range(300), key=lambda i: (-sims[q, i], i))[r], r + 1) for q in range(40) for r in range(7)}
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id long, query_embedding array<double>")
    for block in (20_000, 9):
        assert set(values(R.top_k(R.vector_scores(q, v, k=7, block=block), 7, "query_id", "id"), "query_id", "id", "rank")) == want
    odd = spark.createDataFrame([(1, [1.0]), (2, None), (3, [])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="unequal length"):
        R.vector_scores(q, odd).collect()
    assert {r.score for r in R.vector_scores(q, odd.where("id > 1")).collect()} == {0.0}


def test_spans(spark):
    rng = random.Random(3)
    chunks = [(1, i, a, a + rng.randint(1, 3000)) for i, a in enumerate(rng.randrange(20_000) for _ in range(20))]
    spans = [(1, i, s, s + rng.randint(1, 2500)) for i, s in enumerate(rng.randrange(20_000) for _ in range(40))] + [(1, 99, None, None), (2, 98, 0, 9)]
    got = S.overlapping(spark.createDataFrame(chunks, "d int, chunk_index int, start_char int, end_char int"), spark.createDataFrame(spans, "d int, span_id long, s int, e int"), "d")
    want = [(i, sorted(k for d, k, s, e in spans if d == 1 and s is not None and not (e <= a or s >= b))) for _, i, a, b in chunks]
    assert values(got, "chunk_index", "span_ids") == sorted(want, key=repr)


def test_graph(spark):
    checkpointed(spark)
    edges = spark.createDataFrame([("a", "x", "b"), ("b", "x", "c"), ("c", "x", "d"), ("z", "x", "a")], "source string, relation string, target string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert values(G.neighbors(edges, seeds), "neighbor") == [("b",), ("z",)]
    assert values(G.walk(edges, seeds, 2), "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("z", 1)]
    ents = spark.createDataFrame([("a",), ("b",)], "id string")
    assert values(G.upsert_relationships(edges, ents), "source", "target") == [("a", "b")]


def test_stores(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "new", 1), (2, "newer", 2), (3, "c", 1)], "k int, v string, seq int")
    assert values(stores.upsert(table, changes, ["k"], "v"), "k", "v") == [(1, "a"), (2, "newer"), (3, "c")]
    with pytest.raises(Exception, match="no value"):
        stores.upsert(table, spark.createDataFrame([(1, None, 1)], "k int, v string, seq int"), ["k"], "v").collect()


def test_crawl(spark):
    checkpointed(spark)
    pages = spark.createDataFrame([(x,) for x in "abcde"], "url string")
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "d"), ("d", "e"), ("d", "nowhere")], "url string, link string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert values(web.crawl(pages, links, seeds, 2, 10), "url", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert values(web.crawl(pages, links, seeds, 9, 3), "url") == [("a",), ("b",), ("c",)]


def test_sitemaps(spark):
    checkpointed(spark)
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = [("r", f"<sitemapindex {ns}><sitemap><loc>s1</loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>"), ("s1", f"<urlset {ns}><url><loc> u1 </loc></url><url><loc>u2</loc></url></urlset>"), ("other", "<urlset><url><loc>u3</loc></url></urlset>")]
    assert values(files.sitemap_urls(spark.createDataFrame(maps, "url string, xml string"), "r"), "url") == [("u1",), ("u2",)]
    assert files.sitemap_of("https://a.b/c/d") == "https://a.b/sitemap.xml"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("Plain é")
    (tmp_path / "sub/b.HTML").write_text("<h1>T</h1><script>x</script><p>Body <a href='/l'>link</a></p>")
    (tmp_path / "c.bin").write_bytes(b"\0")
    got = {r.file_type: r.text for r in files.load_files(spark, str(tmp_path)).collect()}
    assert got == {"txt": "Plain é", "html": "# T\n\nBody [link](/l)"}
    assert files.load_files(spark, str(tmp_path), recursive=False).count() == 1


def test_registry_and_hooks():
    r = plugins.Registry("thing")
    r.register("a", list)
    r.register_factory("a", dict)
    assert r.get("a") is dict and r.create("a", x=1) == {"x": 1} and "b" not in r
    with pytest.raises(KeyError, match="there are: a"):
        r.get("b")
    h, double = plugins.Hooks(), lambda x: x * 2
    h.register("after_chunk", double)
    assert h.run("after_chunk", 3) == 6 and h.has("after_chunk") and h.unregister("after_chunk", double) and not h.has("after_chunk")
    h.register("after_chunk", lambda x: None)
    assert h.run("after_chunk", 3) is None


def test_models(spark):
    rows = spark.createDataFrame([("a b a",), ("",), ('```json\n["fact one", "two"]\n```',)], "content string")
    vectors = [r.embedding for r in models.embed(rows).collect()]
    assert sum(x * x for x in vectors[0]) == pytest.approx(1, abs=1e-5) and not any(vectors[1])
    assert one(spark, models.facts(F.lit('```json\n["fact one", "two"]\n```'))) == ["fact one", "two"]
    assert one(spark, models.facts(F.lit("- a longer line of text\n- no"))) == ["a longer line of text"]
    answers = models.ask(rows, F.col("content"), "answer", lambda xs: [x.upper() for x in xs]).collect()
    assert answers[0].answer == "A B A"


def test_engine(spark):
    docs = spark.createDataFrame([(1, "Cats purr softly at night. " * 6), (2, "Dogs bark at the moon. " * 8), (3, "Cats purr softly at night. " * 6), (4, None)], "doc_id int, text string")
    engine = Engine(spark, most=200, least=20)
    stored = engine.ingest(docs)
    assert {r.doc_id for r in stored.collect()} == {"1", "2"}
    asked = spark.createDataFrame([(7, "the moon and dogs")], "query_id int, text string")
    for mode in ("vector", "bm25", "hybrid"):
        best = engine.query(asked, 1, mode).collect()
        assert [r.doc_id for r in best] == ["2"], mode
    assert engine.query(asked, 5, row_filter={"doc_id": "1"}).select("doc_id").distinct().collect()[0].doc_id == "1"
    assert engine.query(asked, 1, window=(1, 1)).count() >= 1
    engine.delete_document("2")
    assert engine.document_chunks("2").count() == 0


def test_greedy_decides_a_long_chain(spark):
    from lodestrand.operators.validate import greedy_near_duplicates

    pairs = spark.createDataFrame([(i, i + 1) for i in range(53)], "a long, b long").coalesce(1)
    rows = greedy_near_duplicates(spark.range(54).withColumnRenamed("id", "vec_id").coalesce(1), pairs).collect()
    assert sorted((r.vec_id, r.kept, r.duplicate_of) for r in rows) == [(i, i % 2 == 0, None if i % 2 == 0 else i - 1) for i in range(54)]
