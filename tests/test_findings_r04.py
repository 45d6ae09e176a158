"""Odd inputs and larger tables of the fourth round's findings."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameReader, functions as F

from lodestrand.operators import answers, near
from lodestrand.plans import catalog, served
from lodestrand.sources import sinks


def vectors_with_copies():
    """(id, vector): 90 in three dozen directions, each third one a copy, ids dealt anew."""
    rng = np.random.default_rng(4)
    base = [list(map(float, np.float32(v))) for v in rng.standard_normal((36, 8))]
    rows = [base[i % 36] if i % 3 else list(map(float, np.float32(np.array(base[i % 36]) + 0.2 * rng.standard_normal(8)))) for i in range(90)]
    return list(zip(map(int, rng.permutation(90)), rows))


def pairs_at(rows, threshold):
    units = np.array([np.array(v) / np.linalg.norm(v) for _, v in rows])
    ids = [i for i, _ in rows]
    return sorted((min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(np.triu(units @ units.T >= threshold, 1))))


@pytest.mark.parametrize("name", ["jon05_exact_pairs", "jon05_planted_pairs", "jon05_similar_pairs"])
def test_copies_pair_with_each_other_and_with_others(spark, tmp_path, monkeypatch, name):
    """of equal vectors each one has its pairs, and none are missed by chance."""
    monkeypatch.setattr(near, "TILE", 16)
    monkeypatch.setattr(near, "_hashed", None)
    rows, threshold = vectors_with_copies(), 0.4
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    if name != "jon05_similar_pairs":
        rows, threshold = [(i * 10 + k, list(np.array(v) + c * np.array(v[::-1]))) for i, v in rows for k, c in enumerate((0.0, 0.3, 0.45))], 0.9
    got = [(r.a, r.b) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == pairs_at(rows, threshold)


@pytest.mark.parametrize("method", ["exact", "hash"])
def test_a_heap_of_copies(spark, monkeypatch, method):
    monkeypatch.setattr(near, "TILE", 64)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(700, [3.0, -2.0, 1.0]), (701, None)]
    got = near.similar_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, method=method, copies=True)
    assert got.count() == got.select("a", "b").distinct().count() == 700 * 699 // 2 and got.where("a >= b or sim < 0.95").isEmpty()


def test_relations_of_whole_texts(spark, tmp_path):
    """F8: what stands after the first 12,000 characters is read, and all relations of a text count."""
    texts = [(1, "1 " * 7000 + "Anna sees Bert"), (2, "a b " + "2 " * 7000 + "c"), (3, "a b"), (4, ""), (5, "x y z w")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["llm07_triples"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, "Anna", "sees", "Bert"), (2, 0, "a", "b", "c"), (5, 0, "x", "y", "z")]
    many = lambda prompts: [json.dumps([{"subject": w, "predicate": "p", "object": "o"} for w in p.split("\n", 1)[1].split()]) for p in prompts]
    chunks = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(4000)))], "chunk_id long, content string")
    assert [r.subject for r in answers.relation_triples(chunks, many).orderBy("position").collect()] == [f"w{i}" for i in range(4000)]


def test_many_files_lie_in_shelves(spark, tmp_path, monkeypatch):
    """no job writes or reads more than some files; what was saved before stays or goes as the mode says."""
    monkeypatch.setattr(sinks, "SHELF", 20, raising=False)
    pages = [(i, f"https://e.com/{i % 90}", f"\npage {i}\n\n") for i in range(100)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    jobs, real = [], DataFrameReader.text
    monkeypatch.setattr(DataFrameReader, "text", lambda *a, **k: (jobs.append(real(*a, **k)), jobs[-1])[1])
    got = sorted(tuple(r) for r in catalog.QUERIES["snk08_saved_pages"](spark, str(tmp_path)).collect())
    assert got == sorted((f"e.com_{i % 90}.md", f"---\nurl: {u}\nstatus_code: 200\n---\n\n{x}") for i, u, x in pages)
    assert sorted(tuple(r) for r in catalog.QUERIES["snk14_spilled_pages"](spark, str(tmp_path)).collect()) == [(i, x.lstrip("\n")) for i, _, x in pages]
    assert len(jobs) >= 10 and max(len(j.inputFiles()) for j in jobs) < 50
    rows, to = spark.range(30).selectExpr("CAST(id AS string) AS f", "'x' AS b"), f"{tmp_path}/kept"
    read = lambda: sorted(r.file for r in sinks.read_texts(spark, to).collect())
    sinks.save_texts(rows.where("f < '2'"), F.col("f"), F.col("b"), to)
    sinks.save_texts(rows, F.col("f"), F.col("b"), to, "append")
    assert read() == sorted([str(i) for i in range(30)] + [str(i) for i in range(30) if str(i) < "2"])
    sinks.save_texts(rows, F.col("f"), F.col("b"), to)
    assert read() == sorted(str(i) for i in range(30))


def test_events_are_held_by_blocks(tmp_path, monkeypatch):
    """posts are read from blocks of a file, also of rows in no order and with gaps; few blocks are held."""
    for name, n in (("_BLOCK", 50), ("_HELD", 3), ("_SORTED", 300)):
        monkeypatch.setattr(served, name, n, raising=False)
    ids = np.random.default_rng(2).permutation(2000)[:1500]
    at = pa.array([1704067200_000_000 + int(i) * 1_000_000 for i in ids], pa.timestamp("us"))
    pq.write_table(pa.table({"event_id": ids, "ts": at, "user_id": ids % 7, "event_type": [("click", "view")[i % 2] for i in ids], "value": ids * 0.5, "props": ["{}"] * 1500}), tmp_path / "events.parquet")
    server, got, parents, token, known = served.Served(str(tmp_path)), [], {}, "0", set(ids.tolist())
    while token:
        answer = server.answer("/2/tweets/search/recent", {"query": "click", "end_time": "2024-01-01T00:30:00Z", "max_results": "100", "next_token": token})
        got, token = got + [int(x["id"]) for x in answer["data"]], answer["meta"].get("next_token")
        parents |= {int(x["id"]): x["author_id"] for x in answer["includes"]["tweets"]}
    assert got == sorted(i for i in known if i % 2 == 0 and i < 1800)
    assert parents == {i // 2: str(i // 2 % 7) for i in got if i % 3 and i // 2 in known}
    assert "events" not in server.tables and len(server.events().held) <= 3 and server.events().num_rows == 1500
    server.server.shutdown()
