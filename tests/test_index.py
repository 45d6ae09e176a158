"""The kept index against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrand.functions.text import term_counts, tokens
from lodestrand.operators import retrieve as R
from lodestrand.operators.index import TermIndex

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((r.item_id, r.doc_id, r.score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    made = TermIndex(spark, f"{tmp_path_factory.mktemp('index')}/i", buckets=8, range_docs=16)
    for k in range(3):
        made.add(docs.where(F.col("doc_id") % 3 == k))
    return made


def test_terms_are_counted_inside_a_row(spark):
    texts = ["b a b  B", "", None, "a", "x_1 ünï ünï x_1 a1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", term_counts(tokens(F.col("text"))).alias("t"))
    got = {r.id: [tuple(x) for x in r.t] for r in df.collect()}
    assert got == {0: [("a", 1), ("b", 3)], 1: [], 2: [], 3: [("a", 1)], 4: [("a1", 1), ("x_1", 2), ("ünï", 2)]}


@pytest.mark.parametrize("standard", [False, True])
def test_results_are_those_of_scoring_everything(spark, docs, index, standard):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    terms = spark.createDataFrame([(1000, "the of and"), (1001, "nowhere zzz"), (1002, ""), (1003, None), (1004, "that that that")], "item_id long, text string")
    for asked, k in ((bench, 10), (terms, 3), (terms, 5000)):
        want = R.top_k(R.bm25(asked, docs, standard=standard), k, "item_id", "doc_id")
        assert rows(index.search(asked, k, standard=standard)) == rows(want)


def test_ranges_are_skipped_and_folders_pruned(spark, docs, index):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    reach = index.reach(bench, 3).collect()
    assert sum(r.n_read for r in reach) < 0.7 * sum(r.n_ranges for r in reach)
    few = index.blocks(spark.createDataFrame([("that",)], "term string"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan[plan.index("PartitionFilters") :].split("]")[0]
    assert len({f.split("bucket=")[1].split("/")[0] for f in few.inputFiles()}) == 8  # before pruning
    assert few.select("bucket").distinct().count() == 1


def test_counts_come_from_the_blocks(index, docs):
    want = {r.term: (r.df, r.total) for r in R.term_index(docs).collect()}
    assert {r.term: (r.df, r.total) for r in index.terms().collect()} == want
    n, avgdl = index.stats()
    lengths = [r.dl for r in R.chunk_lengths(docs).collect()]
    assert n == len(lengths) and avgdl == pytest.approx(sum(lengths) / n)


def test_a_load_that_fails_counts_for_nothing_and_rewriting_keeps_results(spark, docs, tmp_path):
    asked = spark.createDataFrame([(1, "that of the in"), (2, "and")], "item_id long, text string")
    made = TermIndex(spark, f"{tmp_path}/i", range_docs=8, buckets=4)
    assert made.search(asked, 5).collect() == [] and made.stats() == (0, 0.0)
    made.add(docs.where("doc_id < 100"))
    bad = F.when(F.col("doc_id") == 120, F.raise_error(F.lit("gone"))).otherwise(F.col("text"))
    with pytest.raises(Exception, match="gone"):
        made.add(docs.where("doc_id between 100 and 199").withColumn("text", bad))
    held = docs.where("doc_id < 100")
    assert len(made.loads()) == 1 and rows(made.search(asked, 5)) == rows(R.top_k(R.bm25(asked, held), 5, "item_id", "doc_id"))
    made.add(docs.where("doc_id between 100 and 199"))
    held = docs.where("doc_id < 200")
    assert len(made.loads()) == 2 and rows(made.search(asked, 5)) == rows(R.top_k(R.bm25(asked, held), 5, "item_id", "doc_id"))
    gone = spark.createDataFrame([(k,) for k in random.Random(1).sample(range(200), 50)], "doc_id long")
    made.rewritten(without=gone)
    held = held.join(gone, "doc_id", "left_anti")
    assert len(made.loads()) == 1 and made.stats()[0] == 150
    assert rows(TermIndex(spark, f"{tmp_path}/i", range_docs=8, buckets=4).search(asked, 5)) == rows(R.top_k(R.bm25(asked, held), 5, "item_id", "doc_id"))


def test_text_keys_and_terms_that_are_too_many_to_tell(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([("a", "x y y"), ("b", "y z"), ("c", None)], "chunk_id string, content string")
    asked = spark.createDataFrame([("q", "y z w")], "query_id string, text string")
    want = R.top_k(R.bm25(asked, chunks, "query_id", "text", "chunk_id", "content"), 5, "query_id", "chunk_id").collect()
    made = TermIndex(spark, f"{tmp_path}/i", "chunk_id", "string")
    made.add(chunks, "content")
    assert sorted(map(tuple, made.search(asked, 5, "query_id").collect())) == sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in want)
    monkeypatch.setattr(R, "_TOLD", 1)
    assert R.top_k(R.bm25(asked, chunks, "query_id", "text", "chunk_id", "content"), 5, "query_id", "chunk_id").collect() == want


def test_no_row_is_made_for_each_query_range_and_term(spark, docs, tmp_path, monkeypatch):
    """Queries' terms are told to tasks, in parts where they are many; postings are moved as blocks."""
    from lodestrand.operators import index as X

    asked = spark.createDataFrame([(i, "that of the in and nowhere") for i in range(60)], "item_id long, text string")
    want = rows(R.top_k(R.bm25(asked, docs), 5, "item_id", "doc_id"))
    made = TermIndex(spark, f"{tmp_path}/i", range_docs=16, buckets=4)
    made.add(docs)
    assert rows(made.search(asked, 5)) == want
    part = made._parts(asked, "item_id", "text")[0]
    ranges, told, blocks = made._ranges(part, False)
    plan = made._scores(ranges, told, blocks, False, 5, 6)._jdf.queryExecution().executedPlan().toString()
    assert "qtf" not in plan and "explode" not in plan.lower()
    monkeypatch.setattr(X, "_PAIRS", 70)
    assert len(made._parts(asked, "item_id", "text")) > 1 and rows(made.search(asked, 5)) == want


def test_a_range_in_two_batches_counts_once(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        docs = spark.createDataFrame([(i, f"a b{i % 3} " + "c " * (i % 4)) for i in range(40)], "doc_id long, text string").coalesce(1)
        made = TermIndex(spark, f"{tmp_path}/i", range_docs=8, buckets=2)
        made.add(docs)
        assert made.blocks().groupBy("term", "range").count().where("count > 1").count() > 0
        asked = spark.createDataFrame([(1, "a b1 c"), (2, "b2 b2")], "item_id long, text string")
        assert rows(made.search(asked, 40)) == rows(R.top_k(R.bm25(asked, docs), 40, "item_id", "doc_id"))
        assert {r.term: (r.df, r.total) for r in made.terms().collect()} == {r.term: (r.df, r.total) for r in R.term_index(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
