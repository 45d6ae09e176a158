"""Inputs that aren't files: rows that come out of a shuffle have no fixed order, and results must not depend on one."""

import pytest
from pyspark.sql import functions as F

from lodestrand.llm.common import is_plain_scan, numbered
from lodestrand.llm.cube_mix import apply_mix
from lodestrand.llm.decontaminate import drop_leaks, leaks
from lodestrand.llm.exact_dedup import drop_exact_copies, exact_groups
from lodestrand.llm.langid import keep_identified
from lodestrand.llm.simhash_vptree import drop_near_copies
from lodestrand.llm.url_rules import judge_urls

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels, bench, pages = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels", "benchmark", "pages"))
    return docs, labels, bench, pages


def inputs(docs, labels):
    """The same rows out of a shuffle, a join without broadcast, and an aggregate."""
    extra = labels.select("doc_id", "quality").repartition(7, "doc_id")
    yield docs.repartition("doc_id")
    yield docs.hint("shuffle_merge").join(extra.hint("shuffle_merge"), "doc_id", "left").drop("quality")
    yield docs.groupBy(*docs.columns).count().drop("count")


@pytest.mark.parametrize("drop", [drop_exact_copies, drop_near_copies, apply_mix, "leaks", keep_identified])
def test_rows_kept(spark, tables, drop):
    docs, labels, bench, _ = tables
    run = (lambda d: drop_leaks(d, bench)) if drop == "leaks" else drop
    want = sorted(r.doc_id for r in run(docs).collect())
    assert len(want) > 100
    for given in inputs(docs, labels):
        assert sorted(r.doc_id for r in run(given).select("doc_id").collect()) == want


def test_numbers_of_a_scan_do_not_depend_on_how_it_is_cut(spark, tmp_path):
    rows = [(i, f"text {i}", None) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, _file string").repartition(5).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/x")
    docs = spark.read.parquet(f"{tmp_path}/x")
    assert is_plain_scan(docs) and is_plain_scan(docs.where("doc_id > 5").select("text", "doc_id"))
    for other in (docs.distinct(), docs.join(docs.select("doc_id"), "doc_id"), docs.limit(5), docs.sample(0.5), docs.withColumn("r", F.rand()), docs.union(docs), docs.withColumn("_metadata", F.lit(1)), spark.range(5)):
        assert not is_plain_scan(other)
    seen = []
    for size in ("4k", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        out = numbered(docs, "rid")
        assert out.columns == [*docs.columns, "rid"]
        seen.append({r.doc_id: r.rid for r in out.collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 3000
    kept = numbered(docs, "rid").where("doc_id % 7 = 0").select("rid")
    assert sorted(r.doc_id for r in numbered(docs, "rid").join(kept, "rid", "left_semi").collect()) == list(range(0, 3000, 7))


def test_rows_found(spark, tables):
    docs, labels, bench, pages = tables
    found = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for run in (lambda d: leaks(d, bench).select("doc_id", "item_id"), lambda d: exact_groups(d).select("doc_id", "keep_id", "kept")):
        want = found(run(docs))
        for given in inputs(docs, labels):
            assert found(run(given)) == want
    want = found(judge_urls(pages).select("page_id", "verdict", "rule"))
    assert found(judge_urls(pages.repartition("url")).select("page_id", "verdict", "rule")) == want
