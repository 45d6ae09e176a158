"""The search and crawl loop over an offline web, and the command line."""

from pyspark.sql import functions as F

from lodestrand import cli
from lodestrand.operators.answers import new_queries
from lodestrand.plans.research import Strategy, offline_web, search_and_crawl

TABLES = "/root/testdata/sf0.001"


def test_rounds(spark):
    web = spark.createDataFrame([(f"https://h{i % 4}.com/{i}", f"<p>page {i} {'sold out' if i == 2 else 'fresh'}</p>") for i in range(12) if i != 5], "url string, html string")
    results = [(i, f"https://h{i % 4}.com/{i}", f"title {i}" + (" spam" if i == 4 else "")) for i in range(12)]

    def search(asked):
        rows = spark.createDataFrame(results, "position long, url string, title string").withColumn("description", F.lit(None).cast("string"))
        return rows.join(F.broadcast(asked.select("round_number")))

    out = search_and_crawl(spark, ["a", "b", "c"], search, offline_web(web), Strategy(blocked=("h3.com",), preferred=("h2.com",), stale=("sold out",), bad_words=("spam",), per_round=4, max_pages=20))
    pages = {(r.round_number, r.position) for r in out.pages.collect()}
    assert pages == {(1, 6), (1, 10), (1, 0), (2, 1), (2, 8), (2, 9)} and out.queries == ["a", "b", "c"]
    why = {(r.position, r.reason) for r in out.filtered.collect()}
    assert why == {(2, "stale_content"), (5, "fetch_failed"), (3, "blocked_domain"), (7, "blocked_domain"), (11, "blocked_domain"), (4, "irrelevant")}
    assert new_queries(["A "], ["a", "b", " B", "", "c"], 1) == ["b"]


def test_command_line(spark, capsys):
    cli.main(["list"])
    assert "agg03_bm25_topk" in capsys.readouterr().out
    cli.main(["run", "gra04_neighbors", TABLES])
    cli.main(["query", f"{TABLES}/documents.parquet", "that and of", "-k", "2", "--mode", "bm25"])
    assert "rank" in capsys.readouterr().out
