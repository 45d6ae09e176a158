"""python -m lodestrand.cli: registered queries, ingestion, search, crawling, the graph, and the two services."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, functions as F


def _pair(text: str) -> tuple[str, str]:
    key, _, value = text.partition("=")
    if not value:
        raise argparse.ArgumentTypeError(f"{text!r} isn't KEY=VALUE")
    return key, value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrand")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, said: sub.add_parser(name, help=said)
    add("list", "names of registered queries")
    run = add("run", "run a registered query over a folder of tables")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    ingest = add("ingest", "files into a table of chunks")
    ingest.add_argument("path")
    ingest.add_argument("out", help="folder of the table")
    ingest.add_argument("--chunker", default="sentence")
    for name, said in (("query", "search documents"), ("progressive-query", "search page summaries, then the pages that were found")):
        query = add(name, f"{said} (Parquet with doc_id and text, or a folder of files)")
        query.add_argument("path")
        query.add_argument("text")
        query.add_argument("-k", type=int, default=10)
        query.add_argument("--mode", choices=("vector", "bm25", "hybrid"), default="hybrid")
        query.add_argument("--filter", type=json.loads, help='JSON, such as {"doc_id": ["1", "2"]}')
        query.add_argument("--window", type=int, nargs=2, metavar=("BEFORE", "AFTER"))
        query.add_argument("--expansion", choices=("multi_query", "hyde"))
        query.add_argument("--files", action="store_true", help="the path is a folder of files")
    crawl = add("crawl", "fetch pages")
    crawl.add_argument("urls", nargs="+")
    crawl.add_argument("--out", help="save them here")
    crawl.add_argument("--depth", type=int, default=1, help="waves of links that are followed")
    crawl.add_argument("--max-pages", type=int)
    crawl.add_argument("--follow", action="append", default=[], help="a pattern that links must hold")
    crawl.add_argument("--exclude", action="append", default=[], help="a pattern that links may not hold")
    crawl.add_argument("--same-domain", action="store_true")
    crawl.add_argument("--sitemap", action="store_true", help="start from the sitemaps, too")
    crawl.add_argument("--delay", type=float, default=0.0, help="seconds between requests to a host")
    crawl.add_argument("--state", help="keep the crawl here, so that it can go on later")
    crawl.add_argument("--kind", choices=("md", "html", "json", "all"), default="md")
    search = add("search", "results of the search provider")
    search.add_argument("text")
    search.add_argument("-n", type=int, default=10)
    for name, said in (("research", "search, crawl and filter, a round for each query"), ("goal", "queries for a goal, the loop, and a report")):
        loop = add(name, said)
        loop.add_argument("texts", nargs="+")
        loop.add_argument("--per-round", type=int, default=10)
        loop.add_argument("--max-pages", type=int, default=50)
        loop.add_argument("--block", action="append", default=[], metavar="DOMAIN")
        loop.add_argument("--prefer", action="append", default=[], metavar="DOMAIN")
    expand = add("search-expand", "users reached from the authors of the best posts")
    expand.add_argument("posts", help="Parquet with url, score, error")
    expand.add_argument("follows", help="Parquet with user, follower")
    expand.add_argument("--top", type=int, default=10)
    expand.add_argument("--levels", type=int, default=1)
    graph = add("graph-query", "entities or neighbours of a graph kept as Parquet")
    graph.add_argument("what", choices=("entities", "neighbors"))
    graph.add_argument("path", help="Parquet: label, id, attributes, seq; or source, relation, target")
    graph.add_argument("--node")
    graph.add_argument("--label")
    graph.add_argument("--attr", action="append", default=[], type=_pair, metavar="KEY=VALUE")
    graph.add_argument("--depth", type=int, default=1)
    graph.add_argument("--limit", type=int, default=100)
    api = add("api", "the engine over HTTP")
    api.add_argument("--host", default="127.0.0.1")
    api.add_argument("--port", type=int, default=8080)
    add("mcp", "the tools over JSON-RPC on standard input")
    return p


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    from .plans import catalog

    if given.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = SparkSession.builder.getOrCreate()
    if given.command == "run":
        out = catalog.QUERIES[given.name](spark, given.sf_dir)
        out.write.parquet(given.out) if given.out else out.show(20, False)
        return
    from .engine import Engine
    from .sources.files import load_files

    if given.command == "ingest":
        engine = Engine(spark, given.chunker)
        engine.ingest_directory(given.path).show(1000, False)
        engine.chunks.write.mode("overwrite").parquet(given.out)
        return
    engine = Engine(spark)
    if given.command in ("query", "progressive-query"):
        docs = load_files(spark, given.path).withColumn("doc_id", F.col("path")) if given.files else spark.read.parquet(given.path)
        asked = spark.createDataFrame([(0, given.text)], "query_id int, text string")
        if given.command == "progressive-query":
            from .streaming.incremental import progressive_query

            progressive_query(engine, docs, asked, given.k, given.mode).show(given.k, 100)
            return
        engine.ingest(docs)
        engine.query(asked, given.k, given.mode, given.filter, tuple(given.window) if given.window else None, given.expansion).show(given.k, 100)
    elif given.command == "crawl":
        options = {"max_pages": given.max_pages, "follow": tuple(given.follow), "exclude": tuple(given.exclude), "same_domain": given.same_domain, "delay": given.delay}
        deep = given.depth > 1 or given.sitemap or given.state or any(options.values())
        urls = spark.createDataFrame([(u,) for u in given.urls], "url string")
        got = engine.crawl(urls, given.depth, given.sitemap, path=given.state, **options) if deep else engine.crawl(urls)
        if given.out:
            from .sources.sinks import save_crawl

            save_crawl(got.withColumns({"title": F.lit(None).cast("string"), "links": F.array().cast("array<string>")}), given.out, given.kind)
        else:
            got.select("url", "status_code", "error", F.substring("markdown", 1, 200).alias("markdown")).show(100, False)
    elif given.command == "search":
        engine.provider(spark.createDataFrame([(1, given.text)], "round_number int, query string")).where(F.col("position") <= given.n).show(given.n, False)
    elif given.command in ("research", "goal"):
        from .plans.research import Strategy

        strategy = Strategy(blocked=tuple(given.block), preferred=tuple(given.prefer), per_round=given.per_round, max_pages=given.max_pages)
        if given.command == "goal":
            engine.achieve_goal(" ".join(given.texts), strategy=strategy).show(1, False)
        else:
            engine.search_crawl_extract(given.texts, strategy=strategy).pages.show(given.max_pages, 100)
    elif given.command == "search-expand":
        from .plans.research import search_and_expand

        search_and_expand(spark.read.parquet(given.posts), spark.read.parquet(given.follows), given.top, given.levels)[1].show(1000, False)
    elif given.command == "graph-query":
        table = spark.read.parquet(given.path)
        if given.what == "entities":
            engine.entities = table
            engine.list_entities(given.label, dict(given.attr), given.limit).show(given.limit, False)
        else:
            engine.edges = table
            engine.neighbors(given.node, given.depth, given.limit).show(given.limit, False)
    else:
        from .service import Service, http_server, serve_lines

        service = Service(engine)
        serve_lines(service) if given.command == "mcp" else http_server(service, given.host, given.port).serve_forever()


if __name__ == "__main__":
    main()
