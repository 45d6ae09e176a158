"""The engine's facade: ingest documents into a table of chunks, query it, search and crawl."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import models, plugins
from .functions.text import not_blank
from .operators import answers, graph, retrieve, stores, validate
from .operators.keyed import KeyedTable
from .sources import files as sources
from .sources.pages import as_documents
from .sources.state import scratch, stored
from .streaming.frontier import crawl_web, http_fetch

_CHUNKS = "chunk_id string, doc_id string, chunk_index int, content string, quality double, embedding array<float>"
_STATE = "path string, hash string, mtime timestamp"


class Engine:
    """API-01: chunks are a keyed table, and methods return DataFrames. Hooks run around extraction, chunking, crawling.

    store: a folder that keeps the chunks beyond the session (and holds those of earlier ones); without it they go with it.
    validators: names of registered conditions that chunks must meet besides quality.

    model: a text model (texts -> answers) for query expansion, extraction and reports; without one these fall back.
    """

    def __init__(self, spark: SparkSession, chunker: str = "sentence", embedder: Callable | None = None, min_quality: float = 0.3, deduplicate: bool = True, model: Callable | None = None, add_ons: tuple[str, ...] = (), crawler: Callable | None = None, provider: Callable | None = None, validators: tuple[str, ...] = (), store: str | None = None, **chunk_options):
        self.spark, self.chunker, self.embedder, self.model = spark, chunker, embedder, model
        self.min_quality, self.deduplicate, self.chunk_options, self.add_ons = min_quality, deduplicate, chunk_options, list(add_ons)
        self.crawler, self.provider = crawler or plugins.crawlers.get("http"), provider or plugins.search_providers.get("stub")
        self.hooks = plugins.Hooks()
        self.validators = list(validators)
        self.table = KeyedTable(spark, store or scratch(spark, "chunks"), ["chunk_id"], _CHUNKS)
        self.state = spark.createDataFrame([], _STATE)
        self.entities = spark.createDataFrame([], "label string, id string, attributes map<string,string>, seq long")
        self.edges = spark.createDataFrame([], "source string, relation string, target string")

    @property
    def chunks(self) -> DataFrame | None:
        """The chunks as of now; None before the first load."""
        return self.table.read() if self.table.version() else None

    # ingestion

    def ingest(self, docs: DataFrame, key: str = "doc_id", text: str = "text", chunker: str | None = None) -> DataFrame:
        """SRC-26: documents -> validated, deduplicated, embedded chunks, added to the engine's table (same ids replaced).

        A chunk whose content another chunk of this or an earlier load has is left out. The documents are read once.
        """
        for point in ("after_extract", "before_chunk"):
            docs = self.hooks.run(point, docs)
            if docs is None:
                return self._empty()
        options = self.chunk_options if chunker in (None, self.chunker) else {}
        chunks = plugins.chunker_for(chunker or self.chunker)(docs.where(not_blank(F.col(text))), key=key, text=text, **options)
        chunks = chunks.select(F.col(key).cast("string").alias("doc_id"), "chunk_index", "content")
        chunks = chunks.withColumn("chunk_id", F.sha2(F.concat_ws(":", "doc_id", F.col("chunk_index").cast("string")), 256))
        chunks = self.hooks.run("after_chunk", chunks)
        if chunks is None:
            return self._empty()
        good = validate.with_quality(chunks, min_score=self.min_quality).where("passed").select("chunk_id", "doc_id", "chunk_index", "content", "quality")
        good = plugins.validated(good, self.validators)
        if self.deduplicate:
            good = validate.exact_duplicates(good).where(~F.col("is_duplicate")).drop("is_duplicate", "content_hash")
            good = good if self.chunks is None else validate.new_contents(good, self.chunks)
        kept = stores.embedded(models.embed(good, model=self.embedder))
        kept = plugins.run_add_ons(kept, self.add_ons).select("chunk_id", "doc_id", "chunk_index", "content", "quality", "embedding") if self.add_ons else kept
        kept = stored(kept, "ingested")
        self.table.upsert(kept.withColumn("_last", F.col("content")), order="_last")
        return kept

    def ingest_with_adaptive_chunking(self, docs: DataFrame, key: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
        """CHK-14: each document by the chunker that the model chooses for it (markdown files and no answer: hierarchical)."""
        named = docs.withColumn("_name", F.col(name) if name else F.lit(""))
        chosen = stored(answers.chosen_strategies(named, self.model or (lambda prompts: [None] * len(prompts)), "_name", text), "strategies")
        out = self._empty()
        for strategy in ("hierarchical", "semantic", "sentence", "sliding_window"):
            mine = chosen.where(F.col("strategy") == strategy)
            if not mine.isEmpty():
                out = out.unionByName(self.ingest(mine.drop("strategy", "_name"), key, text, strategy))
        return out

    def ingest_directory(self, path: str, recursive: bool = True, skip_known: bool = True) -> DataFrame:
        """SRC-27, JON-11, AGG-05: files into chunks; returns a row a file: source, success, skipped, error, n_chunks, n_stored,
        seconds (of the batch, shared evenly). stores.batch_totals() sums it up.

        Files that the engine has seen with the same content and time are skipped, without being chunked again.
        """
        began = time.monotonic()
        files = stored(sources.read_files(self.spark, path, recursive, extractors={n: plugins.extractors.get(n) for n in plugins.extractors.names()}), "files")
        todo = stores.to_process(files, self.state) if skip_known else files
        good = todo.where(F.col("error").isNull() & not_blank(F.col("text")))
        kept = self.ingest(good, "path")
        seen = todo.where("error is null").select("path", "hash", "mtime", F.lit(1).alias("seq"))
        self.state = stored(stores.updated_cache(self.state, seen, ["path"]), "ingest")
        counts = kept.groupBy(F.col("doc_id").alias("path")).agg(F.count("*").alias("n"))
        rows = files.select("path", "error", not_blank(F.col("text")).alias("whole")).join(todo.select("path", F.lit(True).alias("new")), "path", "left").join(counts, "path", "left")
        skipped = F.col("new").isNull()
        error = F.when(skipped, None).when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce("whole", F.lit(False)), "no text")
        share = (time.monotonic() - began) / max(1, files.count())
        return rows.select(F.col("path").alias("source"), error.isNull().alias("success"), skipped.alias("skipped"), error.alias("error"), F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("n", F.lit(0)).alias("n_stored"), F.lit(share).alias("seconds"))

    def process_directory_streaming(self, path: str) -> Iterator[DataFrame]:
        """STR-01: a folder file by file, without the check for what is known; each result is a table of chunks."""
        for row in sources.read_files(self.spark, path).select("path").toLocalIterator():
            yield self.ingest(sources.load_files(self.spark, row["path"]), "path")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], _CHUNKS)

    def delete_document(self, doc_id: str) -> None:
        if self.chunks is not None:
            self.table.delete(self.chunks.where(F.col("doc_id") == doc_id).select("chunk_id"))

    def clear(self) -> None:
        """SNK-05"""
        self.table.clear()

    def document_chunks(self, doc_id: str, limit: int = 1000) -> DataFrame:
        return stores.by_document(self._empty() if self.chunks is None else self.chunks, doc_id, "doc_id", "chunk_index", limit)

    # queries

    def query(self, queries: DataFrame, k: int = 10, mode: str = "vector", row_filter: dict | None = None, window: tuple[int, int] | None = None, expansion: str | None = None) -> DataFrame:
        """queries (query_id, text) -> query_id, chunk_id, score or rrf, rank, and the chunk; with a window, its neighbours too.

        mode: vector, bm25 or hybrid. The filter holds for all sides. expansion: multi_query or hyde asks the model for other
        wordings or for drafts, searches each and fuses the ranks (TOP-04).
        """
        chunks = self._empty() if self.chunks is None else self.chunks
        kept = chunks.where(retrieve.matches(row_filter)) if row_filter else chunks
        asked = queries.select("query_id", "text")
        if expansion == "multi_query":
            asked = answers.expanded_queries(asked, self.model)
        elif expansion == "hyde":
            model = self.model or (lambda prompts: [None] * len(prompts))
            asked = answers.drafts(asked, lambda prompts, bold: model(prompts)).select("query_id", "position", F.col("draft").alias("text"))
        elif expansion:
            raise ValueError(f"unknown expansion {expansion!r}")
        if expansion:
            asked = asked.withColumnRenamed("query_id", "_of").withColumn("query_id", F.concat_ws("/", F.col("_of").cast("string"), F.col("position").cast("string")))
        vectors = models.embed(asked, "text", "query_embedding", self.embedder).select("query_id", "query_embedding")
        vector = lambda: retrieve.vector_scores(vectors, kept.select("chunk_id", "embedding"), k=2 * k)
        lexical = lambda: retrieve.bm25(asked, kept, "query_id", "text", "chunk_id", "content")
        if mode == "hybrid":
            hits = retrieve.hybrid(lexical(), vector(), "query_id", "chunk_id", k)
        else:
            hits = retrieve.top_k({"vector": vector, "bm25": lexical}[mode](), k, "query_id", "chunk_id")
        if expansion:
            ranked = hits.join(asked.select("query_id", "_of"), "query_id").select(F.col("_of").alias("query_id"), "chunk_id", "rank")
            hits = retrieve.top_k(retrieve.fuse_ranks(ranked, "query_id", "chunk_id"), k, "query_id", "chunk_id", "rrf")
        found = hits.join(kept.drop("embedding"), "chunk_id")
        if window is None:
            return found
        return retrieve.context_windows(found.select("query_id", "rank", "doc_id", "chunk_index"), chunks.select("doc_id", "chunk_index", "chunk_id", "content"), "doc_id", "chunk_index", *window)

    # crawling

    def crawl(self, urls: DataFrame, max_depth: int = 1, use_sitemap: bool = False, fetch: Callable | None = None, path: str | None = None, **options) -> DataFrame:
        """urls (url) -> what the crawler gets, between the hooks before_crawl and after_crawl (None skips: no rows).

        With max_depth over 1, a sitemap or other options (max_pages, follow, exclude, same_domain, delay: see
        frontier.crawl_web), links are followed; path keeps such a crawl, so that it can go on later. What was fetched is
        stored once: using the result again requests nothing.
        """
        urls = self.hooks.run("before_crawl", urls)
        if urls is None:
            return self.spark.createDataFrame([], "url string, status_code int, content string, markdown string, error string")
        if max_depth > 1 or use_sitemap or options:
            found = crawl_web(urls.select("url"), path or scratch(self.spark, "crawl"), fetch or http_fetch, max_depth=max_depth, use_sitemap=use_sitemap, **options)
            got = sources.pages_to_markdown(found, "content")
        else:
            got = stored(self.crawler(urls), "fetched")
        after = self.hooks.run("after_crawl", got)
        return got.limit(0) if after is None else after

    def crawl_one(self, url: str) -> DataFrame:
        return self.crawl(self.spark.createDataFrame([(url,)], "url string"))

    def crawl_many(self, urls: list[str]) -> DataFrame:
        return self.crawl(self.spark.createDataFrame([(u,) for u in urls], "url string"))

    def crawl_and_ingest_many(self, urls: list[str], schema: str | None = None) -> DataFrame:
        """SRC-22, SRC-23: what could be crawled, as documents named by their url; with a schema, the model's reading of each
        page is part of its text."""
        return self._ingest_pages(self.crawl_many(urls), schema)

    def _ingest_pages(self, pages: DataFrame, schema: str | None = None) -> DataFrame:
        docs = as_documents(pages, "url")
        if schema and self.model:
            read = answers.extracted(docs, self.model, schema)
            docs = read.withColumn("text", F.when(F.col("data").isNotNull(), F.concat("text", F.lit("\n\n"), F.to_json("data"))).otherwise(F.col("text"))).drop("data")
        return self.ingest(docs, "url")

    def crawl_and_ingest_one(self, url: str, schema: str | None = None) -> DataFrame:
        """As the batch form, but a page that can't be had is an error."""
        pages = self.crawl_one(url)
        row = pages.select("error").first()
        if row is None or row["error"] is not None:
            raise RuntimeError(f"{url}: {row['error'] if row else 'nothing came back'}")
        return self._ingest_pages(pages, schema)

    def crawl_and_query(self, urls: list[str], text: str, k: int = 10) -> DataFrame:
        self.crawl_and_ingest_many(urls)
        return self.query(self.spark.createDataFrame([(0, text)], "query_id int, text string"), k)

    def search_crawl_extract(self, queries: list[str], schema: str | None = None, strategy=None):
        """GRA-07: the search and crawl loop; returns its trace, with the model's reading of each page by the schema."""
        from .plans.research import Strategy, search_and_crawl

        trace = search_and_crawl(self.spark, queries, self.provider, self.crawler, strategy or Strategy())
        if schema and self.model:
            trace.pages = answers.extracted(trace.pages, self.model, schema, "summary")
        return trace

    def achieve_goal(self, goal: str, kind: str = "summary", strategy=None) -> DataFrame:
        """LLM-10, LLM-13: queries for the goal, the search and crawl loop, and a report of what was found."""
        planner = answers.Planner((lambda prompt: self.model([prompt])[0]) if self.model else (lambda prompt: None))
        trace = self.search_crawl_extract(planner.plan(goal), strategy=strategy)
        pages = trace.pages.select(F.lit(goal).alias("goal"), F.col("url"), F.col("summary").alias("text"))
        return answers.report(pages, self.model or (lambda prompts: [None] * len(prompts)), "goal", "url", kind)

    # the graph

    def extract_entities(self, chunks: DataFrame, model: Callable | None = None) -> DataFrame:
        """LLM-06, GRA-01, SNK-06: entities of chunks (chunk_id, content), merged into the engine's graph."""
        found = answers.grounded_entities(chunks, model or self.model or models.capitalised_entities)
        made = found.select(F.col("kind").alias("label"), graph.entity_id(F.col("chunk_id"), F.col("position"), F.col("text"), F.col("start"), F.col("end")).alias("id"), F.create_map(F.lit("text"), "text").alias("attributes"), F.col("position").cast("long").alias("seq"))
        self.entities = stored(self.entities.unionByName(made), "entities")
        return graph.upsert_entities(self.entities)

    def list_entities(self, label: str | None = None, attributes: dict[str, str] | None = None, limit: int = 100) -> DataFrame:
        """GRA-03, API-07"""
        rows = graph.upsert_entities(self.entities)
        rows = rows if label is None else rows.where(F.col("label") == label)
        for k, v in (attributes or {}).items():
            rows = rows.where(F.col("attributes")[k] == v)
        return rows.orderBy("label", "id").limit(limit)

    def neighbors(self, node: str, depth: int = 1, limit: int = 500) -> DataFrame:
        """GRA-04, API-07"""
        seeds = self.spark.createDataFrame([(node,)], "seed string")
        return graph.neighbors(self.edges, seeds).limit(limit) if depth == 1 else graph.path_edges(self.edges, seeds, depth, limit)


def ingest(spark: SparkSession, docs: DataFrame, **options) -> Engine:
    """API-02: an engine that holds the documents."""
    engine = Engine(spark, **options)
    engine.ingest(docs)
    return engine


def process_directory(spark: SparkSession, path: str, **options) -> tuple[Engine, DataFrame]:
    """API-02: an engine that holds a folder's files, and the totals of the batch."""
    engine = Engine(spark, **options)
    return engine, stores.batch_totals(engine.ingest_directory(path).where("not skipped"))


def query(engine: Engine, text: str, k: int = 10, **options) -> DataFrame:
    """API-02: one text against an engine."""
    return engine.query(engine.spark.createDataFrame([(0, text)], "query_id int, text string"), k, **options)
