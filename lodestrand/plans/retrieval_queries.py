"""Queries over documents, benchmark texts, vectors and conversations: search, fusion, filters, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..operators import retrieve as R
from ..operators.index import TermIndex
from ..sources.state import scratch
from .registered import query, table

_INDEXES: dict[tuple, TermIndex] = {}


def kept_index(spark, sf) -> TermIndex:
    """The index over the documents of a folder, in two loads, by document; made once a session and source.

    Searches over it read no text. It is made anew if the table's files change.
    """
    docs = table(spark, sf, "documents")
    stamp = tuple(sorted(map(tuple, docs.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string")).distinct().collect())))
    name = (spark.sparkContext.applicationId, sf, stamp)
    if name not in _INDEXES:
        index = TermIndex(spark, scratch(spark, "index"))
        for k in (0, 1):
            index.add(docs.where(F.pmod("doc_id", F.lit(2)) == k))
        _INDEXES[name] = index
    return _INDEXES[name]

POSTINGS_SQL = r"""
    t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
    p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS dl FROM documents)"""


def bm25_sql(multiplicity: str) -> str:
    return POSTINGS_SQL + rf""",
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
    q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark) GROUP BY ALL),
    lexical AS (SELECT item_id, doc_id, round(sum(qtf * {multiplicity} * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
                FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (doc_id), c GROUP BY 1, 2)"""


COSINE_SQL = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"


def _queries(spark, sf, step: int = 20):
    return table(spark, sf, "embeddings").where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


@query("flt01_metadata_filter", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source = 'src3'")
def flt01_metadata_filter(spark, sf):
    return table(spark, sf, "documents").where(R.matches({"lang": ["en", "de"], "source": "src3"})).select("doc_id")


@query("flt01_extra_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('7', '8', '9')")
def flt01_extra_filter(spark, sf):
    return table(spark, sf, "events").where(R.matches_extra(F.col("props"), {"k": [7, 8, 9]})).select("event_id")


@query("agg01_term_frequencies", f"WITH {POSTINGS_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM p GROUP BY term")
def agg01_term_frequencies(spark, sf):
    return R.term_index(table(spark, sf, "documents"))


@query("agg01_corpus_stats", f"WITH {POSTINGS_SQL} SELECT count(*) AS n, sum(dl)::BIGINT AS n_tokens, round(avg(dl), 6) AS avgdl FROM l")
def agg01_corpus_stats(spark, sf):
    return R.chunk_lengths(table(spark, sf, "documents")).agg(F.count("*").alias("n"), F.sum("dl").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avgdl"))


@query("agg03_bm25_topk", f"WITH {bm25_sql('tf')} SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 10")
def agg03_bm25_topk(spark, sf):
    return kept_index(spark, sf).search(table(spark, sf, "benchmark"), 10)


@query("agg03_bm25_standard", f"WITH {bm25_sql('1')} SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 10")
def agg03_bm25_standard(spark, sf):
    return kept_index(spark, sf).search(table(spark, sf, "benchmark"), 10, standard=True)


@query("top02_bm25_scan", f"WITH {bm25_sql('tf')} SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 5")
def top02_bm25_scan(spark, sf):
    """Without an index: one pass over the texts."""
    return R.top_k(R.bm25(table(spark, sf, "benchmark"), table(spark, sf, "documents"), k=5), 5, "item_id", "doc_id")


@query("top01_vector_topk", f"""
    SELECT q.vec_id AS query_id, v.vec_id, {COSINE_SQL} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE_SQL} DESC, v.vec_id) AS rank
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10""")
def top01_vector_topk(spark, sf):
    return R.top_k(R.vector_scores(_queries(spark, sf), table(spark, sf, "embeddings").drop("label"), k=10), 10, "query_id", "vec_id")


@query("top01_filtered_topk", f"""
    SELECT q.vec_id AS query_id, v.vec_id, {COSINE_SQL} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE_SQL} DESC, v.vec_id) AS rank
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.label IN (1, 2, 3) QUALIFY rank <= 5""")
def top01_filtered_topk(spark, sf):
    return R.top_k(R.vector_scores(_queries(spark, sf), table(spark, sf, "embeddings"), row_filter={"label": [1, 2, 3]}, k=5).drop("label"), 5, "query_id", "vec_id")


@query("agg04_rank_fusion", f"""
    WITH s AS (SELECT q.vec_id AS qid, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE_SQL} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10)
    SELECT vec_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM s GROUP BY vec_id""")
def agg04_rank_fusion(spark, sf):
    ranked = R.top_k(R.vector_scores(_queries(spark, sf), table(spark, sf, "embeddings").drop("label"), k=10), 10, "query_id", "vec_id")
    return R.fuse_ranks(ranked, None, "vec_id").withColumn("rrf", F.round("rrf", 6))


@query("top04_multi_query", f"""
    WITH s AS (SELECT q.vec_id // 60 AS question, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE_SQL} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10),
         f AS (SELECT question, vec_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM s GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY question ORDER BY rrf DESC, vec_id) AS rank FROM f QUALIFY rank <= 10""")
def top04_multi_query(spark, sf):
    ranked = R.top_k(R.vector_scores(_queries(spark, sf), table(spark, sf, "embeddings").drop("label"), k=10), 10, "query_id", "vec_id")
    return R.top_k(R.fuse_ranks(ranked.withColumn("question", F.floor(F.col("query_id") / 60)), "question", "vec_id"), 10, "question", "vec_id", "rrf")


def hybrid_hits(spark, sf, k: int = 10):
    """Each benchmark text against all documents: BM25 and, where a document has one, its vector."""
    bench, docs, vectors = table(spark, sf, "benchmark"), table(spark, sf, "documents"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = bench.join(vectors.withColumnRenamed("doc_id", "item_id"), "item_id").select("item_id", F.col("embedding").alias("query_embedding"))
    return R.hybrid(R.bm25(bench, docs, k=2 * k), R.vector_scores(asked, vectors, "item_id", k=2 * k), "item_id", "doc_id", k)


@query("top03_hybrid", f"""
    WITH {bm25_sql('tf')},
    v AS (SELECT b.item_id, v.vec_id AS doc_id, {COSINE_SQL} AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v),
    r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 20
          UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM v QUALIFY rank <= 20),
    f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM r GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def top03_hybrid(spark, sf):
    return hybrid_hits(spark, sf)


@query("jon13_hydrated_hits", f"""
    WITH {bm25_sql('tf')}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 3)
    SELECT item_id, doc_id, rank, score, lang, source, text AS content FROM r JOIN documents USING (doc_id)""")
def jon13_hydrated_hits(spark, sf):
    docs = table(spark, sf, "documents")
    hits = R.top_k(R.bm25(table(spark, sf, "benchmark"), docs, k=3), 3, "item_id", "doc_id")
    return hits.join(docs, "doc_id").select("item_id", "doc_id", "rank", "score", "lang", "source", F.col("text").alias("content"))


@query("agg09_hits_by_document", f"""
    WITH {bm25_sql('tf')}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 5)
    SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS matches FROM r GROUP BY doc_id""")
def agg09_hits_by_document(spark, sf):
    hits = R.top_k(R.bm25(table(spark, sf, "benchmark"), table(spark, sf, "documents"), k=5), 5, "item_id", "doc_id")
    return R.by_document(hits, "doc_id", "item_id").select("doc_id", F.array_join(F.col("matches").cast("array<string>"), ",").alias("matches"))


@query("top05_rerank", f"""
    WITH {bm25_sql('tf')}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 10),
    s AS (SELECT item_id, doc_id, round(1000.0 / (1 + length(text)), 6) AS score FROM r JOIN documents USING (doc_id))
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 4""")
def top05_rerank(spark, sf):
    docs = table(spark, sf, "documents")
    hits = R.top_k(R.bm25(table(spark, sf, "benchmark"), docs, k=10), 10, "item_id", "doc_id").select("item_id", "doc_id", "rank").join(docs.select("doc_id", "text"), "doc_id")
    return R.rerank(hits, 1000.0 / (1 + F.length("text")), 4, "item_id", "doc_id").drop("text")


@query("jon01_context_window", """
    SELECT m.conv_id, m.turn AS match_turn, c.turn, c.turn - m.turn AS position_offset FROM conversations m JOIN conversations c ON c.conv_id = m.conv_id AND c.turn BETWEEN greatest(m.turn - 2, 0) AND m.turn + 1 WHERE m.role = 'assistant'""")
def jon01_context_window(spark, sf):
    rows = table(spark, sf, "conversations")
    out = R.context_windows(rows.where("role = 'assistant'").select("conv_id", "turn"), rows, "conv_id", "turn", 2, 1)
    return out.select("conv_id", F.col("match_position").alias("match_turn"), "turn", "position_offset")


@query("jon02_page_windows", """
    WITH p AS (SELECT conv_id, turn, [turn // 2, turn // 2 + 1] AS pages FROM conversations)
    SELECT DISTINCT m.conv_id, m.turn AS match_turn, c.turn FROM p m JOIN p c USING (conv_id) WHERE len(list_filter(c.pages, lambda x: x BETWEEN greatest(m.pages[1] - 1, 0) AND m.pages[1])) > 0""")
def jon02_page_windows(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.array(F.floor(F.col("turn") / 2), F.floor(F.col("turn") / 2) + 1).alias("pages"))
    hits = rows.select("conv_id", F.col("turn").alias("match_turn"), "pages")
    return R.page_windows(hits, rows, "conv_id", "pages", 1, 0).select("conv_id", "match_turn", "turn")


@query("win09_guided_windows", """
    WITH c AS (SELECT conv_id, turn, embedding FROM conversations JOIN embeddings ON vec_id = (conv_id * 8 + turn) % (SELECT count(*) FROM embeddings)),
    m AS (SELECT c.conv_id, c.turn AS p, g.embedding AS guide FROM c, (SELECT embedding FROM embeddings WHERE vec_id = 3) g),
    r AS (SELECT m.conv_id, m.p, c.turn, list_cosine_similarity(guide::DOUBLE[], c.embedding::DOUBLE[]) AS s, ceil(greatest(m.p - c.turn - 1, c.turn - m.p - 1, 0) / 2.0)::INT AS step FROM m JOIN c ON c.conv_id = m.conv_id AND c.turn BETWEEN greatest(m.p - 7, 0) AND m.p + 7),
    k AS (SELECT *, coalesce(min(step) FILTER (s >= 0.1) OVER (PARTITION BY conv_id, p), 3) AS chosen FROM r)
    SELECT conv_id, p AS match_turn, turn, turn - p AS position_offset, round(s, 6) AS semantic_score, chosen > 0 AS from_expansion FROM k WHERE step <= chosen""")
def win09_guided_windows(spark, sf):
    vectors = table(spark, sf, "embeddings")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 8 + F.col("turn")) % vectors.count()).alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id")
    guide = vectors.where("vec_id = 3").select(F.col("embedding").alias("guide"))
    hits = rows.select("conv_id", "turn").join(F.broadcast(guide))  # one row
    out = R.guided_windows(hits, rows, "conv_id", "turn", "guide", "embedding", 1, 1, min_score=0.1)
    return out.select("conv_id", F.col("match_position").alias("match_turn"), "turn", "position_offset", F.round("semantic_score", 6).alias("semantic_score"), "from_expansion")


@query("fn01_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn01_cosine(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e")), "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("sim"))


@query("win08_round_numbers", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round_number, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def win08_round_numbers(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("round_number"), F.lag("turn").over(w).alias("previous"))
