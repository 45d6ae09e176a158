"""Queries over documents: scalars, chunkers, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import chunk as C, spans as S, stores as K, validate as V
from .registered import query, table

# DuckDB forms of the shared scalars
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
LINES = "replace(text, chr(10), chr(10) || chr(10))"
# every fourth line becomes a heading, of levels 1, 2, 3 in turn
HEADED_SQL = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 0 THEN repeat('#', 1 + ((i - 1) // 4) % 3) || ' ' || x ELSE x END), chr(10) || chr(10))"


def headed(docs):
    mark = lambda x, i: F.when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), 1 + F.floor(i / 4).cast("int") % 3), F.lit(" "), x)).otherwise(x)
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n\n").alias("text"))


@query("fn_text_scalars", r"""
    SELECT doc_id, length(text) AS n_chars,
           CASE WHEN trim(text, E' \n\t\r') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END AS n_words,
           length(text) // 4 AS n_tokens_est, sha256(text) AS content_hash,
           length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n_alnum,
           len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n_tokens,
           CASE WHEN length(text) > 80 THEN text[1:80] || chr(10) || chr(10) || '[... truncated ...]' ELSE text END AS clipped
    FROM documents""")
def fn_text_scalars(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(t).alias("n_chars"), T.word_count(t).alias("n_words"), T.token_estimate(t).alias("n_tokens_est"), F.sha2(t, 256).alias("content_hash"), T.alnum_count(t).alias("n_alnum"), F.size(T.tokens(t)).alias("n_tokens"), T.clipped(t, 80).alias("clipped"))


@query("fn06_query_slugs", r"""
    WITH s AS (SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', '_', 'g'), '[^\p{L}\p{N}_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')[1:120] AS x FROM benchmark)
    SELECT item_id, CASE WHEN x = '' THEN 'query' ELSE x END AS slug FROM s""")
def fn06_query_slugs(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.query_slug(F.col("text")).alias("slug"))


@query("fn26_metric_keys", "SELECT event_id, event_type || '{k=' || json_extract_string(props, '$.k') || ',user=' || (user_id % 3)::VARCHAR || '}' AS key FROM events")
def fn26_metric_keys(spark, sf):
    labels = F.create_map(F.lit("user"), (F.col("user_id") % 3).cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", T.metric_key(F.col("event_type"), labels).alias("key"))


@query("fn16_previews", "SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS preview FROM documents")
def fn16_previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("..."))).otherwise(F.col("text")).alias("preview"))


@query("fn12_listed_queries", r"""
    WITH l AS (SELECT item_id, list_filter(list_transform(string_split(text, '. '), lambda x, i: i::VARCHAR || '. ' || x), lambda x: x <> '') AS parts FROM benchmark)
    SELECT item_id, array_to_string(list_filter(list_transform(string_split(array_to_string(parts, chr(10)), chr(10)),
           lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^\d+[.)]\s*', ''), '^[-*•>] ', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:3], '|') AS queries FROM l""")
def fn12_listed_queries(spark, sf):
    answer = F.array_join(F.transform(F.split("text", r"\. "), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.listed_queries(answer, 3), "|").alias("queries"))


@query("chk01_sentences", f"SELECT doc_id, i - 1 AS sent_idx, s[i] AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), unnest(range(1, len(s) + 1)) u(i)")
def chk01_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))


@query("chk02_paragraphs", rf"""SELECT doc_id, i - 1 AS para_idx, s[i] AS paragraph FROM (SELECT doc_id, list_filter(list_transform(string_split({LINES}, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents), unnest(range(1, len(s) + 1)) u(i)""")
def chk02_paragraphs(spark, sf):
    lines = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.paragraphs(lines)).alias("para_idx", "paragraph"))


SECTIONS_SQL = rf"""
    d AS (SELECT doc_id, {HEADED_SQL} AS text FROM documents),
    l AS (SELECT doc_id, i, x, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1 AS pos, length(text) AS n
          FROM (SELECT doc_id, text, i, ls[i] AS x FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d), unnest(range(1, len(ls) + 1)) u(i))),
    g AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^#{{1,6}}\s+[^\n]+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l),
    s AS (SELECT doc_id, sec - 1 AS section_index, min(pos)::BIGINT AS start_char, any_value(n) AS n, first(x ORDER BY i) AS head,
                 regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE i > first_i), ''), '^\s+|\s+$', '', 'g') AS content
          FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, sec) AS first_i FROM g WHERE sec > 0) GROUP BY doc_id, sec),
    sections AS (SELECT doc_id, section_index, regexp_replace(regexp_extract(head, '^#+\s+(.*)$', 1), '^\s+|\s+$', '', 'g') AS title, length(regexp_extract(head, '^(#+)', 1)) AS level,
                        start_char, lead(start_char, 1, n) OVER (PARTITION BY doc_id ORDER BY section_index) AS end_char, content FROM s)"""


@query("chk03_sections", f"WITH {SECTIONS_SQL} SELECT * FROM sections")
def chk03_sections(spark, sf):
    return C.sections(headed(table(spark, sf, "documents")))


@query("chk05_hierarchy", f"""WITH {SECTIONS_SQL},
    p AS (SELECT *, max(CASE WHEN level = 1 THEN section_index END) OVER w AS l1, max(CASE WHEN level = 2 THEN section_index END) OVER w AS l2
          FROM sections WINDOW w AS (PARTITION BY doc_id ORDER BY section_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    q AS (SELECT doc_id, section_index AS chunk_index, title, level, CASE level WHEN 3 THEN coalesce(l2, l1) WHEN 2 THEN l1 END AS parent_index, content FROM p)
    SELECT q.*, (SELECT count(*) FROM q c WHERE c.doc_id = q.doc_id AND c.parent_index = q.chunk_index) AS n_children FROM q""")
def chk05_hierarchy(spark, sf):
    return C.hierarchical_chunks(headed(table(spark, sf, "documents")), most=10_000_000).drop("start_char", "end_char")


@query("chk04_large_sections", f"""WITH RECURSIVE {SECTIONS_SQL},
    p AS (SELECT doc_id, section_index, i, ps[i] AS x, length(ps[i]) AS n, len(ps) AS total
          FROM (SELECT *, CASE WHEN length(content) > 400 THEN string_split(content, chr(10) || chr(10)) ELSE [content] END AS ps FROM sections), unnest(range(1, len(ps) + 1)) u(i)),
    f AS (SELECT doc_id, section_index, i, total, x AS buf, n AS blen, []::VARCHAR[] AS done FROM p WHERE i = 1 UNION ALL
          SELECT p.doc_id, p.section_index, p.i, p.total, CASE WHEN f.blen + p.n > 400 THEN p.x ELSE f.buf || chr(10) || chr(10) || p.x END, CASE WHEN f.blen + p.n > 400 THEN p.n ELSE f.blen + p.n END,
                 CASE WHEN f.blen + p.n > 400 THEN list_append(f.done, f.buf) ELSE f.done END FROM f JOIN p ON p.doc_id = f.doc_id AND p.section_index = f.section_index AND p.i = f.i + 1),
    c AS (SELECT doc_id, section_index, k, parts[k] AS content, len(parts) AS np FROM (SELECT doc_id, section_index, list_append(done, buf) AS parts FROM f WHERE i = total), unnest(range(1, len(parts) + 1)) u(k)),
    n AS (SELECT doc_id, section_index, (row_number() OVER (PARTITION BY doc_id ORDER BY section_index, k) - 1)::INT AS chunk_index, title || CASE WHEN np > 1 THEN ' (part ' || k || ')' ELSE '' END AS title, level, c.content, start_char, end_char
          FROM c JOIN sections USING (doc_id, section_index)),
    q AS (SELECT *, max(CASE WHEN level = 1 THEN chunk_index END) OVER w AS l1, max(CASE WHEN level = 2 THEN chunk_index END) OVER w AS l2
          FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY section_index RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT doc_id, chunk_index, title, level, CASE level WHEN 3 THEN coalesce(l2, l1) WHEN 2 THEN l1 END AS parent_index, content, start_char, end_char FROM q)
    SELECT r.*, (SELECT count(*) FROM r c WHERE c.doc_id = r.doc_id AND c.parent_index = r.chunk_index) AS n_children FROM r""")
def chk04_large_sections(spark, sf):
    return C.hierarchical_chunks(headed(table(spark, sf, "documents")), most=400)


def packing_sql(most: int, least: int) -> str:
    """The greedy sentence packer as a recursive query over sentences."""
    return f"""
    WITH RECURSIVE s AS (SELECT doc_id, i, ss[i] AS x, length(ss[i]) AS n, len(ss) AS total FROM (SELECT doc_id, {SENTENCES} AS ss FROM documents), unnest(range(1, len(ss) + 1)) u(i)),
    f AS (SELECT doc_id, i, total, CASE WHEN n > {most} THEN NULL ELSE x END AS buf, CASE WHEN n > {most} THEN 0 ELSE n END AS blen,
                 CASE WHEN n > {most} THEN list_transform(range(0, n, {most}), lambda k: substr(x, (k + 1)::BIGINT, {most})) ELSE []::VARCHAR[] END AS done FROM s WHERE i = 1
          UNION ALL
          SELECT s.doc_id, s.i, s.total,
                 CASE WHEN f.buf IS NOT NULL AND f.blen + s.n > {most} THEN s.x WHEN f.buf IS NULL AND s.n > {most} THEN NULL ELSE coalesce(f.buf || ' ', '') || s.x END,
                 CASE WHEN f.buf IS NOT NULL AND f.blen + s.n > {most} THEN s.n WHEN f.buf IS NULL AND s.n > {most} THEN 0 ELSE f.blen + s.n END,
                 CASE WHEN f.buf IS NOT NULL AND f.blen + s.n > {most} THEN list_append(f.done, f.buf)
                      WHEN f.buf IS NULL AND s.n > {most} THEN list_concat(f.done, list_transform(range(0, s.n, {most}), lambda k: substr(s.x, (k + 1)::BIGINT, {most}))) ELSE f.done END
          FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
    c AS (SELECT doc_id, CASE WHEN buf IS NULL THEN done WHEN length(buf) >= {least} OR len(done) = 0 THEN list_append(done, buf)
                              ELSE list_append(done[1:len(done) - 1], done[len(done)] || ' ' || buf) END AS chunks FROM f WHERE i = total)"""


@query("chk06_sentence_chunks", packing_sql(1000, 100) + " SELECT doc_id, k - 1 AS chunk_index, chunks[k] AS content FROM c, unnest(range(1, len(chunks) + 1)) u(k)")
def chk06_sentence_chunks(spark, sf):
    return C.sentence_chunks(table(spark, sf, "documents"))


SLICES_SQL = "list_transform(range(0, s.n, 600), lambda k: substr(s.x, (k + 1)::BIGINT, 600))"
KEPT_SQL = "list_filter(f.buf, lambda v, i: list_sum(list_transform(f.buf[i:], lambda z: length(z))) <= 150)"


@query("chk07_sliding_sentences", f"""
    WITH RECURSIVE s AS (SELECT doc_id, i, ss[i] AS x, length(ss[i]) AS n, len(ss) AS total FROM (SELECT doc_id, {SENTENCES} AS ss FROM documents), unnest(range(1, len(ss) + 1)) u(i)),
    f AS (SELECT doc_id, i, total, CASE WHEN n > 600 THEN []::VARCHAR[] ELSE [x] END AS buf, CASE WHEN n > 600 THEN {SLICES_SQL} ELSE []::VARCHAR[] END AS done FROM s WHERE i = 1 UNION ALL
          SELECT doc_id, i, total, CASE WHEN n > 600 AND len(kept) = 0 THEN kept ELSE list_append(kept, x) END, CASE WHEN n > 600 AND len(kept) = 0 THEN list_concat(out, slices) ELSE out END
          FROM (SELECT s.doc_id, s.i, s.total, s.x, s.n, {SLICES_SQL} AS slices, CASE WHEN flush THEN {KEPT_SQL} ELSE f.buf END AS kept, CASE WHEN flush THEN list_append(f.done, array_to_string(f.buf, ' ')) ELSE f.done END AS out
                FROM (SELECT f.*, list_sum(list_transform(f.buf, lambda z: length(z))) AS blen FROM f) f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1, LATERAL (SELECT len(f.buf) > 0 AND f.blen + s.n > 600 AS flush))),
    c AS (SELECT doc_id, CASE WHEN len(buf) > 0 THEN list_append(done, array_to_string(buf, ' ')) ELSE done END AS chunks FROM f WHERE i = total),
    r AS (SELECT doc_id, k - 1 AS chunk_index, chunks[k] AS content FROM c, unnest(range(1, len(chunks) + 1)) u(k)),
    o AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - chunk_index * 150 AS start FROM r)
    SELECT doc_id, chunk_index, content, start::BIGINT AS start_char, (start + length(content))::BIGINT AS end_char FROM o""")
def chk07_sliding_sentences(spark, sf):
    return C.sliding_chunks(table(spark, sf, "documents"), most=600, overlap=150)


@query("chk08_fixed_windows", """
    SELECT doc_id, k AS chunk_index, text[k * 800 + 1 : k * 800 + 1000] AS content, (k * 800)::BIGINT AS start_char, least(k * 800 + 1000, length(text))::BIGINT AS end_char
    FROM documents, unnest(range(0, greatest(ceil((length(text) - 1000) / 800.0)::INT, 0) + 1)) u(k) WHERE regexp_matches(text, '\\S')""")
def chk08_fixed_windows(spark, sf):
    return C.sliding_chunks(table(spark, sf, "documents"), boundaries=False)


@query("chk10_semantic_chunks")
def chk10_semantic_chunks(spark, sf):
    vectors = table(spark, sf, "embeddings")
    rows = table(spark, sf, "conversations").withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % vectors.count()).join(vectors.select("vec_id", "embedding"), "vec_id")
    sims = V.adjacent_similarity(rows, ["conv_id"], "turn").select("conv_id", "turn", "text", "prev_sim")
    return C.semantic_chunks(sims, "conv_id", "turn", "text", threshold=0.0, most=2000, least=50)


@query("chk11_text_windows", """
    SELECT doc_id, k * 800 AS start, text[k * 800 + 1 : k * 800 + 1000] AS content FROM documents, unnest(range(0, greatest(ceil((length(text) - 1000) / 800.0)::INT, 0) + 1)) u(k)
    WHERE regexp_matches(text[k * 800 + 1 : k * 800 + 1000], '\\S')""")
def chk11_text_windows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.inline(C.text_windows(F.col("text"), 1000)))


@query("chk12_embedding_batches", """
    WITH RECURSIVE s AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, doc_id, length(text) // 4 AS t FROM documents),
    f AS (SELECT source, i, doc_id, t AS tokens, 1 AS n, 0 AS batch FROM s WHERE i = 1 UNION ALL
          SELECT s.source, s.i, s.doc_id, CASE WHEN f.tokens + s.t > 3000 OR f.n >= 8 THEN s.t ELSE f.tokens + s.t END, CASE WHEN f.tokens + s.t > 3000 OR f.n >= 8 THEN 1 ELSE f.n + 1 END,
                 f.batch + CASE WHEN f.tokens + s.t > 3000 OR f.n >= 8 THEN 1 ELSE 0 END FROM f JOIN s ON s.source = f.source AND s.i = f.i + 1)
    SELECT source, doc_id, batch FROM f""")
def chk12_embedding_batches(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return K.embedding_batches(rows, "source", "doc_id", "tokens", 3000, 8).drop("tokens")


@query("chk13_page_summaries", r"""
    WITH h AS (SELECT *, list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS hs FROM documents)
    SELECT doc_id, regexp_replace(text[1:500], '^\s+|\s+$', '', 'g') || CASE WHEN length(text) > 500 THEN '...' ELSE '' END AS summary,
           CASE WHEN len(hs) > 0 THEN array_to_string(hs, ' | ') ELSE text[1:200] END AS headings FROM h""")
def chk13_page_summaries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.page_summary(F.col("text")).alias("summary"), T.page_headings(F.col("text")).alias("headings"))


@query("chk14_strategies", """
    SELECT item_id, CASE WHEN contains(lower(text), 'hierarchical') OR item_id % 5 = 0 THEN 'hierarchical' WHEN contains(lower(text), 'the') THEN 'semantic' WHEN contains(lower(text), 'de') THEN 'sentence' ELSE 'sliding_window' END AS strategy
    FROM benchmark""")
def chk14_strategies(spark, sf):
    answer = F.when(F.lower("text").contains("hierarchical"), "hierarchical").when(F.lower("text").contains("the"), "use semantic").when(F.lower("text").contains("de"), "Sentence please").otherwise("sliding_window")
    name = F.when(F.col("item_id") % 5 == 0, "notes.MD").otherwise("notes.txt")
    return table(spark, sf, "benchmark").select("item_id", C.strategy_of(name, answer).alias("strategy"))


QUALITY_SQL = r"""
    q AS (SELECT doc_id, text, length(text)::DOUBLE AS n, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents),
    r AS (SELECT *, CASE WHEN n < 50 THEN n / 50 * 0.5 WHEN n > 5000 THEN greatest(0.0, 1 - (n - 5000) / 5000) ELSE greatest(0.5, 1 - abs(n - 1000) / 1000 * 0.5) END AS length_score,
                 CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / n / 0.75) END AS density,
                 regexp_matches(b, '^\p{Ll}') AS i1, b <> '' AND NOT regexp_matches(b, '[.!?"'']$') AS i2, len(regexp_extract_all(b, '"')) % 2 <> 0 AS i3,
                 len(regexp_extract_all(b, '\(')) AS o, len(regexp_extract_all(b, '\)')) AS c FROM q),
    quality AS (SELECT *, NOT (i1 OR i2 OR i3 OR o <> c) AS complete, length_score * 0.3 + density * 0.4 + CASE WHEN NOT (i1 OR i2 OR i3 OR o <> c) THEN 1.0 ELSE 0.5 END * 0.3 AS quality FROM r)"""


@query("flt04_quality", rf"""WITH {QUALITY_SQL}
    SELECT doc_id, round(length_score, 6) AS length_score, round(density, 6) AS density, complete, round(quality, 6) AS quality, quality >= 0.3 AND density >= 0.2 AS passed,
           array_to_string(list_filter([CASE WHEN length_score < 0.7 AND n < 50 THEN 'Chunk too short (' || n::INT || ' < 50)' END, CASE WHEN length_score < 0.7 AND n >= 50 THEN 'Chunk too long (' || n::INT || ' > 5000)' END,
           CASE WHEN density < 0.2 THEN 'Low information density (' || format('{{:.2f}}', density) || ')' END, CASE WHEN i1 THEN 'Starts with lowercase letter (incomplete sentence)' END,
           CASE WHEN i2 THEN 'Does not end with proper punctuation' END, CASE WHEN i3 THEN 'Unbalanced double quotes' END, CASE WHEN o <> c THEN 'Unbalanced parentheses (' || o || ' open, ' || c || ' close)' END], lambda x: x IS NOT NULL), '; ') AS issues FROM quality""")
def flt04_quality(spark, sf):
    out = V.with_quality(table(spark, sf, "documents"), "text")
    return out.select("doc_id", F.round("length_score", 6).alias("length_score"), F.round("density", 6).alias("density"), "complete", F.round("quality", 6).alias("quality"), "passed", F.array_join("issues", "; ").alias("issues"))


@query("flt05_validated_chunks", f"""WITH {QUALITY_SQL}, v AS (SELECT doc_id, quality >= 0.5 AND density >= 0.2 AS good, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS dup FROM quality)
    SELECT doc_id, good AND NOT dup AS passed, dup AS is_duplicate FROM v""")
def flt05_validated_chunks(spark, sf):
    docs = table(spark, sf, "documents").withColumn("chunk_index", F.lit(0))
    out = V.exact_duplicates(V.with_quality(docs, "text", min_score=0.5), "text")
    return out.select("doc_id", (F.col("passed") & ~F.col("is_duplicate")).alias("passed"), "is_duplicate")


@query("agg06_validation_counts", f"""WITH {QUALITY_SQL}, v AS (SELECT quality >= 0.5 AND density >= 0.2 AS good, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS dup FROM quality)
    SELECT count(*) FILTER (good) AS n_passed, count(*) FILTER (NOT good) AS n_failed, count(*) FILTER (dup) AS n_duplicates FROM v""")
def agg06_validation_counts(spark, sf):
    docs = table(spark, sf, "documents").withColumn("chunk_index", F.lit(0))
    return V.validation_counts(V.exact_duplicates(V.with_quality(docs, "text", min_score=0.5), "text"))


@query("jon04_exact_duplicates", "SELECT doc_id, sha256(text) AS content_hash, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def jon04_exact_duplicates(spark, sf):
    docs = table(spark, sf, "documents").withColumn("chunk_index", F.lit(0))
    return V.exact_duplicates(docs, "text").select("doc_id", "content_hash", "is_duplicate")


@query("jon05_similar_pairs", """
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def jon05_similar_pairs(spark, sf):
    return V.similar_pairs(table(spark, sf, "embeddings"), 0.4, method="exact", copies=True).withColumn("sim", F.round("sim", 6))


@query("jon05_greedy_near_duplicates")
def jon05_greedy_near_duplicates(spark, sf):
    return V.near_duplicates(table(spark, sf, "embeddings"), 0.4, missed=1e-4)


#: Each vector thrice: as it is, and twice drawn aside by a part of its own mirror image (cosines of about 0.96 and 0.91).
PLANTED = """planted AS (SELECT vec_id * 10 + k AS vec_id, list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), lambda p: p[1] + c * p[2]) AS v
        FROM embeddings, (VALUES (0, 0.0::DOUBLE), (1, 0.3::DOUBLE), (2, 0.45::DOUBLE)) u(k, c))"""
PLANTED_PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM planted a JOIN planted b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9"


def planted(spark, sf) -> DataFrame:
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate((0.0, 0.3, 0.45))]))
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), parts.alias("p"))
    return rows.select((F.col("vec_id") * 10 + F.col("p.k")).alias("vec_id"), F.zip_with("v", F.reverse("v"), lambda x, y: x + F.col("p.c") * y).alias("embedding"))


@query("jon05_planted_pairs", f"WITH {PLANTED} {PLANTED_PAIRS}")
def jon05_planted_pairs(spark, sf):
    return V.similar_pairs(planted(spark, sf), 0.9, method="exact", copies=True).withColumn("sim", F.round("sim", 6))


@query("jon05_exact_pairs", f"WITH {PLANTED} {PLANTED_PAIRS}")
def jon05_exact_pairs(spark, sf):
    return V.similar_pairs(planted(spark, sf), 0.9, method="exact", copies=True).withColumn("sim", F.round("sim", 6))


GREEDY = f"""
    WITH RECURSIVE {PLANTED}, pairs AS MATERIALIZED ({PLANTED_PAIRS}),
    s AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, coalesce(near, []) AS near FROM planted LEFT JOIN (SELECT b, list(a) AS near FROM pairs GROUP BY b) n ON n.b = vec_id),
    f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS vec_id, []::BIGINT[] AS kept, NULL::BIGINT AS duplicate_of UNION ALL
          SELECT s.i, s.vec_id, CASE WHEN len(list_intersect(s.near, f.kept)) = 0 THEN list_append(f.kept, s.vec_id) ELSE f.kept END, list_min(list_intersect(s.near, f.kept)) FROM f JOIN s ON s.i = f.i + 1)
    SELECT vec_id, duplicate_of IS NULL AS kept, duplicate_of FROM f WHERE i > 0"""


@query("jon05_planted_near_duplicates", GREEDY)
def jon05_planted_near_duplicates(spark, sf):
    return V.near_duplicates(planted(spark, sf), 0.9, missed=1e-6)


@query("jon12_adjacent_similarity", """
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]), 6) AS prev_sim FROM embeddings""")
def jon12_adjacent_similarity(spark, sf):
    return V.adjacent_similarity(table(spark, sf, "embeddings"), ["label"], "vec_id").select("vec_id", F.round("prev_sim", 6).alias("prev_sim"))


@query("jon03_span_overlap", """
    WITH c AS (SELECT doc_id, k AS chunk_index, k * 800 AS a, least(k * 800 + 1000, length(text)) AS b FROM documents, unnest(range(0, greatest(ceil((length(text) - 1000) / 800.0)::INT, 0) + 1)) u(k) WHERE regexp_matches(text, '\\S')),
         s AS (SELECT doc_id, k AS span_id, k * 613 AS s, k * 613 + 90 AS e FROM documents, unnest(range(0, 6)) u(k))
    SELECT c.doc_id, c.chunk_index, coalesce(string_agg(s.span_id::VARCHAR, ',' ORDER BY s.span_id), '') AS span_ids FROM c LEFT JOIN s ON s.doc_id = c.doc_id AND NOT (s.e <= c.a OR s.s >= c.b) GROUP BY 1, 2""")
def jon03_span_overlap(spark, sf):
    docs = table(spark, sf, "documents")
    spans = docs.select("doc_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(6)])).alias("span_id")).withColumn("s", F.col("span_id") * 613).withColumn("e", F.col("s") + 90)
    return S.overlapping(C.sliding_chunks(docs, boundaries=False), spans, "doc_id").select("doc_id", "chunk_index", F.array_join(F.col("span_ids").cast("array<string>"), ",").alias("span_ids"))
