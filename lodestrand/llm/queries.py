"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .best_fit import pack_documents
from .chat_format import as_chain, digest, format_conversations
from .common import ascii_lower
from .cube_mix import mix
from .decontaminate import leaks
from .exact_dedup import exact_groups
from .kneser_ney import judge_quality
from .langid import identify
from .merkle import FIELDS, digest as sha256, fold, leaf, manifest, siblings
from .paragraph_dedup import repeated_paragraphs
from .simhash_vptree import near_groups
from .token_counts import count_tokens
from .tokenizer_alignment import align
from .url_rules import SEGMENTS, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("rid")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents")).drop("rid")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: A conversation whose texts hold control strings, formatted along with the table.
CONTROL_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = [x.withColumn("conv_id", F.struct("conv_id", F.lit(mark).alias("control"))) for x, mark in ((rows, False), (spark.createDataFrame(CONTROL_CONVERSATION, rows.schema), True))]
    # a conversation of the table that has the number -1 itself stays apart
    return digest(format_conversations(as_chain(both[0].union(both[1])))).withColumn("conv_id", F.col("conv_id.conv_id"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(_table(spark, sf_dir, "documents")).drop("rid")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(lowered))
    rows, root = manifest(_table(spark, sf_dir, "documents"), keep={"tampered": tampered})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), sha256(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_url_filters": op2_url_filters,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_chat_format": op8_chat_format,
    "op9_token_counts": op9_token_counts,
    "op10_paragraph_dedup": op10_paragraph_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The template's escape, for DuckDB.
_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|im_(?:start|end)\|>)', '\1\\\2\3', 'g')"

#: A row's leaf and a digest's CRC-32, for DuckDB.
_FIELD = "coalesce(strlen(({0})::VARCHAR)::VARCHAR || ':' || ({0})::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_BYTE = "xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)) ELSE 0 END)"
_CRC = f"xor(list_reduce(range(0, 8 * length(doc_id::VARCHAR)), lambda c, k: CASE WHEN {_BYTE} % 2 = 1 THEN xor({_BYTE} >> 1, 3988292384) ELSE {_BYTE} >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)"

ORACLE: dict[str, str] = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_LEAF.format(text="text")} AS leaf,
                                    CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents),
             l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
             t(g, level, pos, h) AS (
                 SELECT g, 0::BIGINT, pos, leaf FROM l
                 UNION ALL
                 SELECT g, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM t) WHERE n > 1 GROUP BY g, level, pos // 8),
             s AS (SELECT g, arg_max(h, level) AS subroot, max(level) AS height FROM t GROUP BY g),
             r AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS pos FROM s),
             u(level, pos, h) AS (
                 SELECT 0::BIGINT, pos, subroot FROM r
                 UNION ALL
                 SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY level, pos // 8),
             sides AS (
                 SELECT l.g, l.pos, t.level, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (8 ** t.level)::BIGINT) AS lefts, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (8 ** t.level)::BIGINT) AS rights
                 FROM l JOIN s USING (g) JOIN t ON t.g = l.g AND t.level < s.height AND t.pos // 8 = l.pos // (8 ** (t.level + 1))::BIGINT GROUP BY l.g, l.pos, t.level
                 UNION ALL
                 SELECT l.g, l.pos, s.height + u.level, string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < r.pos // (8 ** u.level)::BIGINT), string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > r.pos // (8 ** u.level)::BIGINT)
                 FROM l JOIN s USING (g) JOIN r USING (g) JOIN u ON u.level < (SELECT max(level) FROM u) AND u.pos // 8 = r.pos // (8 ** (u.level + 1))::BIGINT GROUP BY l.g, l.pos, s.height, u.level),
             p AS (SELECT g, pos, list(struct_pack(a := coalesce(lefts, ''), b := coalesce(rights, '')) ORDER BY level) AS path FROM sides GROUP BY g, pos),
             f AS (SELECT l.doc_id, l.leaf, s.subroot, (SELECT arg_max(h, level) FROM u) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '')) AS proof_sha256,
                          list_reduce(coalesce(path, []), lambda node, x: struct_pack(a := sha256(x.a || node.a || x.b), b := ''), struct_pack(a := coalesce(l.tampered, l.leaf), b := '')).a AS folded_root
                   FROM l JOIN s USING (g) LEFT JOIN p ON p.g = l.g AND p.pos = l.pos)
        SELECT *, folded_root = root AS verified FROM f""",
    "op2_url_filters": f"""
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
             r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
             m AS (SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
                   FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL),
             s AS (SELECT *, (SELECT max_by('*/' || seg || '/*', (length(seg), seg)) FROM (VALUES {', '.join(f"('{x}')" for x in SEGMENTS)}) v(seg) WHERE contains(path || '/', '/' || seg || '/')) AS pat FROM m)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN pat IS NULL THEN 'allow' ELSE 'block' END) AS verdict, coalesce(rule, pat) AS pattern FROM s""",
    "op8_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS control FROM conversations
                   UNION ALL SELECT *, true FROM (VALUES {', '.join(str(x) for x in CONTROL_CONVERSATION)}))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(24 + length(role) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id, control""",
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_ASCII_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}
