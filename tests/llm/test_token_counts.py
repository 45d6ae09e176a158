"""Attribution against spans found by decoding token by token."""

import pytest
from pyspark.sql import functions as F

from lodestrand.llm.token_counts import SECTIONS, VOCABULARY, Encoder, count_tokens

TEXTS = ["Title line\nThe body, with ünïcödé and 日本語.", "no newline", "\nstarts empty", "", None, "a\n\n\nb", "x" * 200_000 + "\n" + "word " * 20_000, "emoji 👩‍👩‍👧 split\nhere", "<|endoftext|>\n</s>"]


def encoder():
    with open(VOCABULARY, "rb") as f:
        return Encoder(f.read())


def plain(enc, text, parts, rule):
    """Counts and crossings by walking over the tokens' bytes."""
    text = text or ""
    ids = enc.encoding.encode(text, disallowed_special=())
    pieces = [enc.encoding.decode_single_token_bytes(i) for i in ids]
    assert b"".join(pieces) == text.encode()
    spans = [(len(text[:a].encode()), len(text[:b].encode())) for _, a, b in parts]
    counts, crossing, at = [0] * len(parts), [0] * len(parts), 0
    for p in pieces:
        held = [max(0, min(at + len(p), b) - max(at, a)) for a, b in spans]
        mine = next((k for k, (a, b) in enumerate(spans) if a <= at < b), None) if rule == "start" else (held.index(max(held)) if held and max(held) else None)
        if mine is not None:
            counts[mine] += 1
            crossing[mine] += not (spans[mine][0] <= at and at + len(p) <= spans[mine][1])
        at += len(p)
    return counts, crossing, len(pieces)


@pytest.mark.parametrize("rule", ["start", "most"])
def test_given_sections(spark, rule):
    enc = encoder()
    rows = [(i, t, [("a", 2, 5), ("b", 5, 11), ("a", 14, 999_999)], "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, parts {SECTIONS}, section string")
    got = {}
    for r in count_tokens(docs, F.col("parts"), rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.n_crossing, r.doc_tokens))
    for i, t, parts, _ in rows:
        counts, crossing, total = plain(enc, t, parts, rule)
        assert got[i] == [(a, b, total) for a, b in zip(counts, crossing)]


def test_head_and_body_cover_the_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = count_tokens(docs).collect()
    for i in range(len(TEXTS)):
        mine = [r for r in rows if r.doc_id == i]
        assert [r.section for r in mine] == ["head", "body"] and sum(r.n_tokens for r in mine) == mine[0].doc_tokens


def test_null_sections_unknown_rule_and_empty(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert count_tokens(docs, F.lit(None).cast(SECTIONS)).count() == 0 and count_tokens(docs.where("doc_id > 1")).count() == 0
    with pytest.raises(ValueError):
        count_tokens(docs, rule="end")
