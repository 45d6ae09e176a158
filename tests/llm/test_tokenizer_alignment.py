"""Groups, links and counts against a walk over the tokens, byte by byte, with the tokenizers' own libraries."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestrand.llm.encoders import BYTE_BPE, PIECE_BPE, byte_letters
from lodestrand.llm.tokenizer_alignment import align, aligned_groups

TEXTS = [
    "Plain words, and the number 12345 in them.", "Zażółć gęślą jaźń 日本語 👩‍👩‍👧 done", "", None, " ", "  two  spaces \n\n and\ttabs ", "a", "</s> <s> <unk> <|endoftext|> <0x41>",
    "a▁b holds the mark of a space", "nul \x00 and \x01 control", "x" * 30_000, "word " * 30_000, "Plain words, and the number 12345 in them.", "́combining", "Ünïcödé\r\nlines\x85and  odd spaces",
]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(BYTE_BPE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def plain_groups(text, libraries):
    """[(ids of A, ids of B)], or nothing if the bytes don't come back."""
    first, second = libraries
    if not text:
        return []
    letters = byte_letters()
    a = [(i, len(first.id_to_token(i))) for i in first.encode(f" {text}", add_special_tokens=False).ids]
    assert b"".join(bytes(letters[c] for c in first.id_to_token(i)) for i, _ in a) == f" {text}".encode()
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    b = [(i, piece(i)) for i in second.encode(text)]
    if b"".join(p for _, p in b) != f" {text}".encode():
        return []
    out, group, at, j, to = [], ([], []), 0, 0, 0
    for i, size in a:
        at += size
        group[0].append(i)
        while j < len(b) and to + len(b[j][1]) <= at:
            to += len(b[j][1])
            group[1].append(b[j][0])
            j += 1
        if to == at:
            out.append(group)
            group = ([], [])
    assert not group[0] and j == len(b)
    return out


def plain(texts, libraries):
    groups = [plain_groups(t, libraries) for t in texts]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for k, g in enumerate(groups):
        links = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return groups, out


def test_against_a_walk_over_the_bytes(spark, libraries):
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, pairs int")
    groups, want = plain(TEXTS, libraries)
    assert sorted(map(tuple, align(docs).collect())) == want
    assert [want[k][1] for k in (2, 3, 8)] == [0, 0, 0] and all(w[1] for k, w in enumerate(want) if k not in (2, 3, 8))
    found = {r.doc_id: [(x.a, x.b) for x in r.groups] for r in aligned_groups(docs).collect()}
    assert found == dict(enumerate(groups))


def test_a_whole_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = [(rows[w[0]].doc_id, *w[1:]) for w in plain([r.text for r in rows], libraries)[1]]
    assert sorted(map(tuple, align(docs.repartition(7)).collect())) == want


def test_repeated_rows_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("x", "same text"), ("x", "same text"), (None, "same text")], "doc_id string, text string")
    rows = align(docs).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and rows[0].count_sum == 3 * rows[0].n_links == 3 * rows[0].n_best
    assert align(docs.where("false")).collect() == []
