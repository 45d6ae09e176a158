"""Chunkers against plain restatements on random texts."""

import random
import re

from pyspark.sql import functions as F

from lodestrand.functions.text import sentences
from lodestrand.operators import chunk as C

import pytest


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12)))
    out = ["", None, "   ", "One.", "No end", "A. B! C? " + "x" * 300 + ". D.", "y" * 250]
    for _ in range(40):
        out.append(rng.choice([" ", "\n"]).join(" ".join(word() for _ in range(rng.randint(1, 20))) + rng.choice([".", "!", "?", ""]) for _ in range(rng.randint(1, 25))))
    return out


def split(text):
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]


def packed(text, most, least):
    done, buf = [], []
    for s in split(text):
        if buf and sum(map(len, buf)) + len(s) > most:
            done.append(" ".join(buf))
            buf = [s]
        elif not buf and len(s) > most:
            done += [s[i : i + most] for i in range(0, len(s), most)]
        else:
            buf.append(s)
    tail = " ".join(buf)
    if buf and done and len(tail) < least:
        done[-1] += " " + tail
    elif buf:
        done.append(tail)
    return done


def overlapped(text, most, overlap):
    done, buf = [], []
    for s in split(text):
        if buf and sum(map(len, buf)) + len(s) > most:
            done.append(" ".join(buf))
            kept = []
            for x in buf[::-1]:
                if sum(map(len, kept)) + len(x) > overlap:
                    break
                kept.insert(0, x)
            buf = kept
        if not buf and len(s) > most:
            done += [s[i : i + most] for i in range(0, len(s), most)]
        else:
            buf.append(s)
    return done + ([" ".join(buf)] if buf else [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string").cache()


def chunks(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append(r.content)
    return out


def want(f):
    return {i: c for i, t in enumerate(texts()) if t and t.strip() and (c := f(t))}


def test_sentences(docs):
    got = {r.doc_id: r.s for r in docs.where("text is not null").select("doc_id", sentences(F.col("text")).alias("s")).collect()}
    assert got == {i: split(t) for i, t in enumerate(texts()) if t is not None}


@pytest.mark.parametrize("most,least", [(60, 20), (100, 1), (30, 30), (500, 400)])
def test_sentence_chunks(docs, most, least):
    assert chunks(C.sentence_chunks(docs, most=most, least=least)) == want(lambda t: packed(t, most, least))


@pytest.mark.parametrize("most,overlap", [(60, 20), (100, 99), (40, 0)])
def test_sliding_chunks(docs, most, overlap):
    assert chunks(C.sliding_chunks(docs, most=most, overlap=overlap)) == want(lambda t: overlapped(t, most, overlap))


def test_fixed_windows(spark, docs):
    one = spark.createDataFrame([(1, "abcdefghij0123456789")], "doc_id int, text string")
    assert chunks(C.sliding_chunks(one, most=10, overlap=2, boundaries=False)) == {1: ["abcdefghij", "ij01234567", "6789"]}

    def plain(t):
        out, at = [], 0
        while True:
            out.append(t[at : at + 50])
            if at + 50 >= len(t):
                return out
            at += 40

    assert chunks(C.sliding_chunks(docs, most=50, overlap=10, boundaries=False)) == want(plain)
    with pytest.raises(ValueError):
        C.fixed_windows(F.col("text"), 10, 10)


def test_hierarchy(spark):
    text = "lost\n# Title\n\nIntro\n\n## Section A\nText a\n### Deep\ndeep\n## Section B\n" + "p" * 60 + "\n\n" + "q" * 60 + "\n# Last"
    rows = C.hierarchical_chunks(spark.createDataFrame([(1, text), (2, "plain"), (3, " ")], "doc_id int, text string"), most=100).orderBy("doc_id", "chunk_index").collect()
    got = [(r.doc_id, r.title, r.level, r.parent_index, r.n_children, r.content) for r in rows]
    assert got == [
        (1, "Title", 1, None, 3, "Intro"),
        (1, "Section A", 2, 0, 1, "Text a"),
        (1, "Deep", 3, 1, 0, "deep"),
        (1, "Section B (part 1)", 2, 0, 0, "p" * 60),
        (1, "Section B (part 2)", 2, 0, 0, "q" * 60),
        (1, "Last", 1, None, 0, ""),
        (2, "Document", 0, None, 0, "plain"),
    ]


def test_semantic_chunks(spark):
    rows = spark.createDataFrame([(1, 0, "aaaa", None), (1, 1, "bbbb", 0.9), (1, 2, "cccc", 0.1), (1, 3, "dddd", 0.2), (1, 4, "e" * 30, 0.95)], "doc_id int, sent_idx int, sentence string, prev_sim double")
    assert chunks(C.semantic_chunks(rows, threshold=0.5, most=20, least=8)) == {1: ["aaaa bbbb", "cccc dddd", "e" * 30]}
