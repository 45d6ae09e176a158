"""Word-first back-off against a plain restatement, training included, and held-out accuracy."""

import re
from collections import Counter, defaultdict
from math import exp, log

import pytest

from lodestrand.llm.langid import UNKNOWN, held_out, identify, keep_identified, learn, predict

SF = "/root/testdata/sf0.01/documents.parquet"


def words(text):
    return [w for t in (text or "").split() for w in re.findall(r"[^\W\d_]+", t.lower())]


def grams(word, order):
    padded = f" {word} " if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class Plain:
    """Counts and scores in plain Python, from (text, lang) rows."""

    def __init__(self, rows):
        counts = defaultdict(Counter)
        for text, lang in rows:
            if text is not None and lang is not None:
                counts[lang, 0].update(words(text))
        for lang, _ in list(counts):
            for word, n in counts[lang, 0].items():
                for order in (1, 2, 3, 4):
                    for g in grams(word, order):
                        counts[lang, order][g] += n
        self.langs = sorted(x for x, k in counts if k == 0 and counts[x, 0])
        self.total = {key: sum(c.values()) for key, c in counts.items()}
        self.counts = counts

    def row(self, key, kind):
        if not any(self.counts[x, kind][key] for x in self.langs):
            return None
        floor = 0.1 / max(self.total[x, kind] for x in self.langs)
        shares = [self.counts[x, kind][key] / self.total[x, kind] or floor for x in self.langs]
        return [log(x / sum(shares)) for x in shares]

    def word(self, word):
        if (row := self.row(word, 0)) is not None:
            return row
        for order in (4, 3, 2, 1):
            rows = [(n, r) for g, n in Counter(grams(word, order)).items() if (r := self.row(g, order)) is not None]
            if rows:
                return [sum(n * r[k] for n, r in rows) / sum(n for n, _ in rows) for k in range(len(self.langs))]
        return None

    def __call__(self, text):
        if not any(c.isalpha() for c in text or "") or not self.langs:
            return UNKNOWN, 0.0
        rows = [r for w in words(text) if (r := self.word(w)) is not None]
        totals = [sum(r[k] for r in rows) for k in range(len(self.langs))]
        best = max(range(len(totals)), key=lambda k: totals[k])
        sharp = min(len(rows), 20) / max(len(rows), 1)
        return self.langs[best], 1 / sum(exp((t - totals[best]) * sharp) for t in totals)


def learned(docs):
    return [(r.text, r.lang) for r in docs.where(~held_out()).select("text", "lang").collect()]


@pytest.mark.parametrize("most", [10**9, 4000, 0])
def test_against_plain_version(spark, most):
    docs = spark.read.parquet(SF).limit(120)
    plain = Plain([(r.text, r.lang) for r in docs.select("text", "lang").collect()])
    texts = [r.text for r in spark.read.parquet(SF).where("doc_id % 7 = 3").select("text").collect()][:120]
    texts += [None, "", "123 !?", "² ½", "xqzt", "word" * 4000, "xq" * 200_000, "ÉÉÉ 𝒳𝒴", "the the the", "日本語 テスト", "a", "the"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in predict(asked, learn(docs), keep=["doc_id"], max_numbers=most).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = plain(text)
        assert got[i].lang_pred == want[0] and got[i].score == pytest.approx(want[1], rel=1e-4), text and text[:40]


def test_known_words_follow_log_frequency(spark):
    model = learn(spark.createDataFrame([("a a b", "x"), ("b c", "y"), (None, "x"), ("z", None)], "text string, lang string"))
    assert model.langs == ["x", "y"]
    x, y = model.table.where("kind = 0 and key = 'b'").first().row
    assert x - y == pytest.approx(log((1 / 3) / (1 / 2))) and model.table.where("key = 'z'").isEmpty()


def test_rare_words_are_known_whatever_the_corpus(spark):
    rows = [("common " * 300_000, "x"), ("gewöhnlich " * 300_000, "y"), ("quokka", "x")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    for most in (10**9, 0):
        assert predict(spark.createDataFrame([("quokka",)], "text string"), learn(docs), max_numbers=most).first().lang_pred == "x"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    for most in (10**9, 0):
        rows = identify(docs, max_numbers=most).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
        assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
        assert all(0 <= r.score <= 1 for r in rows)


def test_clashing_names_and_empty(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", "k", 1), (2, None, "en", None, 2), (3, "le chat", None, "k", None), (None, "the", "en", "k", 4)], "doc_id long, text string, lang string, lang_pred string, _rid int")
    for most in (10**9, 0):
        kept = keep_identified(docs.withColumnRenamed("lang_pred", "label"), max_numbers=most)
        assert kept.columns == ["doc_id", "text", "lang", "label", "_rid"] and {r.doc_id for r in kept.collect()} <= {1, 3, None}
        kept = keep_identified(docs, max_numbers=most)
        assert kept.columns == docs.columns and {(r.doc_id, r._rid) for r in kept.collect()} >= {(1, 1), (None, 4)}
        none = docs.where("doc_id > 9")
        assert predict(none, learn(none), keep=["doc_id"], max_numbers=most).count() == 0
        assert predict(none, learn(docs), keep=["doc_id"], names=("p", "s"), max_numbers=most).count() == 0
        assert {r.p for r in predict(docs, learn(none), keep=["doc_id"], names=("p", "s"), max_numbers=most).collect()} == {UNKNOWN}
