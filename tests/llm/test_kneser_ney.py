"""The model's probabilities against a plain restatement, and its verdicts."""

import functools
import math
import re
from collections import Counter, defaultdict

import pytest

from lodestrand.llm.kneser_ney import MIN_HELD, ORDER, held_out, judge_quality, learn, perplexities, score, train

SF = "/root/testdata/sf0.01"


def plain_model(texts):
    counts = {ORDER: Counter()}
    for t in texts:
        s = "\0" * (ORDER - 1) + t
        counts[ORDER].update(s[i : i + ORDER] for i in range(len(t)))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    steps = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        steps[k] = [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d)]
    held, sums = defaultdict(list), Counter()
    for k, c in counts.items():
        for g, v in c.items():
            held[k, g[:-1]].append(v)
            sums[k, g[:-1]] += v

    def p(k, g):
        if k == 0:
            return 1 / 65536
        total = sums[k, g[:-1]]
        if not total:
            return p(k - 1, g[1:])
        off = lambda v: steps[k][min(v, 3) - 1]
        v = counts[k][g]
        return (v - off(v) if v else 0) / total + sum(map(off, held[k, g[:-1]])) / total * p(k - 1, g[1:])

    return p


def plain_perplexity(p, text):
    s = "\0" * (ORDER - 1) + text
    return math.exp(-sum(math.log(p(ORDER, s[i : i + ORDER])) for i in range(len(text))) / len(text))


def plain_worst(p, text):
    s, found = "\0" * (ORDER - 1) + text, []
    for w in re.finditer(r"[^\x20\x09-\x0D]{3,}", text):
        steps = [math.log(p(ORDER, s[i : i + ORDER])) for i in range(w.start(), min(w.end() + 1, len(text)))]
        found.append(math.exp(-sum(steps) / len(steps)))
    return max(found, default=None)


def test_probabilities(spark):
    texts = ["the cat sat on the mat.", "the dog sat on the log, the end", "a cat and a dog", "é" * 5, "the"]
    model = train(spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string"), min_share=0.0)
    p = plain_model(texts)
    seen = ["the cat", "zzz", "the \n mat", "x", "日本", "the cat sat on the mat." * 50]
    for t, got in zip(seen, perplexities(model, seen)):
        assert got == pytest.approx(plain_perplexity(p, t), rel=1e-3)
    assert perplexities(model, [None, "", "a"])[:2] == [None, None]


def test_verdicts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    rows = judge_quality(docs, labels).join(labels, "doc_id").collect()
    good, junk = ([r for r in rows if r.quality == q and r.toxic == 0] for q in (1, 0))
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in junk) >= 0.7 * len(junk)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "x"), (2, None, None, "x"), (3, "", "en", None), (None, "other", None, "x"), (1, "some text", "en", "x")], "doc_id long, text string, lang string, perplexity string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = judge_quality(docs, labels).collect()
    assert len(rows) == 5 and all((r.perplexity is None) == (r.doc_id in (2, 3)) for r in rows)
    assert all(r.kept for r in judge_quality(docs, labels.where("doc_id > 5")).collect() if r.perplexity is not None)
    assert judge_quality(docs.where("doc_id > 9"), labels).count() == 0


@pytest.mark.parametrize("min_share", [-1.0, 0.0, 0.02, 2.0])
def test_scores_use_the_whole_model(spark, min_share):
    texts = ["the cat sat on the mat.", "the dog sat on the log, the end", "a cat and a dog", "rare words: quixotic zephyr"]
    seen = ["the cat", "quixotic zephyr", "zzz", "the \n mat", "日本", "the cat sat on the mat." * 50, "", None, "the cat", " the  zebra sat", "a b c", "  ", "word" * 30_000]
    tables = learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(seen)], "doc_id long, text string, _rid string")
    p = plain_model(texts)
    got = {r.doc_id: r for r in score(docs, tables, keep=("doc_id", "_rid"), min_share=abs(min_share), max_entries=10**9 if min_share < 0 else 0).collect()}
    assert {i: r.perplexity for i, r in got.items()} == {i: pytest.approx(plain_perplexity(p, t), rel=1e-4) if t else None for i, t in enumerate(seen)}
    assert {i: r.worst_word for i, r in got.items()} == {i: pytest.approx(w, rel=1e-4) if t and (w := plain_worst(p, t)) else None for i, t in enumerate(seen)}


def test_verdicts_do_not_depend_on_what_is_broadcast(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet").where("doc_id < 200") for x in ("documents", "labels"))
    small, whole = ({r.doc_id: (r.perplexity, r.worst_word) for r in judge_quality(docs, labels, max_entries=x).collect()} for x in (0, 10**9))
    assert small == {i: pytest.approx(x, rel=1e-4) for i, x in whole.items()}


def test_registered_path_against_the_plain_model(spark):
    """Perplexities and verdicts of judge_quality as registered, with a model and quantiles in plain Python."""
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    docs = docs.where("doc_id < 260 and length(text) < 4000")
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    held = {r.doc_id for r in docs.where(held_out()).select("doc_id").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    p = functools.lru_cache(None)(plain_model([r.text for i, r in rows.items() if i in good - held]))
    got = {r.doc_id: r for r in judge_quality(docs, labels).collect()}
    assert set(got) == set(rows)
    for field, plain in (("perplexity", plain_perplexity), ("worst_word", plain_worst)):
        for i, r in rows.items():
            assert got[i][field] == (pytest.approx(plain(p, r.text), rel=1e-4) if r.text and plain(p, r.text) else None)
    for i, r in got.items():
        assert r.kept == (r.perplexity is not None and r.perplexity <= r.threshold and (r.worst_word is None or r.worst_word <= r.word_threshold))


def test_thresholds_are_quantiles_of_held_out_trusted_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    good, cuts = defaultdict(list), {}
    for r in judge_quality(docs, labels).join(labels.where("quality = 1 and toxic = 0"), "doc_id").withColumn("held", held_out()).collect():
        good[r.lang].append(r)
        cuts[r.lang] = r
    assert len(good) == 4
    for lang, found in good.items():
        chosen = [r for r in found if r.held] if sum(r.held for r in found) >= MIN_HELD else found
        for field, cut, upper in (("perplexity", "threshold", 0.99), ("worst_word", "word_threshold", 0.995)):
            values = sorted(r[field] for r in chosen if r[field] is not None)
            assert cuts[lang][cut] == values[math.ceil(upper * len(values)) - 1]


def test_abusive_words_show(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    rows = judge_quality(docs, labels).join(labels, "doc_id").where("lang = 'en' and toxic = 1 and quality = 1").collect()
    assert len(rows) > 10 and sum(not r.kept for r in rows) >= 0.9 * len(rows)
