"""Leaks against a plain search, with re-parameterised and inconsistent copies."""

import random
import re
from collections import Counter

from lodestrand.llm.decontaminate import NAMES, NUMBERS, UNITS, drop_leaks, leaks

ITEM = "Alice has 12 apples and buys 7 more for 3 euros each. How many apples does Alice have after giving Bob 5 of the apples?"
OTHER = "Le grand ensemble des nombres premiers est infini selon le théorème ancien."
SCHEMA = "doc_id long, text string, rid string, item_id string"


def plain(text, item, window=5):
    """Share of the item's windows in the text, laying it over every place of the text, token by token."""

    def template(t):
        out = []
        for w in re.findall(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W\d_\u3040-\u30ff\u3400-\u9fff]+|\d+(?:[.,]\d+)*", t or ""):
            low = w.lower()
            unit = out and out[-1][0] == "#" and low in UNITS
            out.append(("unit" if unit else "#" if low[0].isdigit() or low in NUMBERS else "name" if low in NAMES else "word", low, w[0].isupper()))
        return out

    a, b = template(text), template(item)
    size = min(window, len(b))
    if not b or (len(b) < 3 and len(a) != len(b)):
        return 0.0
    covered = set()
    for shift in range(-len(b), len(a)):
        pairs = [(a[i + shift], y) if 0 <= i + shift < len(a) else (None, y) for i, y in enumerate(b)]
        kinds = []
        for x, y in pairs:
            if x is None:
                kinds.append(None)
            elif x[1] == y[1]:
                kinds.append("same")
            elif len(b) < window:
                kinds.append(None)
            elif x[0] == y[0] != "word":
                kinds.append("typed")
            elif x[0] in ("word", "name") and (y[0] == "name" or (y[0] == "word" and x[2] and y[2])):
                kinds.append("form")
            else:
                kinds.append(None)
        if len({y[1] for k, (_, y) in zip(kinds, pairs) if k == "form"}) > 1 + len(b) // 8:
            kinds = [None if k == "form" else k for k in kinds]
        covered |= {i for i in range(len(b) - size + 1) if set(kinds[i : i + size]) == {"same"}}
        if {"typed", "form"} & set(kinds):
            slots = [i for i, (k, (_, y)) in enumerate(zip(kinds, pairs)) if k in ("typed", "form") or (k and (y[0] != "word" or y[2]))]
            for value in {b[i][1] for i in slots}:
                there = [i for i in slots if b[i][1] == value]
                votes = Counter(pairs[i][0][1] for i in there)
                best = min(votes, key=lambda v: (-votes[v], v))
                for i in there:
                    if pairs[i][0][1] != best:
                        kinds[i] = None
        covered |= {i for i in range(len(b) - size + 1) if all(kinds[i : i + size])}
    return len(covered) / (len(b) - size + 1)


def rows():
    changed = ITEM.replace("Alice", "Carol").replace("12", "40").replace("7", "9").replace("Bob", "Sam")
    broken = ITEM.replace("does Alice", "does Maria").replace("Alice has", "Carol has")
    return [
        (1, f"Intro words here. {ITEM} And more.", "x", None),
        (2, f"Intro. {changed.upper()}\nend", "x", None),
        (3, f"Intro. {broken} end", "x", None),
        (4, "The cat sat on the mat and Alice has 12 apples and that is all there is to say.", "x", None),
        (5, OTHER, None, None),
        (6, None, "x", None),
        (7, "", "x", None),
        (8, "x " * 50_000 + OTHER, "x", None),
        (1, ITEM, "again", None),
        (9, ITEM[: len(ITEM) // 2], "x", None),
    ]


def test_both_ways_and_plain_search(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    bench = spark.createDataFrame([(10, ITEM), (11, OTHER), (12, None), (13, "two words"), (14, "")], "item_id long, text string")
    want = sorted((d, i) for d, t, _, _ in rows() for i, item in ((10, ITEM), (11, OTHER)) if plain(t, item) >= 0.8)
    for most in (1000, -1):
        got = leaks(docs, bench, max_broadcast=most).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == want
        assert {(r.doc_id, r.verbatim) for r in got} >= {(1, True), (2, False), (5, True)}
    assert {d for d, _ in want} == {1, 2, 5, 8}


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    bench = spark.createDataFrame([(10, ITEM), (11, OTHER)], "item_id long, text string")
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    want = sorted(d for d, t, _, _ in rows() if max(plain(t, ITEM), plain(t, OTHER)) < 0.8)
    assert {4, 6, 7, 9} <= set(want)
    for most in (1000, -1):
        assert sorted(r.doc_id for r in drop_leaks(docs, bench, max_broadcast=most).select("doc_id").collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, bench).count() == 0 and leaks(docs.where("doc_id > 99"), bench).count() == 0


def test_names_and_numbers_beyond_the_lists(spark):
    item = "Zoe went to Lisbon with 4 friends and Zoe paid for every ticket there while the others bought lunch and some coffee."
    same = item.replace("Zoe", "Priya").replace("4", "eleven").replace("Lisbon", "Accra")
    odd = same.replace("Priya paid", "Ahmed paid")
    texts = [same, f"Before. {same} After.", odd, item.lower(), item.upper(), item.replace("Zoe", "priya").replace("Lisbon", "accra"), "Nothing of this kind stands here at all, nor does Zoe."]
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = {i: plain(t, item) for i, t in enumerate(texts)}
    for most in (1000, -1):
        got = {r.doc_id: r for r in leaks(docs, bench, max_broadcast=most).collect()}
        assert {i: r.cover for i, r in got.items()} == {i: c for i, c in want.items() if c >= 0.8}
        assert {0, 1, 3, 4} <= set(got) and got[3].verbatim and got[4].verbatim and not got[0].verbatim and 6 not in got
    assert 0 < want[2] < 1  # one name that changes midway costs the windows around it, not all of them


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Capital of France?"), (2, "Why?"), (3, "日本の首都"), (4, "add 3 to 4")], "item_id long, text string")
    texts = ["Tell me: capital of France? Now.", "Why?", "why not and why", "これは日本の首都です", "capital of Spain", "add 5 to 6", "Now add 3 to 4."]
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA)
    for most in (1000, -1):
        assert sorted((r.doc_id, r.item_id) for r in leaks(docs, bench, max_broadcast=most).collect()) == [(0, 1), (1, 2), (3, 3), (6, 4)]


def test_common_windows_and_random_copies(spark):
    rng = random.Random(8)
    words = ["what", "is", "the", "sum", "of", "and", "Alice", "Omar", "7", "12", "km", "tree", "Lima", "two"]
    items = [(i, "what is the sum of the " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(25)]
    texts = []
    for _ in range(60):
        out = " ".join(rng.choice(words) for _ in range(8)) + " " + rng.choice(items)[1] + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))
        for a, b in rng.sample([("Alice", "Bob"), ("Omar", "Jin"), ("7", "9"), ("two", "six"), ("Lima", "Oslo"), ("sum", "total")], 2):
            out = out.replace(a, b, rng.choice([1, 9]))
        texts.append(out)
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i): c for d, t in enumerate(texts) for i, x in items if (c := plain(t, x)) >= 0.8}
    for most in (1000, -1):
        got = {(r.doc_id, r.item_id): r.cover for r in leaks(docs, bench, max_broadcast=most).collect()}
        assert set(got) <= set(want) and all(got[k] <= want[k] for k in got) and len(got) >= 0.97 * len(want) > 20


def test_long_repetition(spark):
    docs = spark.createDataFrame([(1, "yes " * 60_000, "x", None), (2, "Bob Alice " * 20_000, "x", None)], SCHEMA)
    bench = spark.createDataFrame([(1, "yes " * 12), (2, "Alice Bob " * 8)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks(docs, bench).collect()) == [(1, 1), (2, 2)]
