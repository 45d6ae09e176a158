"""Block naming against plain grouping, also under a key that collides all the time."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrand.llm.exact_dedup import drop_exact_copies, exact_groups, name_documents

SCHEMA = "doc_id long, text string, rid string, name string"
TEXTS = [None, "", "a", "A", "É", "é", "ab" * 40, "AB" * 40, "ab" * 39 + "aa", "x" * 64, "x" * 65, "x" * 63, "ü" * 33, "x" * 5000, "x" * 4999 + "y", "x" * 128, "yx" * 32 + "x" * 64, "x" * 64 + "yx" * 32]


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def rows(extra=0):
    out = [(i, t, "r", None) for i, t in enumerate(TEXTS + TEXTS[::2])]
    return out + [(100 + i, "hot", "r", None) for i in range(extra)] + [(3, "a", "again", None)]


@pytest.mark.parametrize("key", [F.xxhash64, lambda b: F.pmod(F.xxhash64(b), F.lit(3)), lambda b: F.lit(7).cast("long")])
def test_names_tell_texts_apart(spark, key):
    found = defaultdict(set)
    docs = spark.createDataFrame(rows(20), SCHEMA)
    for r in exact_groups(docs, block_bytes=16, key=key).collect():
        found[(r.keep_id, r.text_sha256)].add(r.doc_id)
    want = defaultdict(set)
    for i, t, _, _ in rows(20):
        want[lower(t)].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    named = name_documents(docs, block_bytes=16, key=key)
    assert named.select("level", "name").distinct().count() == len(want)


def test_groups(spark):
    import hashlib

    want = defaultdict(list)
    for i, t, _, _ in rows():
        want[lower(t)].append(i)
    got = exact_groups(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert len(got) == len(rows()) and sum(r.kept for r in got) == len(want)
    texts = defaultdict(set)
    for i, t, _, _ in rows():
        texts[i].add(lower(t))
    for r in got:
        text = next(t for t in texts[r.doc_id] if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (max(want[text]), len(want[text]))


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame(rows(5), SCHEMA)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({lower(t) for _, t, _, _ in rows(5)})


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_groups(docs).count() == 0 and drop_exact_copies(docs).count() == 0


def test_second_key_is_drawn_anew(spark):
    tried = []

    def second(raw, seed):
        tried.append(seed)
        return F.lit(1).cast("long") if seed < 2 else F.xxhash64(F.lit(seed), raw)

    docs = spark.createDataFrame(rows(5), SCHEMA)
    named = name_documents(docs, block_bytes=16, key=lambda b: F.lit(7).cast("long"), second=second)
    assert named.select("level", "name").distinct().count() == len({lower(t) for _, t, _, _ in rows(5)}) and max(tried) == 2
    with pytest.raises(RuntimeError):
        name_documents(docs, block_bytes=16, key=lambda b: F.lit(7).cast("long"), second=lambda b, seed: F.lit(seed).cast("long"))
