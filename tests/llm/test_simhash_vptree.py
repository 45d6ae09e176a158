"""Fingerprints, pairs and components against brute force."""

import numpy as np
import pytest
import xxhash

from lodestrand.llm.simhash_vptree import build_tree, drop_near_copies, fingerprint, link_fingerprints, link_within, near_groups, route, thirds, Labels

SCHEMA = "doc_id long, text string, fp string"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = dict(fps)
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if bin(label[a] ^ label[b]).count("1") <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_points(n, seed):
    rng = np.random.default_rng(seed)
    points = list(rng.integers(0, 1 << 63, n // 2, np.uint64, endpoint=True))
    while len(points) < n:
        p = int(points[rng.integers(len(points))])
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            p ^= 1 << int(b)
        points.append(np.uint64(p))
    return np.unique(np.array(points, np.uint64))


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "One two\tthree", "a b c d", "The a b c d e f g " * 50, "É ü ß x y z", "x" * 5000])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("levels", [0, 1, 4, 7])
def test_trees_find_every_pair(levels):
    points = near_points(1500, levels)
    labels = Labels(len(points))
    for mask, radius in thirds(4):
        for _, home, visit in route(build_tree(points[::3], mask, levels), points, mask, radius):
            link_within(points, home, visit, mask, radius, 4, labels)
    want = plain_components({i: int(p) for i, p in enumerate(points)})
    assert labels.of.tolist() == [want[i] for i in range(len(points))]


def test_links_in_spark(spark):
    points = near_points(900, 5).view(np.int64).tolist()
    fps = spark.createDataFrame(list(zip(points, range(len(points)))), "fp long, node long")
    edges = link_fingerprints(fps, shard_rows=60, sample_rows=200).collect()
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = plain_components({i: p & (1 << 64) - 1 for i, p in enumerate(points)})
    assert [find(i) for i in range(len(points))] == [want[i] for i in range(len(points))]


def test_groups(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base, "x"), (3, base.replace("word7 ", "other "), "x"), (9, base.upper(), None), (4, None, "x"), (8, "", None), (1, "something else entirely here", "x"), (5, base, "x"), (2, "x" * 300_000, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in near_groups(docs).collect())
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    want = plain_components(fps)
    assert got == sorted((i, fps[i], want[i]) for i, _, _ in rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_groups(docs).count() == 0 and drop_near_copies(docs).count() == 0


def test_null_and_repeated_ids(spark):
    texts = [" ".join(f"{x}{i}" for i in range(200)) for x in ("a", "b", "c", "d")]
    rows = [(None, texts[0], "x"), (None, texts[1], "x"), (None, texts[0].upper(), "x"), (7, texts[2], "x"), (7, texts[3], "x"), (8, texts[1], "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len({plain_fingerprint(t) for t in texts}) == 4
    kept = sorted((r.doc_id or 0, r.text.lower()) for r in drop_near_copies(docs).collect())
    assert kept == [(0, texts[0]), (7, texts[2]), (7, texts[3]), (8, texts[1])]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_groups(docs).collect()) == [(0, 0), (0, 0), (0, 8), (7, 7), (7, 7), (8, 8)]


def test_null_id_links_others(spark, monkeypatch):
    ends = {"left": 0, "middle": 0b1111, "right": 0b11111111}
    monkeypatch.setattr("lodestrand.llm.simhash_vptree.fingerprints", lambda docs, text, doc_id: spark.createDataFrame([(0, 1, ends["left"]), (1, None, ends["middle"]), (2, 2, ends["right"])], "rid long, doc_id long, fp long"))
    assert {r.component_id for r in near_groups(spark.createDataFrame([], SCHEMA)).collect()} == {1}
