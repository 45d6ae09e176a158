"""Near duplicates: exact cells against all pairs, few rounds for long chains, signs of edges against the sequential rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import near

SCHEMA = "vec_id long, embedding array<double>"


def all_pairs(rows, threshold):
    v = np.array([x for _, x in rows])
    v = v / np.linalg.norm(v, axis=1)[:, None]
    sims, ids = v @ v.T, [i for i, _ in rows]
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(np.triu(sims >= threshold, 1)))}


def clustered(n_clusters, size, dims=16, spread=0.12, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n_clusters):
        centre = rng.standard_normal(dims)
        out += [list(map(float, centre + spread * np.linalg.norm(centre) * rng.standard_normal(dims))) for _ in range(size)]
    return list(enumerate(out + [[x * 1.01 + 0.003 for x in v] for v in out[::5]]))  # near copies of every fifth


@pytest.mark.parametrize("threshold", [0.99, 0.9, 0.6, 0.2])
def test_exact_pairs_are_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(near, "TILE", 40)  # several slices a cell
    rows = clustered(12, 50)
    got = [(r.a, r.b) for r in near.similar_pairs(spark.createDataFrame(rows, SCHEMA), threshold, method="exact").collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(rows, threshold) != set()


def test_a_hot_cell_and_pivots_of_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 32)
    rows = clustered(1, 300, spread=0.05) + [(1000 + i, v) for i, v in clustered(3, 40, seed=6)]
    got = {(r.a, r.b) for r in near.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.95, method="exact").collect()}
    assert got == all_pairs(rows, 0.95)


def test_candidates_are_few_in_clusters(spark):
    """Planted near copies at 0.9: under a tenth of all pairs are compared."""
    rows = clustered(40, 25, dims=32, spread=0.03)
    nodes = spark.createDataFrame(rows, "id long, v array<double>")
    cells = near.angular_cells(nodes, 0.9, 32)
    n = near.cell_sizes(cells).agg(F.sum("n_candidates")).first()[0]
    assert cells.where("own").count() == len(rows) and len(all_pairs(rows, 0.9)) <= n < len(rows) * (len(rows) - 1) / 2 / 10


def test_hashing_fits_threshold_and_size():
    bits, tables, cost = near.hashing_for(100_000, 0.9, 1e-4)
    assert bits > 8 and tables == near.tables_for(0.9, bits, 1e-4) and cost < 100_000**2 / 200
    assert near.hashing_for(2000, 0.4, 1e-4)[2] > 2000 * 1999 / 20  # there the exact way is taken


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, []), (6, None), (7, [float("nan"), 1.0]), (8, [-1.0, 0.0])]
    for method in ("exact", "hash", "auto"):
        got = near.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.9, method=method)
        assert sorted((r.a, r.b) for r in got.collect()) == [(1, 2), (1, 3)]
        assert near.similar_pairs(spark.createDataFrame([], SCHEMA), 0.9, method=method).count() == 0
    kept = {r.vec_id: (r.kept, r.duplicate_of) for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.9).collect()}
    assert kept == {1: (True, None), 2: (False, 1), 3: (False, 1)} | {i: (True, None) for i in (4, 5, 6, 7, 8)}
    with pytest.raises(ValueError):
        near.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.0)
    with pytest.raises(Exception, match="unequal length"):
        near.similar_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [3.0, 1.0])], SCHEMA), 0.9, method="exact").collect()


def sequential(ids, pairs):
    before, kept, by = {}, set(), {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
    for i in ids:
        first = min((a for a in before.get(i, []) if a in kept), default=None)
        if first is None:
            kept.add(i)
        else:
            by[i] = first
    return kept, by


def decided(spark, ids, pairs):
    out = near.greedy_near_duplicates(spark.createDataFrame([(i,) for i in ids], "vec_id long"), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(out) == len(ids)
    return {r.vec_id for r in out if r.kept}, {r.vec_id: r.duplicate_of for r in out if not r.kept}


@pytest.mark.parametrize("seed,shape", [(1, "sparse"), (2, "dense"), (3, "ladder"), (4, "trees")])
def test_greedy_is_the_sequential_rule(spark, seed, shape):
    rng, ids = random.Random(seed), list(range(300))
    if shape == "ladder":  # two chains with rungs, so that nodes hang on both signs of one node
        pairs = {(i, i + 2) for i in range(298)} | {(i, i + 1) for i in range(0, 299, 3)}
    elif shape == "trees":
        pairs = {(rng.randrange(max(0, i - 4), i), i) for i in range(1, 300)} | {(rng.randrange(i), i) for i in range(5, 300, 7)}
    else:
        pairs = {tuple(sorted(rng.sample(ids, 2))) for _ in range(250 if shape == "sparse" else 3000)}
    assert decided(spark, ids, sorted(pairs)) == sequential(ids, sorted(pairs))


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rounds, real = [], near.stored
    monkeypatch.setattr(near, "stored", lambda df, name: (rounds.append(name), real(df, name))[1])
    n = 10_000
    kept, by = decided(spark, list(range(n)), [(i, i + 1) for i in range(n - 1)])
    assert kept == set(range(0, n, 2)) and by == {i: i - 1 for i in range(1, n, 2)}
    assert rounds.count("known") <= 40


def test_pairs_of_spread_vectors_are_few_rows(spark, monkeypatch):
    """Where cells save nothing a row is dealt out as often as there are slices, and not to half of all cells; what meets in a
    block of hashed rows leaves it only if it is similar."""
    monkeypatch.setattr(near, "TILE", 64)
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((2000, 32)))]
    rows += [(5000 + i, [x + 0.02 for x in v]) for i, v in rows[::3]]
    dealt, real = [], near._dealt
    monkeypatch.setattr(near, "_dealt", lambda *a: (dealt.append(near.stored(real(*a), "dealt")), dealt[-1])[1])
    df, want = spark.createDataFrame(rows, SCHEMA), all_pairs(rows, 0.9)
    for method, options in (("exact", {}), ("hash", {"missed": 1e-9})):
        got = [(r.a, r.b) for r in near.similar_pairs(df, 0.9, method=method, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 600
    assert dealt[0].count() <= (near.SLICES + 1) * len(rows)
    met = near._hashed(df.selectExpr("vec_id AS id", "embedding AS v"), 0.9, 4, 40, 7)
    assert met.count() == len(want)


def test_products_are_bounded_by_few_dimensions():
    """far pairs are told by a third of the dimensions, and what passes is compared whole; rows of blocks are short."""
    rng = np.random.default_rng(8)
    for n, m, same in ((1500, 1500, True), (1300, 1111, False)):
        one = rng.standard_normal((n, 64))
        one[::7] = one[1::7][: len(one[::7])] + 0.3 * one[::7]
        one = (one / np.linalg.norm(one, axis=1, keepdims=True)).astype(np.float32)
        other = one if same else one[rng.permutation(n)[:m]]
        assert near._bounding(one, other, 0.9)[0].shape[1] <= 40
        for least in (0.9, 0.2):
            i, j = (np.concatenate(x) for x in zip(*near._alike(one, other, least, same)))
            met = one @ other.T >= least
            want = set(zip(*np.nonzero(np.triu(met, 1) if same else met)))
            assert len(i) == len(set(zip(i, j))) and abs(len(want) - len(i)) <= 1e-4 * len(want) + 1 and len(want - set(zip(i, j))) <= 1e-4 * len(want) + 1
    short = near._short(one.astype(np.float64))
    back, off = near._from_short(short)
    assert short.shape[1] == 72 and np.abs(back @ back.T - one @ one.T).max() <= off < 0.03


@pytest.mark.parametrize("order", ["mixed", "by cluster"])
def test_the_greedy_choice_makes_few_pairs(spark, monkeypatch, order):
    """F16: where most vectors are similar to many others, not all pairs are made, and the choice is that of the sequential rule;
    clusters whose ids follow each other are taken apart."""
    monkeypatch.setattr(near, "PREFIX", 60, raising=False)
    monkeypatch.setattr(near, "TILE", 64)
    made, real = [], near.stored
    monkeypatch.setattr(near, "stored", lambda df, name: (made.append((name, real(df, name))), made[-1][1])[1])
    vectors = [v for _, v in clustered(8, 150, dims=12, spread=0.15)]
    if order == "mixed":
        random.Random(3).shuffle(vectors)
    rows = [(f"{i:05d}", v) for i, v in enumerate(vectors)]
    pairs = sorted(all_pairs(rows, 0.8))
    kept, by = sequential([i for i, _ in rows], pairs)
    rows += [("x1", vectors[7]), ("x2", vectors[7]), ("y", [0.0] * 12), ("z", None)]
    got = near.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), 0.8, method="exact").collect()
    copies = {i: "00007" if "00007" in kept else by["00007"] for i in ("x1", "x2")}
    assert len(got) == len(rows) and {r.vec_id for r in got if r.kept} == kept | {"y", "z"}
    assert {r.vec_id: r.duplicate_of for r in got if not r.kept} == by | copies
    assert sum(df.count() for name, df in made if name == "pairs") < len(pairs) / 10
