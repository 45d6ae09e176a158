"""The seen-set of vectors over several batches: order, copies, odd rows, restarts, lifetime."""

import time

import numpy as np

from lodestrand.streaming.seen import near_deduplicated

SCHEMA = "doc_id long, embedding array<double>, text string"


def follow(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def load(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")


def test_batches_are_the_sequential_rule(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, kept = [], []
    for i in range(90):
        v = rng.standard_normal(8) if i < 20 or i % 5 == 0 else np.array(rows[rng.integers(len(rows))][1]) + 0.12 * rng.standard_normal(8)
        rows.append((i, [float(x) for x in v], f"t{i}"))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for i, v, _ in rows:
        if all(unit(v) @ unit(w) < 0.95 for w in kept):
            kept.append(v)
    for at in (0, 30, 60):
        load(spark, tmp_path, at, rows[at : at + 30])
    odd = [(200, None, "n"), (201, [], "e"), (202, [0.0] * 8, "z"), (None, rows[0][1], "k"), (5, rows[5][1], "again"), (203, rows[7][1], "copy"), (203, rows[7][1], "copy")]
    load(spark, tmp_path, 99, odd)
    for _ in range(2):  # the second run finds nothing new
        got = near_deduplicated(follow(spark, tmp_path), 0.95, path=f"{tmp_path}/seen", bits=6, missed=1e-9).collect()
        assert sorted(r.embedding for r in got if r.text.startswith("t")) == sorted(kept)
        assert sorted(r.text for r in got if not r.text.startswith("t")) == ["e", "k", "n", "z"] and len(kept) < 80


def test_rows_are_forgotten_after_their_lifetime(spark, tmp_path):
    load(spark, tmp_path, 0, [(1, [1.0, 0.0], "a")])
    run = lambda: sorted(r.text for r in near_deduplicated(follow(spark, tmp_path), 0.95, path=f"{tmp_path}/seen", lifetime=25).collect())
    assert run() == ["a"]
    load(spark, tmp_path, 1, [(2, [1.0, 0.0], "b")])
    assert run() == ["a"]
    time.sleep(26)
    load(spark, tmp_path, 2, [(3, [1.0, 0.0], "c")])
    assert run() == ["a", "c"]


def test_a_block_holds_many_vectors_in_a_value_and_a_pair_leaves_one_block():
    """blocks of all tables together give each similar pair once, and hold a value a batch."""
    from types import SimpleNamespace

    from lodestrand.operators.near import hash_codes
    from lodestrand.streaming.seen import Bucket

    rng, bits, tables = np.random.default_rng(2), 3, 12
    units = rng.standard_normal((120, 8))
    units[60:] = units[:60] + 0.05 * rng.standard_normal((60, 8))
    units[119] = units[0]
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    blocks, held, got = hash_codes(units, bits, tables, 7), {}, []
    for at, part in enumerate((range(0, 100), range(100, 120))):
        for block in np.unique(blocks[list(part)]):
            mine = [i for i in reversed(part) if block in blocks[i]]
            own = held.setdefault(block, [])
            bucket = Bucket(0.95, None, bits, tables, 7)
            bucket.held = SimpleNamespace(get=lambda own=own: iter(list(own)), appendValue=own.append)
            rows = [SimpleNamespace(names=[str(i) for i in half], places=list(half), at=at, units=units[half].tobytes()) for half in (mine[::2], mine[1::2]) if half]
            got += [(int(r.name), int(r.other), r.at, r.other_at) for r in bucket.handleInputRows((block,), iter(rows), None)]
    met = (blocks[:, None, :] == blocks[None]).any(axis=2) & (units @ units.T >= 0.95)
    want = {(i, j, int(i >= 100), int(j >= 100)) for i, j in zip(*np.nonzero(np.tril(met, -1)))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert max(map(len, held.values())) <= 2
