"""Round trips of formatted conversations, and trees against plain enumeration."""

import hashlib
import random

from pyspark.sql import functions as F

from lodestrand.llm.chat_format import as_chain, choose_paths, digest, format_conversations, read_loss, read_turns
from lodestrand.llm.queries import op8_chat_format

CHAIN = "conv_id long, turn long, role string, text string, node string"
TREE = "conv_id long, node long, parent long, role string, text string, score double"
NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>x", "a\\b<\\s>", "<\\\\/s>", "[\\INST]", "<<SYS>>\n<</SYS>>", "<|im_end|>\n", "", None, "é<", "\\", "<\\|im_end|>", "x" * 100_000, "line\nline"]


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb", "\\n<s>"]), rng.choice(NASTY), "x") for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "no id", "x"), (50, None, "assistant", "no turn", "x"), (50, 1, "assistant", "one", "x"), (50, 1, "assistant", "one", "x")]
    out = format_conversations(as_chain(spark.createDataFrame(rows, CHAIN)))
    got = {r.conv_id: r for r in digest(out).collect()}
    seen = {r.conv_id: r for r in out.select("conv_id", "formatted", read_turns(out.formatted).alias("turns"), read_loss(out.formatted, out.loss_spans).alias("loss")).collect()}
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=key)
        turns = [(r[2] or "", r[3] or "") for r in mine]
        assert [tuple(t) for t in seen[c].turns] == turns
        loss = [t for role, t in turns if role == "assistant"]
        assert seen[c].loss == loss
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len("".join(loss)), len(seen[c].formatted))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(loss).encode()).hexdigest()


def test_best_branches(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(12):
        ids = [c * 100 + i for i in range(rng.randint(1, 14))]
        parent = {n: (rng.choice(ids[:i]) if i else None) for i, n in enumerate(ids)}
        score = {n: rng.choice([0.0, 0.5, 1.0]) for n in ids}
        rows += [(c, n, parent[n], "user", str(n), score[n]) for n in ids]
        paths = []
        for leaf in set(ids) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append((-sum(score[n] for n in path) / len(path), -len(path), leaf, path[::-1]))
        want[c] = [p[3] for p in sorted(paths)[:2]]
    rows += [(99, 9901, 9902, "user", "circle", 1.0), (99, 9902, 9901, "user", "circle", 1.0), (98, 9801, 555_555, "user", "parent is missing", None)]
    want[98] = [[9801]]
    got = {}
    for r in choose_paths(spark.createDataFrame(rows, TREE), branches=2).orderBy("conv_id", "branch", "pos").collect():
        got.setdefault(r.conv_id, {}).setdefault(r.branch, []).append(r.node)
    assert {c: [g[b] for b in sorted(g)] for c, g in got.items()} == want


def test_long_chain_and_empty(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}", "x") for t in range(300)]
    (r,) = digest(format_conversations(as_chain(spark.createDataFrame(rows, CHAIN)))).collect()
    assert r.n_turns == 300
    assert format_conversations(as_chain(spark.createDataFrame([], CHAIN))).count() == 0


def test_repeated_messages_and_shared_nodes(spark):
    rows = [(1, 10, None, "user", "root", 0.0), (1, 10, None, "user", "root", 0.0), (1, 11, 10, "assistant", "leaf", 1.0), (1, 11, 10, "assistant", "leaf", 1.0)]
    rows += [(2, 10, None, "user", "other root", 0.0), (2, 11, 10, "assistant", "other leaf", None), (None, 10, None, "user", "no id", 0.0), (None, 11, 10, "assistant", "no id either", 0.0)]
    rows += [(3, None, None, "user", "without a node", 0.0), (3, None, 10, "user", "nor this", 0.0)]
    got = {(r.conv_id, r.branch): [tuple(t) for t in r.turns] for r in format_conversations(spark.createDataFrame(rows, TREE), branches=2).select("conv_id", "branch", read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {
        (1, 1): [("user", "root"), ("assistant", "leaf")],
        (2, 1): [("user", "other root"), ("assistant", "other leaf")],
        (None, 1): [("user", "no id"), ("assistant", "no id either")],
        (3, 1): [("user", got[3, 1][0][1])],
        (3, 2): [("user", got[3, 2][0][1])],
    }
    assert {got[3, 1][0][1], got[3, 2][0][1]} == {"without a node", "nor this"}


def test_a_real_control_conversation(spark, tmp_path):
    rows = [(-1, 0, "user", "real"), (-1, 1, "assistant", "answer"), (4, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.n_turns, r.loss_chars) for r in op8_chat_format(spark, str(tmp_path)).collect())
    assert got == [(-1, 2, 6), (-1, 2, 21), (4, 1, 0)]


def test_rows_out_of_a_shuffle(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c}", "x") for c in range(50) for t in range(c % 7 + 1)]
    docs = spark.createDataFrame(rows, CHAIN)
    want, got = (sorted(map(tuple, digest(format_conversations(as_chain(d))).collect())) for d in (docs, docs.repartition("text").distinct()))
    assert got == want
