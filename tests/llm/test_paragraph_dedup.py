"""Repeated paragraphs against all pairs, and the cases that contracts plant."""

import random
import re

import numpy as np
import pyarrow as pa

from lodestrand.llm.paragraph_dedup import FIELDS, MIN_JACCARD, _told, link_bands, repeated_paragraphs, split_words, units

SCHEMA = "doc_id long, text string, rid string"


def plain(rows):
    """(doc_id, first word's place among paragraphs) of every paragraph that repeats across rows, by cluster."""
    units = []
    for r, (doc, text, _) in enumerate(rows):
        for p in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|[\n\r]", text or ""):
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in p)) if w]
            if len(words) >= 12:
                units.append((r, doc, words, {tuple(words[i : i + 5]) for i in range(len(words) - 4)}))
    parent = list(range(len(units)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(units):
        for j, b in enumerate(units[:i]):
            if len(a[3] & b[3]) >= 0.8 * len(a[3] | b[3]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i, u in enumerate(units):
        groups.setdefault(find(i), []).append((u[0], u[1], len(u[2])))
    return sorted(sorted((d, n) for _, d, n in g) for g in groups.values() if len({r for r, _, _ in g}) > 1)


def found(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.component_id, []).append((r.doc_id, r.n_words, r.removed, r.component_size))
    for g in groups.values():
        assert sum(not x[2] for x in g) == 1 and {x[3] for x in g} == {len(g)}
    return sorted(sorted(x[:2] for x in g) for g in groups.values())


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    passage = prose(rng, 30) + ". " + prose(rng, 28) + "."
    long = prose(rng, 60)
    rows = []
    for i in range(24):
        body = [prose(rng, rng.randint(3, 40)) + rng.choice([".", "!", "?", ""]) for _ in range(4)]
        if i % 3 == 0:
            words = body[1].split()
            body[1] = " ".join([*words[:2], passage, *words[2:]])
        if i % 5 == 0:
            words = long.split()
            words[rng.randrange(55, 60)] = f"changed{i}"
            body.insert(2, " ".join(words).upper() + ".")
        rows.append((i, rng.choice(["\n", " "]).join(body), "x"))
    rows += [(99, None, None), (98, "", "x"), (97, "short", "x"), (3, rows[3][1], "again")]
    got = found(repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and any(len(g) >= 8 for g in got)


def test_within_one_document_only(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen."
    assert repeated_paragraphs(spark.createDataFrame([(1, f"{line}\n{line}", "x"), (2, "else", "x")], SCHEMA)).count() == 0


def test_spans_cut_the_text(spark):
    line = "Ünd two three four five six seven eight nine ten eleven twelve thirteen."
    rows = [(1, f"Start. {line} End.", "x"), (2, f"é\n{line}", "x")]
    texts = {d: t.encode() for d, t, _ in rows}
    out = repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.stretch_words for r in out] == [13, 13]
    assert [texts[r.doc_id][r.start : r.start + r.length].decode() for r in out] == [line, line]


def test_a_shared_sentence_has_rows_in_both_documents(spark):
    rng = random.Random(8)
    for n in (12, 16, 20, 24):
        shared = [prose(rng, n) + "." for _ in range(2)]
        rows = [(1, f"{prose(rng, 30)}. {shared[0]} {prose(rng, 40)}.", "x"), (2, f"{prose(rng, 9)}.\n{shared[0]}", "x"), (3, f"{shared[0]} {shared[1]}", "x"), (4, f"{prose(rng, 40)}. {shared[1]}", "x")]
        out = repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((r.doc_id, r.n_words, r.stretch_words, r.removed) for r in out) == [(1, n, n, False), (2, n, n, True), (3, n, 2 * n, False), (3, n, 2 * n, True), (4, n, n, True)]


def test_text_ids(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen."
    out = repeated_paragraphs(spark.createDataFrame([("a", line), ("b", line), (None, line)], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.removed) for r in out} == {(None, False), ("a", True), ("b", True)}


def test_empty(spark):
    assert repeated_paragraphs(spark.createDataFrame([], SCHEMA)).count() == 0


def windows_of(found):
    return [k for k, t in zip(found["key"], found["text"]) if t is None]


def test_any_fifty_shared_words_hold_a_window():
    rng = random.Random(4)
    for _ in range(200):
        passage = prose(rng, 50)
        texts = [" ".join([prose(rng, rng.randint(0, 60)), passage, prose(rng, rng.randint(0, 60))]).strip().encode() for _ in range(2)]
        together = units(b"\n".join(texts), 12, np.array([0, len(texts[0]) + 1]))
        alone = [units(t, 12) for t in texts]
        assert set(windows_of(alone[0])) & set(windows_of(alone[1]))
        assert windows_of(together) == [k for x in alone for k in windows_of(x)]
    stuffed = units(b"buy now " * 500, 12)
    assert [n for n, t in zip(stuffed["words"], stuffed["text"]) if t is None] == [n for n in stuffed["words"].tolist()[1:] if n >= 950] and len(stuffed["words"]) == 2


def test_words_of_scripts_without_spaces():
    text = "the cat 日本語 テa b".encode()
    first, after, _ = split_words(np.frombuffer(text, np.uint8))
    assert [text[a:b].decode() for a, b in zip(first, after)] == ["the", "cat", "日", "本", "語", "テ", "a", "b"]


def test_japanese_sentences(spark):
    rng = random.Random(6)
    made = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
    shared = "".join(made(18) + "。" for _ in range(4))
    rows = [(i, made(40) + "。" + shared + made(30) + "。", "x") for i in range(2)] + [(2, made(200), "x")]
    out = repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in out} == {0, 1} and {r.doc_id for r in out if r.removed} == {1}


def test_words_that_differ_far_behind_their_start(spark):
    a, b = "x" * 64 + "y", "y" + "x" * 64
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{a} {body}.", "x"), (2, f"{b} {body}.", "x"), (3, " ".join([a] * 13 + [b] * 12) + ".", "x"), (4, " ".join([b] * 13 + [a] * 12) + ".", "x")]
    out = repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in out} == {1, 2}


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_large_bands_lose_no_link(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(3):  # families that drift away from their first text, and loners
        base = prose(rng, 24).split()
        for _ in range(30):
            base = list(base)
            base[rng.randrange(24)] = prose(rng, 1)
            texts.append(" ".join(base))
    texts += [prose(rng, 24) for _ in range(10)]
    rows = [(band, i, i, t.encode()) for i, t in enumerate(texts) for band in (1, 2 + i % 2)] + [(9, 0, 0, texts[0].encode())]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(20)} for t in texts]
    want = components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert 10 < len(set(want.values())) < len(texts)
    meet = spark.createDataFrame(rows, "band long, h long, g long, text binary")
    for most, rounds in ((2000, 12), (7, 40), (7, 2), (3, 1)):
        edges = [(a.h, b.h) for a, b in link_bands(meet, MIN_JACCARD, most, rounds).collect()]
        assert components(range(len(texts)), edges) == want and len(edges) < 3 * len(texts) * (rounds + 1)


def test_one_line_everywhere(spark):
    rng = random.Random(9)
    line = prose(rng, 26) + "."
    rows = [(i, f"{prose(rng, 20)}.\n{line if i % 3 else line.replace(line.split()[i % 25], f'v{i}')}\n{prose(rng, 20)}.", None) for i in range(300)]
    got = found(repeated_paragraphs(spark.createDataFrame(rows, SCHEMA), most=20))
    assert got == plain(rows) and len(got) == 1 and len(got[0]) == 212


def test_passages_without_a_long_sentence_of_their_own(spark):
    rng = random.Random(5)
    short, lines, inside = " ".join(prose(rng, 6) + "." for _ in range(10)), "\n".join(prose(rng, 4) for _ in range(15)), prose(rng, 55)
    rows = []
    for i, passage in enumerate([short, short, lines, lines, inside, inside]):
        around = "\n" if passage != inside else " "
        rows.append((i, f"{prose(rng, 70)}{around}{passage}{around}{prose(rng, 70)}.", "x"))
    rows.append((9, prose(rng, 200), "x"))
    out = repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in out} == set(range(6)) and {r.doc_id for r in out if r.removed} == {1, 3, 5}
    texts = {d: t.encode() for d, t, _ in rows}
    for r in out:
        span = texts[r.doc_id][r.start : r.start + r.length].decode()
        assert len(span.split()) == r.n_words >= 25 and span in (short, lines, inside)[r.doc_id // 2] and r.component_size == 2


def test_windows_that_tasks_know_and_windows_that_meet():
    rng = random.Random(11)
    rows = [(rng.randrange(40), rng.choice([1, 1, 1, *range(2, 60)]), rng.randrange(2)) for _ in range(600)] + [(7, 99, 0)] * 5
    seen = []
    for task in range(4):
        mine = [r for i, r in enumerate(rows) if i % 4 == task]
        columns = [pa.array([r[0] for r in mine]), *[pa.array([0] * len(mine))] * 5, pa.array([r[1] for r in mine]), pa.array([r[2] for r in mine])]
        batch = pa.RecordBatch.from_arrays(columns, FIELDS[:-1])
        for out in _told(iter([batch.slice(0, 60), batch.slice(60)])):
            seen += [(r["rid"], r["h"], r["g"], r["slot"], r["known"]) for r in out.to_pylist()]
    assert sorted(r[:3] for r in seen) == sorted(rows)
    meet = {}
    for rid, h, g, slot, _ in seen:
        meet.setdefault((h, g, slot), set()).add(rid)
    truth = {}
    for rid, h, g in rows:
        truth.setdefault((h, g), set()).add(rid)
    assert all((known or len(meet[h, g, slot]) > 1) == (len(truth[h, g]) > 1) for _, h, g, slot, known in seen)
    assert sum(r[1] == 1 and r[3] == 0 for r in seen) <= 16  # two a task of each of the two hot keys
