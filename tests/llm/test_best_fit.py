"""The plan against best fit decreasing piece by piece; pieces against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestrand.llm.best_fit import Rooms, most_steps, pack, pack_documents, plan, sequences
from lodestrand.llm.common import materialize
from lodestrand.llm.encoders import BYTE_BPE, ByteBpe

TEXTS = ["", None, "short", "a <|endoftext|> b<|endoftext|>", "word " * 1023, "word " * 1022 + "word", "word " * 5000, "x" * 50_000, "日本語 ünï 👩‍👩‍👧\n\n  x", "short", " "]


def plain_fit(sizes, capacity):
    """The number of sequences, each piece into the open one with the least room."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fitting:
            rooms[min(fitting)[1]] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_against_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 16, 64, 1000, 1024])
    sizes = [rng.choice([rng.randint(1, capacity), max(1, capacity // rng.randint(1, 5))]) for _ in range(rng.randint(1, 400))]
    steps, n = plan(Counter(sizes), capacity)
    filled, places = defaultdict(list), defaultdict(int)
    for size, place, count, first, each, offset in steps.tolist():
        assert place == places[size]
        places[size] += count
        for k in range(count):
            filled[first + k // each].append((offset + k % each * size, size))
    assert places == Counter(sizes) and sorted(filled) == list(range(n)) and len(steps) <= most_steps(capacity)
    for rows in filled.values():
        at = 0
        for offset, size in sorted(rows):
            assert offset == at
            at += size
        assert at <= capacity
    assert sorted(capacity - sum(s for _, s in rows) for rows in filled.values()) == plain_fit(sizes, capacity)


def test_tree_finds_the_tightest_room():
    rooms, held, rng = Rooms(100), set(), random.Random(1)
    for _ in range(2000):
        room = rng.randint(0, 100)
        held ^= {room}
        rooms.mark(room, room in held)
        size = rng.randint(0, 100)
        assert rooms.tightest(size) == min((x for x in held if x >= size), default=None)


def check(rows, texts, capacity):
    """Pieces cover each document, sequences are filled without gaps; returns the number of sequences."""
    library = Tokenizer.from_file(BYTE_BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity))) and all(r.length == capacity for r in mine[1:])
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [1024, 64, 5])
def test_documents(spark, capacity):
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(TEXTS)], "doc_id long, text string, piece int, pos int")
    rows = pack_documents(docs, capacity=capacity).collect()
    assert check(rows, TEXTS, capacity) == len(plain_fit([r.length for r in rows], capacity))


def test_whole_table_reruns_and_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    renumbered = [texts[k] for k in sorted(texts)]
    packed = pack_documents(docs, with_ids=True)
    rows = packed.collect()
    names = {k: i for i, k in enumerate(sorted(texts))}
    moved = [type(r)(**{**r.asDict(), "doc_id": names[r.doc_id]}) for r in rows]
    assert check(moved, renumbered, 1024) == len(plain_fit([r.length for r in rows], 1024))
    columns = ["doc_id", "piece", "sequence_id", "offset"]
    assert sorted(map(tuple, pack_documents(docs.repartition(9)).select(*columns).collect())) == sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows)
    by_id = {r.sequence_id: r for r in sequences(packed).collect()}
    for r in rows:
        assert by_id[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids
        assert by_id[r.sequence_id].doc_ids[by_id[r.sequence_id].starts.index(r.offset)] == r.doc_id


def test_hot_length_text_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(f"d{k % 3}", "one two") for k in range(5000)] + [(None, None)], "doc_id string, text string")
    rows = pack_documents(docs).collect()
    assert len(rows) == 5001 and len({(r.sequence_id, r.offset) for r in rows}) == 5001
    assert len({r.sequence_id for r in rows}) == len(plain_fit([r.length for r in rows], 1024))
    assert pack_documents(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        pack(materialize(spark.createDataFrame([("a", 0, 9)], "doc_id string, piece int, length long"), "long"), 8)


def test_ids_are_the_library_s():
    """Over a character of each kind and block, between letters, digits and spaces."""
    library = Tokenizer.from_file(BYTE_BPE)
    with open(BYTE_BPE, "rb") as f:
        ours = ByteBpe(f.read())
    letters = [chr(c) for c in [*range(0x300), *range(0x300, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}1 .{c}. {c} {c}x  {c}{c}'s\n" for c in letters]
    assert [ours.ids(t) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
