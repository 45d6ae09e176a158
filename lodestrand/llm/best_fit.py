"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

A document's tokens, with an end token, are one piece, or several if they are more than a sequence holds: then the pieces
after the first fill a sequence each. Pieces are packed by best fit decreasing: the longest first, each into the open
sequence with the least room that still holds it. A segment tree over the remaining capacities finds that room in
logarithmic time.

Pieces of one length are alike to this rule, so what it does follows from how many there are of each: a table of at most
``capacity`` rows, whatever the data's size. The driver packs these numbers, run by run: pieces of one length go to a run of
sequences with the same room, as many to each as it holds, which is what the rule does piece by piece. The plan that comes
out says for the k-th piece of a length which sequence is its, and where; its size is bounded by the capacity alone
(``most_steps``). Each piece then finds its place in its length (by ranges, see positions) and its step of the plan by
bisection. So the whole corpus is packed as one, no piece passes through the driver, and a hot length is dealt out.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import arrow_rows, materialize
from .encoders import BYTE_BPE, ByteBpe, flat_ids
from .positions import with_positions

CAPACITY, END = 1024, 2


class Rooms:
    """A segment tree over remaining capacities: which of them open sequences have."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.leaves, bool)

    def mark(self, room: int, is_open: bool) -> None:
        node = room + self.leaves
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, size: int) -> int | None:
        """The least room of at least size."""
        node = size + self.leaves
        if self.open[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def most_steps(capacity: int) -> int:
    """A bound of a plan's steps. A length breaks at most two runs of sequences and opens at most two, so there are four
    runs for each length at most; the lengths in one sequence differ by step, so a run of them has sqrt(2 * capacity) at
    most."""
    return 4 * capacity * (1 + int((2 * capacity) ** 0.5))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """How many pieces there are of each length -> the steps of best fit decreasing, and the number of sequences.

    A step (size, place, n, sequence, each, offset): the n pieces of this size from the place-th on go to sequences from
    the given one on, ``each`` to a sequence, one after the other from offset on.
    """
    rooms, runs, steps, sequences = Rooms(capacity), {}, [], 0

    def put(size: int, place: int, n: int, first: int, each: int, room: int) -> int:
        """Fills whole sequences of a run; returns the place after."""
        steps.append((size, place, n, first, each, capacity - room))
        if left := room - each * size:
            runs.setdefault(left, []).append((first, n // each))
            rooms.mark(left, True)
        return place + n

    for size in sorted(counts, reverse=True):
        if not 0 < size <= capacity:
            raise ValueError(f"a piece of {size} tokens doesn't fit in {capacity}")
        place, total = 0, counts[size]
        while place < total:
            room = rooms.tightest(size)
            if room is None:
                room, first, n = capacity, sequences, -(-(total - place) // (capacity // size))
                sequences += n
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    rooms.mark(room, False)
            each = room // size
            full = min(n, (total - place) // each)
            if full:
                place = put(size, place, full * each, first, each, room)
            if full < n and place < total:  # the last sequence takes what is left
                place = put(size, place, total - place, first + full, total - place, room)
                full += 1
            if full < n:
                runs.setdefault(room, []).append((first + full, n - full))
                rooms.mark(room, True)
    if len(steps) > most_steps(capacity):
        raise RuntimeError(f"a plan of {len(steps)} steps for {capacity} tokens")
    return np.array(steps, np.int64).reshape(-1, 6), sequences


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what doesn't fill a sequence."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, vocabulary: str = BYTE_BPE, with_ids: bool = False) -> DataFrame:
    """docs -> doc_id, piece, start, length, ids_crc32 (unsigned, of the ids as little-endian 32-bit numbers), ids if asked.

    A null text counts as empty: the end token alone. Strings of added tokens in a text are these tokens. A text is encoded
    whole, one at a time. Repeated rows are documents of their own; an empty table gives no rows; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    held: list[ByteBpe] = []
    kind = docs.schema[doc_id].dataType
    fields = [StructField("doc_id", kind), *StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids).fields]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(ByteBpe(shared.value))
        rows, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
        for row, text in enumerate(batch.column(1)):
            ids = flat_ids([*held[0].ids(text.as_py() or ""), end])
            for number, (start, length) in enumerate(cut(len(ids), capacity)):
                mine = ids[start : start + length]
                rows.append(row)
                numbers.append(number)
                starts.append(start)
                lengths.append(length)
                sums.append(zlib.crc32(mine.astype("<u4", copy=False)))
                if with_ids:
                    kept.append(mine)
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
        if with_ids:
            columns.append(pa.array(kept, pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return arrow_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), work, StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a written table with doc_id, piece, length and others) -> with sequence_id and offset, all packed as one.

    Of pieces of one length, the order is that of doc_id (nulls first), then piece, then as read, so reruns agree.
    An empty table gives no rows.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    steps, _ = plan(counts, capacity)
    before, total = {}, 0
    for size in sorted(counts, reverse=True):
        before[size], total = total, total + counts[size]
    # steps come by falling size and rising place, so their first pieces, counted over all sizes, are sorted
    begins = np.array([before[s] for s in steps[:, 0].tolist()], np.int64) + steps[:, 1]
    bases = np.zeros(capacity + 1, np.int64)
    for size, base in before.items():
        bases[size] = base
    shared = pieces.sparkSession.sparkContext.broadcast((begins, steps, bases))
    placed = with_positions(pieces, "length", [F.asc_nulls_first("doc_id"), F.asc("piece")], name="pieces").drop("group_size")
    schema = StructType([*pieces.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        begins, steps, bases = shared.value
        size, place = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "pos"))
        step = steps[np.searchsorted(begins, bases[size] + place, "right") - 1]
        k = place - step[:, 1]
        added = pa.array(step[:, 3] + k // step[:, 4]), pa.array(step[:, 5] + k % step[:, 4] * size)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], schema.names)

    return arrow_rows(placed, work, schema)


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, vocabulary: str = BYTE_BPE, with_ids: bool = False) -> DataFrame:
    """docs -> one row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset; see pieces and pack."""
    return pack(materialize(pieces(docs, text, doc_id, capacity, end, vocabulary, with_ids), "encoded"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """pack_documents(with_ids=True) -> the sequences: sequence_id, ids, starts (where each piece begins), doc_ids."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.offset").alias("starts"), F.col("rows.doc_id").alias("doc_ids"))
