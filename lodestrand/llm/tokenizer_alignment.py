"""Alignment of two tokenizers' tokens over the same bytes.

A byte-level vocabulary (A) and one of pieces (B) both cut a text, with a space before it, into tokens whose bytes follow
each other. The byte spans of B's tokens are a static interval index: two sorted arrays of starts and ends. For each token
of A two bisections (stabbing queries at its first and last byte) list the tokens of B that it overlaps. A gap between two
tokens of A that no token of B spans is a boundary: there both end, and the tokens up to it are a group. The token of A and
the one of B that end at a boundary are a link. A few megabytes of texts are aligned at once, as arrays.

Over the corpus, a pair of ids is counted by how many links hold it. Of two tokens that end together, one's bytes end with
the other's, so all pairs there can ever be follow from the two vocabularies (some 400,000 here): pairs are numbered within
this list, and only the list's counts are broadcast. Texts are encoded once. The written table holds each document's pairs
and how often it has them; a second pass sums these by task and then by pair, a third reads the counts back into each row.
No shuffle carries more than (pair, count) rows, combined by task before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import arrow_parts, arrow_rows, materialize
from .encoders import BYTE_BPE, PIECE_BPE, ByteBpe, PieceBpe, flat_ids, joined

#: Bytes of text that are aligned at once; a longer text by itself.
_CHUNK = 1 << 21
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_GROUP = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs of ids whose tokens can end together, as a * len(b) + b, sorted: one's bytes end with the other's."""

    def suffixes(tokens: list[bytes], others: list[bytes]) -> Iterator[tuple[int, int]]:
        ids: dict[bytes, list[int]] = {}
        for i, token in enumerate(others):
            ids.setdefault(token, []).append(i)
        for i, token in enumerate(tokens):
            for k in range(len(token)):
                for j in ids.get(token[k:], ()):
                    yield i, j

    found = {i * len(b) + j for i, j in suffixes(a, b)} | {i * len(b) + j for j, i in suffixes(b, a)}
    return np.sort(np.fromiter(found, np.int64, len(found)))


class Aligned:
    """Some texts' tokens, groups and links, as arrays over all of them."""

    def __init__(self, texts: list[str], first: ByteBpe, second: PieceBpe, sizes: tuple[np.ndarray, np.ndarray], tables: tuple[pa.Array, pa.Array]):
        spaced = [f" {t}" for t in texts]
        raw = [t.encode() for t in spaced]
        sides = [[first.plain(t) for t in spaced], second.ids(texts)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        counts = [np.array([len(x) for x in side], np.int64) for side in sides]
        flat = [flat_ids([i for x in side for i in x]) for side in sides]
        whole = self._same(b"".join(raw), at, flat, counts, tables)
        if not whole.all():  # texts that don't come back have no tokens
            flat = [ids[np.repeat(whole, n)] for ids, n in zip(flat, counts)]
            counts = [np.where(whole, n, 0) for n in counts]
        self.a, self.b = flat
        self.n_a, self.n_b = counts
        end_a, end_b = (np.cumsum(size[ids]) for size, ids in zip(sizes, flat))
        start_a, start_b = end_a - sizes[0][self.a], end_b - sizes[1][self.b]
        # the tokens of B from low to high (not included) overlap a token of A
        low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        self.cuts = np.flatnonzero(np.append(high[:-1] == low[1:], True)[: len(self.a)])
        self.stops_a, self.stops_b = self.cuts + 1, high[self.cuts]  # tokens up to each group's end
        self.link_a, self.link_b = self.a[self.cuts], self.b[self.stops_b - 1]
        ends = np.cumsum(self.n_a)
        self.groups_to = np.concatenate([[0], np.searchsorted(self.stops_a, ends, "right")])  # groups before each document
        self.n_groups = np.diff(self.groups_to)

    @staticmethod
    def _same(raw: bytes, at: np.ndarray, flat: list[np.ndarray], counts: list[np.ndarray], tables: tuple[pa.Array, pa.Array]) -> np.ndarray:
        """Whether both sides' joined bytes are the text's, for each document."""
        whole = np.ones(len(at) - 1, bool)
        for ids, n, table in zip(flat, counts, tables):
            data, offsets = joined(table, ids)
            mine = offsets[np.concatenate([[0], np.cumsum(n)])]
            if data[: mine[-1]] != raw:
                whole &= [data[mine[i] : mine[i + 1]] == raw[at[i] : at[i + 1]] for i in range(len(whole))]
        return whole

    def written(self, table: pa.Array) -> list[str]:
        """The digest of each document's groups, given the ways to write a token (see _written)."""
        n_a, n_b = len(self.a), len(self.b)
        group_a, group_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        group_a[self.stops_a[:-1]] = 1
        group_b[self.stops_b[:-1]] = 1
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[self.stops_a - 1] = 1
        last_b[self.stops_b - 1] = 1
        codes = np.empty(n_a + n_b, np.int64)
        before_b = np.concatenate([[0], self.stops_b])
        codes[np.arange(n_a) + before_b[np.cumsum(group_a)]] = 2 * self.a.astype(np.int64) + last_a
        codes[np.arange(n_b) + self.stops_a[np.cumsum(group_b)] if n_b else []] = len(table) - 2 * (self.b.astype(np.int64) + 1) + last_b
        data, offsets = joined(table, codes)
        ends = offsets[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def listed(self) -> pa.Array:
        """Each document's groups as lists of ids."""
        sides = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(ids.astype(np.int32))) for stops, ids in ((self.stops_a, self.a), (self.stops_b, self.b))]
        return pa.ListArray.from_arrays(pa.array(self.groups_to, pa.int32()), pa.StructArray.from_arrays(sides, fields=list(_GROUP)))


class Aligner:
    """What a task needs to align texts, made once from the vocabulary files' bytes."""

    def __init__(self, first: bytes, second: bytes):
        self.first, self.second = ByteBpe(first), PieceBpe(second)
        both = self.first.tokens, self.second.tokens
        self.sizes = tuple(np.array([len(t) for t in x], np.int64) for x in both)
        self.tables = tuple(pa.array(x, pa.large_binary()) for x in both)
        self.pairs = linkable(*both)
        # A's tokens with , or | after them; then B's, from the last to the first, with , or ;
        ways = [f"{i}{c}".encode() for i in range(len(both[0])) for c in ",|"] + [f"{i}{c}".encode() for i in reversed(range(len(both[1]))) for c in ",;"]
        self.ways = pa.array(ways, pa.large_binary())

    def __call__(self, texts: list[str]) -> Aligned:
        return Aligned(texts, self.first, self.second, self.sizes, self.tables)

    def numbered(self, found: Aligned) -> np.ndarray:
        """The number of each link's pair."""
        return np.searchsorted(self.pairs, found.link_a.astype(np.int64) * len(self.second.tokens) + found.link_b)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's texts, null ones empty, and the row that each begins with."""
    begin, held, size = 0, [], 0
    for row, text in enumerate(batch.column(1)):
        if size >= _CHUNK:
            yield begin, held
            begin, held, size = row, [], 0
        held.append(text.as_py() or "")
        size += len(held[-1])
    if held:
        yield begin, held


def _each(docs: DataFrame, text: str, doc_id: str, vocabularies: tuple[str, str], columns: str, work) -> DataFrame:
    """docs -> doc_id and the columns that work(aligner, aligned) makes of each chunk; empty texts have no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(Path(x).read_bytes() for x in vocabularies))  # files of fixed size
    held: list[Aligner] = []
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), *StructType.fromDDL(columns).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _chunks(batch):
                if not held:
                    held.append(Aligner(*shared.value))
                found = held[0](texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), *work(held[0], found)], schema.names)

    return arrow_parts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema)


def aligned_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first: str = BYTE_BPE, second: str = PIECE_BPE) -> DataFrame:
    """docs -> doc_id, groups: the ids of each group's tokens, in order.

    Null and empty texts, and those that the tokens' bytes don't give back, have no groups. See align for the rest.
    """
    return _each(docs, text, doc_id, (first, second), "groups array<struct<a:array<int>,b:array<int>>>", lambda _, found: [found.listed()])


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first: str = BYTE_BPE, second: str = PIECE_BPE) -> DataFrame:
    """docs -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is counted as often over the corpus as any pair with its id of B. count_sum: the counts of the
    pairs of all links. groups_sha256: of the groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens.
    Null and empty texts, and those that the tokens' bytes don't give back, have no tokens: zeros. Strings of added tokens
    in texts are plain text. Texts are encoded whole, a long one by itself. Repeated rows each have a row and each count;
    ties among an id's best pairs all count. An empty table gives no rows; other columns aren't read.
    """

    def encoded(aligner: Aligner, found: Aligned) -> list[pa.Array]:
        document = np.repeat(np.arange(len(found.n_a)), found.n_groups)
        n = len(aligner.pairs)
        keys, times = np.unique(document * n + aligner.numbered(found), return_counts=True)
        ends = pa.array(np.searchsorted(keys, np.arange(len(found.n_a) + 1) * n), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % n, times)]
        # a group ends with its one link
        numbers = [pa.array(x.astype(np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_groups)]
        return [*numbers, pa.array(found.written(aligner.ways), pa.string()), *lists]

    columns = ", ".join(f"{c} long" for c in _NUMBERS) + ", groups_sha256 string, pairs array<int>, times array<int>"
    rows = materialize(_each(docs, text, doc_id, (first, second), columns, encoded), "aligned")
    held = ByteBpe(Path(first).read_bytes()).tokens, PieceBpe(Path(second).read_bytes()).tokens
    pairs = linkable(*held)
    counts, best = _counted(rows, pairs % len(held[1]))
    shared = docs.sparkSession.sparkContext.broadcast((counts, best))  # as long as the list of pairs
    names = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = StructType([*[rows.schema[c] for c in names], *StructType.fromDDL("n_best long, count_sum long").fields])

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, best = shared.value
        pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
        flat, n, ends = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (best[flat] * n, counts[flat] * n)]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *(pa.array(np.diff(x[ends])) for x in sums)], schema.names)

    return arrow_rows(rows, summed, schema).select("doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")


def _counted(rows: DataFrame, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count of each pair of the list, and whether it is the highest of its id of B (b: that id for each pair)."""
    size = len(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            flat, n = (batch.column(k).flatten().to_numpy() for k in (0, 1))
            total += np.bincount(flat, n, size).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["pair", "n"])

    found = arrow_parts(rows.select("pairs", "times"), run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    highest = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    return counts, (counts == highest[b]).astype(np.int64)
