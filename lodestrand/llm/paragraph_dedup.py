"""Substring deduplication by MinHash banding of paragraphs.

A paragraph here is a sentence of at least MIN_WORDS words: text between line ends and sentence ends. Real paragraphs
would miss a passage that was pasted into the middle of one; its sentences, but for the first, stay whole wherever it is
pasted. Words are runs between white space; in scripts that write without it (Han, kana) each character is a word.
Paragraphs are compared as sets of 5-word shingles.

1. *Bands.* ROWS min-hashes make a band, and BANDS bands a signature. Two paragraphs with a Jaccard similarity s meet in
   some band with probability 1 - (1 - s^ROWS)^BANDS: 0.998 at 0.8 and 1 for equal sets.
2. *Join.* Equal paragraphs (by a 128-bit hash of their words) are one node, so copies make no pairs. A shuffle of (band,
   node) tells which bands hold several nodes; only these nodes fetch their texts. A task knows by itself that a band it
   sees twice is shared, and sends two of the band's nodes there and the others elsewhere, so that a band that a third of
   all paragraphs share doesn't meet in one task.
3. *Verification.* Nodes that share a band are compared exactly, by the words of their shingles, unless they are
   connected already. A band with more than MOST nodes is taken apart first: all its nodes are compared with one of them,
   the pivot. Those linked to it leave the band. As Jaccard distance is a metric, they can be linked to those with a
   similarity to the pivot of 0.6 or more only, and are compared with these in slices; the others go on with a new pivot.
4. *Clusters* are connected components.
5. *Windows* find what paragraphs miss: passages of shorter sentences or short lines, or within one long sentence. Of
   each PASSAGE words in a row, the WINDOW words in a row with the least hash are a unit (winnowing), so that any PASSAGE
   words that two texts share hold a whole common unit. Windows are equal by a 128-bit hash of their words. A window that
   repeats across documents is reported, with all its places, if at some place it touches no reported paragraph.
6. *Stretches.* Repeated units of a document with less than MIN_WORDS words between them form a stretch, whose words are
   reported with each of its units (stretch_words). A single license line is a short stretch in many documents
   (component_size), a passage a long one: callers tell them apart by these, and nothing is left out by itself.

In each cluster the first paragraph (by document, then place) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import arrow_parts, materialize
from .components import connected_components

SHINGLE, MIN_JACCARD, MIN_WORDS = 5, 0.8, 12
BANDS, ROWS = 6, 2
PASSAGE, WINDOW = 50, 25
#: Nodes of a band that are compared in one task; larger bands are taken apart first.
MOST = 2_000
#: Pivots of a band before its rest is compared slice by slice.
ROUNDS = 12
#: Bytes of text that are hashed at once, and (band, node) rows that a task looks through at once.
_CHUNK, _FLUSH = 1 << 20, 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[[10, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?"]] = True
#: Sentence ends of the scripts without spaces, as their three bytes.
_WIDE_STOPS = np.array([int.from_bytes(x.encode(), "big") for x in "。！？"])
_random = np.random.default_rng(20)
_BYTES = _random.integers(0, 1 << 63, 256, np.uint64, endpoint=True)
_PLACES = _random.integers(0, 1 << 63, SHINGLE, np.uint64, endpoint=True) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PERMS = _random.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64, endpoint=True) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The best of each n numbers in a row."""
    size = 1
    while 2 * size <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - n + size], x[n - size :]) if size < n else x


def windows(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the windows of some words' hashes, given the text of each word.

    Equal windows that follow each other within a text (stuffing) are one, from the first to the last.
    """
    n, span = len(words) - PASSAGE + 1, PASSAGE - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(np.full(len(words), _BASE, np.uint64)), dtype=np.uint64)])
    back = np.cumprod(np.full(len(words) - WINDOW + 1, pow(_BASE, -1, 1 << 64), np.uint64))
    found = _mix((sums[WINDOW:] - sums[:-WINDOW]) * back)
    least = np.where(text[:n] == text[PASSAGE - 1 :], _sliding(found, span, np.minimum), np.uint64(0))
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum) == found)
    new = np.ones(len(at), bool)
    new[1:] = (found[at[1:]] != found[at[:-1]]) | (text[at[1:]] != text[at[:-1]]) | (np.diff(at) > span)
    heads = np.flatnonzero(new)
    return at[heads], at[np.append(heads[1:], len(at)) - 1] + WINDOW - 1 if len(at) else at


def split_words(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and hash of each word of some lower-cased bytes."""
    space = _SPACE[at]
    dense = (at >= 0xE3) & (at <= 0xE9)  # the first byte of a character from U+3000 to U+9FFF
    apart = np.concatenate([[True], space[:-1]]) | dense
    apart[3:] |= dense[:-3]
    begins = apart & ~space
    ends = ~space & np.concatenate([(space | begins)[1:], [True]])
    first, after = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(first):
        return first, after, np.zeros(0, np.uint64)
    place = np.arange(len(at)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(at)]])))
    powers = np.cumprod(np.full(int((after - first).max()) + 1, _BASE, np.uint64))
    value = _BYTES[at]
    value[space] = 0
    value *= powers[np.minimum(place, len(powers) - 1)]
    return first, after, _mix(np.add.reduceat(value, first) + (after - first).astype(np.uint64))


def _shingles(words: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of paragraphs that begin at these words and have n words each, and their offsets."""
    m = n - SHINGLE + 1
    offsets = np.concatenate([[0], np.cumsum(m)])
    start = np.repeat(begin, m) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], m)
    out = np.zeros(len(start), np.uint64)
    for k in range(SHINGLE):
        out += words[start + k] * _PLACES[k]
    return _mix(out), offsets


def units(raw: bytes, min_words: int, starts: np.ndarray | None = None) -> dict[str, list]:
    """The paragraphs and windows of some texts' bytes (starts: each text's first byte), a list a field.

    first and length (bytes), at (first word, counted over all texts), words (their number), text (the paragraph's words
    with one space between them; None for windows), key (16 bytes: the hash of the words).
    """
    from xxhash import xxh3_128_digest

    out: dict[str, list] = {k: [] for k in ("first", "length", "at", "words", "text", "key")}
    at = np.frombuffer(raw.lower(), np.uint8)
    first, after, words = split_words(at)
    if len(first) < max(min_words, SHINGLE):
        return out
    lines = np.concatenate([[0], np.cumsum(_LINE_END[at])])
    stops = _STOP[at[after - 1]]
    if len(long := np.flatnonzero(after - first == 3)):
        last = after[long]
        wide = at[last - 3].astype(np.int64) << 16 | at[last - 2].astype(np.int64) << 8 | at[last - 1]
        stops[long] |= np.isin(wide, _WIDE_STOPS)
    stops[:-1] |= lines[first[1:]] != lines[after[:-1]]
    stops[-1] = True
    last = np.flatnonzero(stops)
    begin = np.concatenate([[0], last[:-1] + 1])
    kept = last - begin + 1 >= max(min_words, SHINGLE)
    begin, last = begin[kept], last[kept]
    wide_begin, wide_last = windows(words, np.searchsorted(np.zeros(1) if starts is None else starts, first, "right"))
    # all words with a space after each
    size = after - first
    to = np.cumsum(size + 1) - size - 1
    flat = np.full(to[-1] + size[-1] + 1, 32, np.uint8)
    flat[np.repeat(to, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = at[~_SPACE[at]]
    joined, stop = flat.tobytes(), to + size
    for a, b in zip(begin.tolist(), last.tolist()):
        out["text"].append(joined[to[a] : stop[b]])
    out["key"] = [xxh3_128_digest(x) for x in out["text"]]
    out["key"] += [xxh3_128_digest(joined[to[a] : stop[a + WINDOW - 1]]) for a in wide_begin.tolist()]
    out["text"] += [None] * len(wide_begin)
    a, b = np.concatenate([begin, wide_begin]), np.concatenate([last, wide_last])
    out["first"], out["length"], out["at"], out["words"] = first[a], after[b] - first[a], a, b - a + 1
    return out


def bands(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bands' keys of each paragraph, a row each."""
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    if len(out):
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat((shingles ^ _PERMS[0, k]) * _PERMS[1, k], offsets[:-1])
            out[:, k // ROWS] = _mix(out[:, k // ROWS] + least + np.uint64(k))
    return out


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _CHUNK bytes; a longer text is a run of its own."""
    begin = 0
    while begin < len(sizes):
        end, total = begin, 0
        while end < len(sizes) and (end == begin or total + sizes[end] < _CHUNK):
            total += sizes[end] + 1
            end += 1
        yield begin, end
        begin = end


FIELDS = ["rid", "doc_id", "start", "length", "at", "n_words", "h", "g", "text"]


def _units_of(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)]
        for begin, end in _chunks([len(t) for t in texts]):
            starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[begin:end]])])
            found = units(b"\n".join(texts[begin:end]), min_words, starts)
            if len(found["first"]):
                row = np.searchsorted(starts, found["first"], "right") - 1
                ids = pa.array(row + begin)
                keys = np.frombuffer(b"".join(found["key"]), np.int64).reshape(-1, 2)
                numbers = [found["first"] - starts[row], found["length"], found["at"], found["words"], np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), *map(pa.array, numbers), pa.array(found["text"], pa.binary())], FIELDS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n_words, text) -> band, h, slot, known; see step 2. Slot 0 holds what has to meet."""

    def told(band: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((h, band))
        band, h = band[order], h[order]
        new = np.concatenate([[True], (band[1:] != band[:-1]) | (h[1:] != h[:-1])])
        band, h = band[new], h[new]
        heads = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        size = np.diff(np.append(heads, len(band)))
        place = np.arange(len(band)) - np.repeat(heads, size)
        slot = np.where(place < 2, 0, h | 1)
        return pa.RecordBatch.from_arrays([pa.array(band.view(np.int64)), pa.array(h), pa.array(slot), pa.array(np.repeat(size > 1, size))], ["band", "h", "slot", "known"])

    held, rows = ([], []), 0
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() for t in batch.column(2)]
        sizes = batch.column(1).to_numpy()
        for begin, end in _chunks([len(t) for t in texts]):
            words = split_words(np.frombuffer(b"\n".join(texts[begin:end]), np.uint8))[2]
            n = sizes[begin:end]
            keys = bands(*_shingles(words, np.cumsum(n) - n, n))
            # the band's number is part of its key
            held[0].append(_mix(keys + np.arange(BANDS, dtype=np.uint64)).reshape(-1))
            held[1].append(np.repeat(batch.column(0).to_numpy()[begin:end], BANDS))
            rows += keys.size
        if rows > _FLUSH:
            yield told(*map(np.concatenate, held))
            held, rows = ([], []), 0
    if rows:
        yield told(*map(np.concatenate, held))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with slot and known, as in step 2: a window that a task sees in two documents is known to repeat, and only
    two of its rows have to meet those of other tasks, in slot 0."""

    def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        rid, h, g = (rows.column(FIELDS.index(c)).to_numpy() for c in ("rid", "h", "g"))
        order = np.lexsort((rid, g, h))
        rid, h, g = rid[order], h[order], g[order]
        heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
        size = np.diff(np.append(heads, len(h)))
        known = np.repeat(rid[heads] != rid[heads + size - 1], size)
        place = np.arange(len(h)) - np.repeat(heads, size)
        inner = known & (place > 0) & (place < np.repeat(size, size) - 1)
        slot = np.where(inner, rid * 2 + 1, 0)
        return pa.RecordBatch.from_arrays([*rows.take(pa.array(order)).columns, pa.array(slot), pa.array(known)], [*rows.schema.names, "slot", "known"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > _FLUSH // 4:
            yield told(held)
            held, rows = [], 0
    if rows:
        yield told(held)


def _shingle_set(text: bytes) -> set[bytes]:
    """The shingles of some words with one space between them; the words can't hold spaces, so joined ones tell them apart."""
    words = text.split(b" ")
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def _numbered(sets: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The sets as numbers, one after the other, and how many each has."""
    numbers: dict[bytes, int] = {}
    flat = [numbers.setdefault(x, len(numbers)) for one in sets for x in one]
    return np.array(flat, np.int64), np.array([len(one) for one in sets], np.int64)


def _link_few(sets: list[set[bytes]], min_jaccard: float) -> list[tuple[int, int]]:
    label, out = list(range(len(sets))), []
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and (both := len(a & sets[j])) >= min_jaccard * (len(a) + len(sets[j]) - both):
                out.append((i, j))
                label = [label[j] if x == label[i] else x for x in label]
    return out


def link(texts: list[bytes], right: np.ndarray | None, min_jaccard: float) -> list[tuple[int, int]]:
    """Links that connect all similar ones of some texts; right: only pairs of a left and a right text are compared, and
    the left ones are connected already."""
    sets = [_shingle_set(x) for x in texts]
    if right is None and len(sets) <= 8:
        return _link_few(sets, min_jaccard)
    flat, n = _numbered(sets)
    offsets = np.cumsum(n) - n
    label, out = np.arange(len(texts)), []
    if right is not None:
        label[~right] = np.flatnonzero(~right)[0] if not right.all() else 0
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    for i in range(len(texts)) if right is None else np.flatnonzero(right).tolist():
        others = label != label[i]
        if right is None:
            others[: i + 1] = False
        else:
            others &= ~right
        others = np.flatnonzero(others)
        if not len(others):
            continue
        mine = flat[offsets[i] : offsets[i] + n[i]]
        mark[mine] = True
        where = np.repeat(offsets[others] - (np.cumsum(n[others]) - n[others]), n[others]) + np.arange(n[others].sum())
        both = np.add.reduceat(mark[flat[where]], np.cumsum(n[others]) - n[others], dtype=np.int64)
        mark[mine] = False
        for j in others[both >= min_jaccard * (n[i] + n[others] - both)].tolist():
            if label[i] != label[j]:
                out.append((i, j))
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return out


def _verify(rows: DataFrame, block: list, parts: int, min_jaccard: float) -> DataFrame:
    """rows (h, g, text, right or null) of blocks -> edges between nodes; a task has whole blocks, one after the other."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "h", "g"], ignore_index=True)
        block, h, g, texts = group["block"].to_numpy(), group["h"].to_numpy(), group["g"].to_numpy(), group["text"].tolist()
        sides = None if group["right"].isna().all() else group["right"].to_numpy(bool)
        cuts = np.flatnonzero(np.diff(block)) + 1
        edges = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
            edges += [(a + i, a + j) for i, j in link(texts[a:b], None if sides is None else sides[a:b], min_jaccard)]
        i, j = np.array(edges, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"ah": h[i], "ag": g[i], "bh": h[j], "bg": g[j]})

    dealt = rows.withColumn("block", F.xxhash64(*block)).withColumn("shard", F.pmod(F.xxhash64("block", F.lit(7)), F.lit(parts)))
    found = dealt.select("shard", "block", "h", "g", "text", "right").groupBy("shard").applyInPandas(run, "ah long, ag long, bh long, bg long")
    return found.select(F.struct(F.col("ah").alias("h"), F.col("ag").alias("g")).alias("a"), F.struct(F.col("bh").alias("h"), F.col("bg").alias("g")).alias("b"))


def _against_pivots(rows: DataFrame, min_jaccard: float) -> DataFrame:
    """rows (band, h, g, text, pivot) with ring: 0 linked to the pivot, 1 possibly linked to such a node, 2 neither."""
    reach = max(0.0, 2 * min_jaccard - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = []
            for text, pivot in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                a, b = _shingle_set(text), _shingle_set(pivot)
                both = len(a & b)
                union = len(a) + len(b) - both
                rings.append(0 if both >= min_jaccard * union else 1 if both >= reach * union - 1e-9 else 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rings, pa.int32())], ["band", "h", "g", "text", "ring"])

    return arrow_parts(rows.select("band", "h", "g", "text", "pivot"), work, "band long, h long, g long, text binary, ring int")


def link_bands(meet: DataFrame, min_jaccard: float = MIN_JACCARD, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """meet (band, h, g, text: distinct nodes of each band) -> edges (a, b) that connect all similar nodes of a band."""
    no_side = F.lit(None).cast("boolean").alias("right")
    edges, rest = [], meet
    sizes = materialize(rest.groupBy("band").count(), "bandsizes")
    for _ in range(rounds):
        large = sizes.where(F.col("count") > most).select("band")
        if large.isEmpty():
            break
        hot, cool = rest.join(large, "band", "left_semi"), rest.join(large, "band", "left_anti")
        pivots = materialize(hot.groupBy("band").agg(F.min(F.struct(F.xxhash64("band", "h", "g"), "h", "g", F.col("text").alias("pivot"))).alias("p")), "pivots")
        rings = materialize(_against_pivots(hot.join(pivots.select("band", "p.pivot"), "band"), min_jaccard), "rings")
        node = F.struct("h", "g")
        edges.append(rings.where("ring = 0").join(pivots.select("band", F.struct("p.h", "p.g").alias("b")), "band").select(node.alias("a"), "b").where("a != b"))
        # the linked ones in slices, against slices of those that may be linked to them
        cuts = materialize(rings.groupBy("band").agg(F.ceil(F.count_if(F.col("ring") == 0) / most).alias("n0"), F.ceil(F.count_if(F.col("ring") == 1) / most).alias("n1")).where("n1 > 0"), "cuts")
        sided = rings.where("ring < 2").join(cuts, "band").withColumn("right", F.col("ring") == 1)
        own = F.pmod(F.xxhash64("h", "g"), F.when(F.col("right"), F.col("n1")).otherwise(F.col("n0")))
        sided = sided.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("right"), F.col("n0")).otherwise(F.col("n1")) - 1)))
        sided = sided.withColumn("i", F.when(F.col("right"), F.col("other")).otherwise(F.col("own"))).withColumn("j", F.when(F.col("right"), F.col("own")).otherwise(F.col("other")))
        edges.append(_verify(sided, ["band", "i", "j"], max(1, -(-sided.count() // 20_000)), min_jaccard))
        rest = materialize(cool.unionByName(rings.where("ring > 0").select("band", "h", "g", "text")), "rest")
        sizes = materialize(rest.groupBy("band").count(), "bandsizes")
    else:  # what is still large is compared slice by slice
        large = sizes.where(F.col("count") > most).withColumn("k", F.ceil(F.col("count") / most)).select("band", "k")
        sliced = rest.join(large, "band").withColumn("own", F.pmod(F.xxhash64("h", "g"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        sliced = sliced.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select("band", "i", "j", "h", "g", "text", no_side)
        edges.append(_verify(sliced, ["band", "i", "j"], max(1, -(-sliced.count() // 20_000)), min_jaccard))
        rest = rest.join(large.select("band"), "band", "left_anti")
    several = rest.join(sizes.where("count > 1").select("band"), "band", "left_semi").select("band", "h", "g", "text", no_side)
    out = _verify(several, ["band"], max(1, -(-int(sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]) // 20_000)), min_jaccard)
    for more in edges:
        out = out.unionByName(more)
    return out


def repeated_paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, min_jaccard: float = MIN_JACCARD, most: int = MOST) -> DataFrame:
    """docs -> one row per paragraph that repeats across documents, and per window that repeats apart from those.

    rid (row number within this scan), doc_id, start and length (UTF-8 bytes of the text, from 0), n_words,
    stretch_words, component_id, component_size, removed: false for the first paragraph of its cluster, which stays (of
    equal doc_ids the row read first, null ids first).
    A cluster lies in two rows of docs at least; repetition within one row alone isn't reported. Null and empty texts and
    shorter ones give no rows. Repeated rows of docs repeat each other. Texts are read whole, a long one as one chunk. An
    empty table gives no rows. Other columns aren't read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, start long, length long, at long, n_words long, h long, g long, text binary"
    both = materialize(arrow_parts(rows, lambda x: _units_of(x, min_words), schema), "units")
    paragraphs, wide = both.where("text is not null"), both.where("text is null")
    meet = arrow_parts(paragraphs.select("h", "n_words", "text"), _keyed, "band long, h long, slot long, known boolean")
    w = W.partitionBy("band", "slot")
    meet = meet.withColumn("shared", F.col("known") | (F.min("h").over(w) != F.max("h").over(w)))
    meet = materialize(meet.where("shared").select("band", "h").distinct(), "meetings")
    # tables of their own: the join starts from two shuffles and can be split, and copies are combined before the next one
    wanted = materialize(meet.select("h").distinct(), "wanted")
    texts = materialize(paragraphs.select("h", "g", "text").join(wanted, "h", "left_semi"), "texts")
    texts = texts.groupBy("h", "g").agg(F.first("text").alias("text"))
    clusters = materialize(connected_components(link_bands(materialize(meet.join(texts, "h"), "bands"), min_jaccard, most)), "clusters")
    clusters = clusters.select(F.col("node.h").alias("h"), F.col("node.g").alias("g"), F.col("component.h").alias("ch"), F.col("component.g").alias("cg"))

    def spread(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.min("r0").alias("r0"), F.max("r1").alias("r1")).where("r0 != r1").select(*by)

    numbers = paragraphs.drop("text")
    nodes = numbers.groupBy("h", "g").agg(F.min("rid").alias("r0"), F.max("rid").alias("r1")).join(clusters, ["h", "g"], "left")
    nodes = materialize(nodes.select("h", "g", F.coalesce("ch", "h").alias("ch"), F.coalesce("cg", "g").alias("cg"), "r0", "r1"), "nodes")
    # tables of their own, so that adaptive execution can split a hot paragraph's join
    labelled = materialize(nodes.join(spread(nodes, "ch", "cg"), ["ch", "cg"]).select("h", "g", "ch", "cg"), "labelled")
    columns = ["rid", "doc_id", "start", "length", "at", "n_words", "ch", "cg", "wide"]
    found = numbers.join(labelled, ["h", "g"]).withColumn("wide", F.lit(False)).select(*columns)
    told = arrow_parts(wide.drop("text"), _told, schema.replace("text binary", "slot long, known boolean"))
    w = W.partitionBy("h", "g", "slot")
    told = told.withColumn("shared", F.col("known") | (F.min("rid").over(w) != F.max("rid").over(w))).where("shared")
    found = found.unionByName(told.select(*columns[:6], F.col("h").alias("ch"), F.col("g").alias("cg"), F.lit(True).alias("wide")))
    return _reported(_stretches(found, min_words))


def _stretches(found: DataFrame, gap: int) -> DataFrame:
    """The repeated units with the number of words of the stretch that each lies in."""
    by = W.partitionBy("rid").orderBy("at", "n_words", "wide", "ch")
    end = F.col("at") + F.col("n_words")
    before = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    cut = found.withColumn("new", F.when(F.col("at") >= before + gap, 1).otherwise(0))
    cut = cut.withColumn("stretch", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = W.partitionBy("rid", "stretch")
    return cut.withColumn("stretch_words", F.max(end).over(whole) - F.min("at").over(whole)).drop("new", "stretch")


def _reported(found: DataFrame) -> DataFrame:
    """The units as result rows: paragraphs, and windows that touch no paragraph in some document."""
    end = F.col("at") + F.col("n_words")
    order = [F.col("at"), F.col("wide").cast("int")]
    up = W.partitionBy("rid").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy("rid").orderBy(F.desc("at"), F.desc("wide")).rowsBetween(W.unboundedPreceding, W.currentRow)
    narrow = F.when(~F.col("wide"), end), F.when(~F.col("wide"), F.col("at"))
    spans = found.withColumn("before", F.max(narrow[0]).over(up)).withColumn("next", F.min(narrow[1]).over(down))
    free = F.col("wide") & F.coalesce(F.col("before") <= F.col("at"), F.lit(True)) & F.coalesce(F.col("next") >= end, F.lit(True))
    rows = materialize(spans.withColumn("free", free).drop("before", "next"), "repeats")
    groups = rows.groupBy("ch", "cg", "wide").agg(F.count("*").alias("component_size"), F.min("rid").alias("r0"), F.max("rid").alias("r1"), F.min(F.struct("doc_id", "rid", "start")).alias("first"), F.max("free").alias("free"))
    groups = materialize(groups.where("r0 != r1 and (free or not wide)").drop("r0", "r1", "free"), "groups")
    out = rows.drop("free").join(groups, ["ch", "cg", "wide"])
    stays = (F.col("rid") == F.col("first.rid")) & (F.col("start") == F.col("first.start"))
    name = F.concat(F.lpad(F.hex("ch"), 16, "0"), F.lpad(F.hex("cg"), 16, "0"))
    return out.select("rid", "doc_id", "start", "length", "n_words", "stretch_words", F.lower(name).alias("component_id"), "component_size", (~stays).alias("removed"))
