"""Benchmark decontamination by template windows.

A text becomes a template: lower-cased words, with numbers (digits or number words), names (a list) and units after
numbers replaced by typed placeholders; what they stood for are the slots. Windows of WINDOW template tokens are hashed.

1. *Candidates.* An item is filed under its rarest windows, half of its different ones and one more: a document that
   shares half of an item's windows shares one of these, while a phrase that most items have files none of them, so
   that a common phrase doesn't bring every document together with every item.
2. *Verification.* A candidate's template is laid over the item's along each diagonal (position in the document less
   position in the item) on which they share a window. A token agrees if it is the same, if both are placeholders of one
   type, or if it is a name by its form: both are capitalised, or the item has a listed name there. Forms count while
   they stand for few different words (one, and one more for each 8 tokens of the item). Slots must be consistent:
   a value of the item becomes the same value of the document all along a diagonal; where it doesn't, the value that most
   places have counts, and the windows at the others don't. Windows in which all tokens kept their values always count.
3. A document whose diagonals cover MIN_COVER of an item's windows holds the item: verbatim if the windows in which all
   tokens kept their values do so by themselves, else re-parameterised.

Items of 3 or 4 tokens are one window, and items of 1 or 2 tokens are held by documents that consist of them alone; both
only verbatim, as any sentence could be a re-parameterised form of so little.

Known misses: copies whose swapped words (names that aren't listed, in lower case on either side) leave less than half
of the windows whole, and copies with more than MIN_COVER spares cut out.

While the benchmark is small (its size is checked), its index is broadcast, and one pass over the documents does it all
without a shuffle. Beyond that, windows meet the index in a hash join, and candidates fetch their texts. Both ways share
the code that decides and give the same rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import arrow_parts, arrow_rows, free_name, materialize, numbered

WINDOW, MIN_COVER = 5, 0.8
#: Items with fewer tokens are held only by documents that consist of them.
MIN_TOKENS = 3
#: Windows, words and (divided by 8) characters of a benchmark that may be broadcast.
MAX_BROADCAST = 2_000_000
#: Scripts without spaces: each character is a token.
_DENSE = r"぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_DENSE}]|[^\W\d_{_DENSE}]+|\d+(?:[.,]\d+)*")
# Given names, units that may follow a number, and number words.
NAMES = frozenset("alice anna bob carlos carol charlie chloe daniel david diego elena emily emma eva george hannah hans henry isabel ivan jack james jane john jorge juan julia kate laura liam lisa lucas lucy luis maria marie martin mary michael miguel mike noah nora olivia pablo paul pedro peter pierre robert rosa sam sarah sofia sophie susan thomas tom".split())
UNITS = frozenset("km m cm mm mi miles mile meters meter metres metre feet foot inches inch kg g mg lb lbs pounds pound grams gram tons ton l ml liters liter litres litre gallons gallon h hr hrs hours hour minutes minute min seconds second days day weeks week months month years year dollars dollar cents cent euros euro eur usd percent degrees degree kmh mph watts volts".split())
NUMBERS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dos tres cuatro cinco seis siete ocho nueve diez doce trece veinte treinta cuarenta cincuenta cien mil deux trois quatre cinq sept huit neuf dix onze douze treize vingt trente quarante cinquante mille zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend".split())
_NUMBER, _NAME, _UNIT = 1, 2, 3


class Ids(dict):
    """Words to ids: numbers and names have their placeholder's; a word without an id has its hash, or 0 if closed."""

    def __init__(self, words: list[str] | None):
        super().__init__()
        self.open = True
        for word in words or []:
            self[word] = self[word]
        self.update(dict.fromkeys(NAMES, _NAME) | dict.fromkeys(NUMBERS, _NUMBER))
        self.open = words is None

    def __missing__(self, word: str) -> int:
        if word[0].isdigit():
            return _NUMBER
        if not self.open:
            return 0
        from xxhash import xxh64_intdigest

        return (xxh64_intdigest(word, 42) >> 2) | 4


def template(text: str, ids: Ids) -> tuple[np.ndarray, list[str]]:
    """Ids of the template tokens (0: a word that closed ids don't have) and the raw tokens, lower-cased."""
    raw = _TOKEN.findall(text.lower())
    found = np.fromiter(map(ids.__getitem__, raw), np.int64, len(raw))
    if len(raw) > 1:
        after = np.flatnonzero(found == _NUMBER) + 1
        found[[i for i in after if i < len(raw) and raw[i] in UNITS]] = _UNIT
    return found, raw


def capitals(text: str, n: int) -> np.ndarray:
    """Which of the n tokens are capitalised; none if lower-casing changes how the text is cut."""
    raw = _TOKEN.findall(text)
    return np.fromiter((t[0].isupper() for t in raw), bool, n) if len(raw) == n else np.zeros(n, bool)


def window_hashes(found: np.ndarray, window: int) -> np.ndarray:
    """A hash of each window, by position; windows of other sizes have other hashes."""
    n = len(found) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = np.full(n, window, np.uint64)
    for k in range(window):
        out = (out ^ found[k : k + n].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


class Item:
    """A benchmark item, ready to be laid over documents."""

    def __init__(self, text: str, ids: Ids, window: int):
        self.ids, self.raw = template(text, ids)
        self.capital = capitals(text, len(self.raw))
        self.size = min(window, len(self.raw))
        self.whole = len(self.raw) < MIN_TOKENS
        self.verbatim_only = len(self.raw) < window
        self.hashes = window_hashes(self.ids, self.size) if self.raw else np.zeros(0, np.int64)


def _consistent(item: list[str], doc: list[str], slots: list[int]) -> list[int]:
    """The slots whose value isn't the one that most places of the item's value have (of equals the first by code point)."""
    held: dict[str, Counter] = defaultdict(Counter)
    for i in slots:
        held[item[i]][doc[i]] += 1
    best = {value: min(c, key=lambda x: (-c[x], x)) for value, c in held.items()}
    return [i for i in slots if doc[i] != best[item[i]]]


def cover(item: Item, found: np.ndarray, raw: list[str], capital: np.ndarray, diagonals: np.ndarray) -> tuple[float, float]:
    """Share of the item's windows that these diagonals of a document cover, and the share they cover verbatim."""
    m, n, w = len(item.raw), len(raw), item.size
    if not m or (item.whole and n != m):
        return 0.0, 0.0
    codes: dict[str, int] = {}
    a = np.fromiter((codes.setdefault(x, len(codes)) for x in item.raw), np.int64, m)
    b = np.fromiter((codes.get(x, -1) for x in raw), np.int64, n)
    covered, kept = np.zeros(m - w + 1, bool), np.zeros(m - w + 1, bool)

    def windows(ok: np.ndarray) -> np.ndarray:
        sums = np.cumsum(np.pad(ok.astype(np.int32), ((0, 0), (1, 0))), axis=1)
        return sums[:, w:] - sums[:, :-w] == w

    most = 1 + m // 8
    for part in np.array_split(diagonals, max(1, len(diagonals) * m // 500_000)):
        at = part[:, None] + np.arange(m)
        inside = (at >= 0) & (at < n)
        at = np.where(inside, at, 0)
        equal = inside & (b[at] == a)
        kept |= windows(equal).any(axis=0)
        if item.verbatim_only:
            continue
        typed = inside & ~equal & (found[at] == item.ids) & (item.ids > 0) & (item.ids < 4)
        word = (found[at] == 0) | (found[at] >= 4) | (found[at] == _NAME)
        form = inside & ~equal & ~typed & word & (((item.ids >= 4) & item.capital & capital[at]) | (item.ids == _NAME))
        for row in np.flatnonzero(form.any(axis=1)):
            if len({item.raw[i] for i in np.flatnonzero(form[row])}) > most:
                form[row] = False
        slot = inside & ((item.ids < 4) & (equal | typed) | form | equal & item.capital)
        ok = equal | typed | form
        for row in np.flatnonzero((typed | form).any(axis=1)):
            doc = [raw[j] for j in at[row]]
            ok[row, _consistent(item.raw, doc, np.flatnonzero(slot[row]).tolist())] = False
        covered |= windows(ok).any(axis=0)
    covered |= kept
    return float(covered.mean()), float(kept.mean())


def compare(item: Item, text: str, found: np.ndarray, raw: list[str], hashes: np.ndarray | None = None) -> tuple[float, float]:
    """cover() along all diagonals on which the item and a document share a window; hashes: the document's windows."""
    if hashes is None:
        hashes = window_hashes(found, item.size)
    if not len(hashes) or not len(item.hashes):
        return 0.0, 0.0
    values, group = np.unique(item.hashes, return_inverse=True)
    where = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
    at = np.flatnonzero(values[where] == hashes)
    of = [np.flatnonzero(group == k) for k in range(len(values))]
    spots = [at[where[at] == k][:, None] - of[k] for k in np.unique(where[at])]
    if not spots:
        return 0.0, 0.0
    return cover(item, found, raw, capitals(text, len(raw)), np.unique(np.concatenate([x.reshape(-1) for x in spots])))


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """items (item_id, text) -> item_id, h, size, k: the windows it is filed under, and their sizes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = Ids(None), ([], [], [])
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            item = Item(text.as_py(), ids, window) if text.is_valid else None
            for h in np.unique(item.hashes).tolist() if item else []:
                out[0].append(key)
                out[1].append(h)
                out[2].append(item.size)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item_id", "h", "size"])

    rows = arrow_rows(items, work, "item_id long, h long, size long").distinct()
    common = rows.groupBy("h").agg(F.count("*").alias("common"))
    by = W.partitionBy("item_id")
    ranked = rows.join(common, "h").withColumn("rank", F.row_number().over(by.orderBy("common", "h"))).withColumn("n", F.count("*").over(by))
    return ranked.where(F.col("rank") <= F.floor(F.col("n") / 2) + 1).select("item_id", "h", "size")


def _words(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(1) if t.is_valid for w in _TOKEN.findall(t.as_py().lower())}), pa.string())], ["w"])


def _sizes(found: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """The hashes of a document's windows, by size; those too short to be searched for only of the whole document."""
    for size in sizes:
        if size >= MIN_TOKENS or size == len(found):
            yield window_hashes(found, size)


class Index:
    """A benchmark that is small enough to be broadcast."""

    def __init__(self, items: list[tuple], filed: pa.Table, words: list[str], window: int):
        self.ids = Ids([w for w in words if w not in NAMES and w not in NUMBERS and not w[0].isdigit()])
        self.names = [key for key, _ in items]
        self.items = [Item(text, self.ids, window) for _, text in items]
        order = np.argsort(filed["h"].to_numpy(), kind="stable")
        at: dict = {}
        for i, key in enumerate(self.names):
            at.setdefault(key, []).append(i)
        self.at = at
        self.h, self.key = filed["h"].to_numpy()[order], [filed["item_id"][int(i)].as_py() for i in order]
        self.wanted = np.unique(self.h)
        self.sizes = sorted(set(filed["size"].to_pylist()))

    def held(self, text: str) -> list[tuple]:
        """(item_id, cover, verbatim cover) of the items that a text may hold."""
        if not len(self.wanted):
            return []
        found, raw = template(text, self.ids)
        chosen: set = set()
        for hashes in _sizes(found, self.sizes):
            where = np.minimum(np.searchsorted(self.wanted, hashes), len(self.wanted) - 1)
            for h in np.unique(hashes[self.wanted[where] == hashes]):
                chosen.update(self.key[np.searchsorted(self.h, h) : np.searchsorted(self.h, h, "right")])
        out = []
        by_size: dict[int, np.ndarray] = {}
        for key in sorted(chosen):
            for i in self.at[key]:
                item = self.items[i]
                if item.size not in by_size:
                    by_size[item.size] = window_hashes(found, item.size)
                out.append((key, *compare(item, text, found, raw, by_size[item.size])))
        return out


def _prepare(benchmark: DataFrame, item_text: str, item_id: str, window: int, max_broadcast: int) -> tuple[DataFrame, DataFrame, Index | None]:
    """(items, their filed windows, the index if it may be broadcast)"""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null and item_id is not null")
    filed = materialize(_item_windows(items, window), "filed")
    words = arrow_rows(items, _words, "w string").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > 8 * max_broadcast or filed.count() > max_broadcast or words.count() > max_broadcast:
        return items, filed, None
    texts = items.toArrow()
    return items, filed, Index(list(zip(texts["item_id"].to_pylist(), texts["text"].to_pylist())), filed.toArrow(), words.toArrow()["w"].to_pylist(), window)


def _joined(rows: DataFrame, rid: str, text: str, items: DataFrame, filed: DataFrame, window: int, min_cover: float) -> DataFrame:
    """rid, item_id, cover, verbatim by joins; rows is a table with row ids."""
    sizes = sorted(r["size"] for r in filed.select("size").distinct().collect())  # window sizes: 1 to WINDOW

    def ours(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys, found = Ids(None), [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text.is_valid:
                for hashes in _sizes(template(text.as_py(), ids)[0], sizes):
                    found.append(np.unique(hashes))
                    keys.append(np.full(len(found[-1]), key))
        flat = (lambda x: np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(flat(keys)), pa.array(flat(found))], ["rid", "h"])

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = Ids(None), ([], [], [], [])
        for rid, key, text, item in zip(*(batch.column(i).to_pylist() for i in range(4))):
            share, kept = compare(Item(item, ids, window), text, *template(text, ids))
            if share >= min_cover:
                for x, v in zip(out, (rid, key, share, kept >= min_cover)):
                    x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["rid", "item_id", "cover", "verbatim"])

    texts = rows.select(F.col(rid).alias("rid"), F.col(text).alias("text"))
    pairs = arrow_rows(texts, ours, "rid long, h long").join(filed.select("h", "item_id"), "h").select("rid", "item_id").distinct()
    pairs = pairs.join(texts, "rid").join(items.select("item_id", F.col("text").alias("item")), "item_id")
    return arrow_rows(pairs.select("rid", "item_id", "text", "item"), verify, "rid long, item_id long, cover double, verbatim boolean").groupBy("rid", "item_id").agg(F.max("cover").alias("cover"), F.max("verbatim").alias("verbatim"))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, min_cover: float = MIN_COVER, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document and item it holds: rid (its row id), doc_id, item_id, cover, verbatim.

    Null and empty texts hold nothing, and items without a text, an id or a token aren't held. Whole texts are read, one
    at a time, however long. Repeated documents have rows of their own; of items with one id the best cover counts.
    Documents without a row are clean; an empty table of either kind gives none. Other columns aren't read.
    """
    items, filed, index = _prepare(benchmark, item_text, item_id, window, max_broadcast)
    if index is None:
        rows = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "rid")
        found = _joined(rows, "rid", "text", items, filed, window, min_cover)
        return found.join(rows.select("rid", "doc_id"), "rid").select("rid", "doc_id", "item_id", "cover", "verbatim")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple = ([], [], [], [])
        for row, value in enumerate(batch.column(2)):
            best: dict = {}
            for key, share, kept in shared.value.held(value.as_py()) if value.is_valid else []:
                had = best.get(key, (0.0, 0.0))
                best[key] = (max(share, had[0]), max(kept, had[1]))
            for key, (share, kept) in best.items():
                if share >= min_cover:
                    for x, v in zip(out, (row, key, share, kept >= min_cover)):
                        x.append(v)
        at = pa.array(out[0], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.bool_())], ["rid", "doc_id", "item_id", "cover", "verbatim"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_rows(rows, work, "rid long, doc_id long, item_id long, cover double, verbatim boolean")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, min_cover: float = MIN_COVER, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever these are called.

    Rules for nulls, empty and long texts and empty tables: see leaks. With a broadcast index rows are told on the spot;
    else both sides of a join read their row ids from one numbered table (see common.numbered).
    """
    items, filed, index = _prepare(benchmark, item_text, item_id, window, max_broadcast)
    if index is None:
        rid = free_name(docs, "rid")
        rows = numbered(docs, rid)
        held = _joined(rows, rid, text, items, filed, window, min_cover).select(F.col("rid").alias(rid)).distinct()
        return rows.join(held, rid, "left_anti").drop(rid)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = [c.lower() for c in docs.columns].index(text.lower())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [not (t.is_valid and any(x[1] >= min_cover for x in shared.value.held(t.as_py()))) for t in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return arrow_parts(docs, clean, docs.schema)
