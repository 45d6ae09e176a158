"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to character n-grams, the longest
order first: of the first order that knows any of its n-grams, those score; if none does, the word says nothing.

*Training* counts every word of every training row: each partition counts first, counts are summed by (language, word),
and n-grams are counted from the summed words. Whatever was counted is known, however rare. A language that doesn't have
a word or n-gram gets a share below any that was counted: a tenth of one in the largest language's total.

*Prediction* reads the text alone. While the model has at most MAX_NUMBERS numbers, it is broadcast and texts are scored
where they are read. Beyond that only its head is: the words with the largest shares, about as many as that bound admits,
and in any case those with a share of at least MIN_SHARE in some language, 1 / MIN_SHARE of each language at most. A
text's other words are counted and joined with the whole model, sharded by word, and those that are unseen with its
n-grams. Both ways give the same scores.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_parts, free_name, materialize, numbered

#: Numbers of a model that may be broadcast, 4 bytes each.
MAX_NUMBERS = 24_000_000
MIN_SHARE = 1e-5
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Entries after which a partition's counts are passed on, and remembered words before they are forgotten.
_FLUSH, _REMEMBER = 200_000, 200_000
#: Texts whose new words are scored together.
_TOGETHER = 128


def _words_of(counts: Counter) -> Counter:
    """Counts of raw tokens to counts of lower-cased letter runs."""
    out: Counter = Counter()
    for token, n in counts.items():
        for word in _LETTERS.findall(token.lower()):
            out[word] += n
    return out


def _rows(found: dict[str, Counter]) -> pa.RecordBatch:
    langs, keys, ns = [], [], []
    for lang, counts in found.items():
        langs += [lang] * len(counts)
        keys += counts.keys()
        ns += counts.values()
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(ns, pa.int64())], ["lang", "key", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found[lang].update(text.as_py().split())
            if sum(map(len, found.values())) > _FLUSH:
                yield _rows({k: _words_of(v) for k, v in found.items()})
                found.clear()
    if found:
        yield _rows({k: _words_of(v) for k, v in found.items()})


def ngrams(word: str, order: int) -> list[str]:
    """The n-grams of one order, with a space at each end of the word (single characters: without)."""
    padded = f" {word} " if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            counts = found[lang]
            for order in ORDERS:
                for gram in ngrams(word, order):
                    counts[gram] += n
        if sum(map(len, found.values())) > _FLUSH:
            yield _rows(found)
            found.clear()
    if found:
        yield _rows(found)


@dataclass
class Model:
    """table has kind (0: words, else the order of n-grams), key, share (the largest among the languages) and row (log
    shares of the languages among each other)."""

    langs: list[str]
    table: DataFrame


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """docs -> the whole model. Rows with a null text or language teach nothing; without any row it knows nothing."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    schema = "lang string, key string, n long"
    words = materialize(arrow_parts(rows, _count_words, schema).groupBy("lang", "key").agg(F.sum("n").alias("n")), "words")
    grams = materialize(arrow_parts(words, _count_ngrams, schema).groupBy("lang", "key").agg(F.sum("n").alias("n")), "grams")
    counts = words.withColumn("kind", F.lit(0)).unionByName(grams.withColumn("kind", F.length("key")))
    totals = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}  # a row a language and kind
    langs = sorted({x for x, _ in totals})
    if not langs:
        return Model([], docs.sparkSession.createDataFrame([], "kind int, key string, share double, row array<double>"))
    of = lambda name: F.create_map(*[F.lit(x) for k in (0, *ORDERS) for x in (k, float(totals.get((name, k), 1)))])[F.col("kind")]
    floor = F.create_map(*[F.lit(x) for k in (0, *ORDERS) for x in (k, 0.1 / max(totals.get((x, k), 1) for x in langs))])[F.col("kind")]
    wide = counts.groupBy("kind", "key").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n{i}") for i, x in enumerate(langs)])
    shares = wide.select("kind", "key", F.array(*[F.coalesce(F.col(f"n{i}") / of(x), floor) for i, x in enumerate(langs)]).alias("shares"))
    total = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x)
    # to log shares among the languages
    table = shares.select("kind", "key", F.array_max("shares").alias("share"), F.transform("shares", lambda x: F.log(x / total)).alias("row"))
    return Model(langs, materialize(table, "shares"))


def _hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


class Entries:
    """Rows of scores by a 64-bit key."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of those that are there, their rows)"""
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), self.rows[:0]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = np.flatnonzero(self.keys[at] == keys)
        return there, self.rows[at[there]]


def _collect(model: Model, rows: DataFrame) -> dict[int, Entries]:
    """The entries of some rows of the model's table; their number is checked by the caller."""
    width = len(model.langs)
    key = F.when(F.col("kind") > 0, F.col("key")).alias("key")
    found = rows.select("kind", key, F.xxhash64("key").alias("h"), *[F.col("row")[i].cast("float").alias(f"r{i}") for i in range(width)]).toArrow()
    kinds, out = found["kind"].to_numpy(), {}
    hashes = found["h"].to_numpy().view(np.uint64)
    scores = np.stack([found[f"r{i}"].to_numpy() for i in range(width)], axis=1) if width else np.zeros((len(kinds), 0), np.float32)
    for kind in (0, *ORDERS):
        at = np.flatnonzero(kinds == kind)
        if kind:
            keys = np.array([_gram_keys(_codes(g), kind)[0] for g in found["key"].take(pa.array(at)).to_pylist()], np.uint64)
        else:
            keys = hashes[at]
        out[kind] = Entries(keys, scores[at])
    return out


def _gram_keys(codes: np.ndarray, order: int) -> np.ndarray:
    """A number for the gram at each place (the last few places run over the end)."""
    out = np.zeros(max(0, len(codes) - order + 1), np.uint64)
    for k in range(order):
        out = (out ^ codes[k : len(codes) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def has_letter(text: str) -> bool:
    """Whether any character is a letter; other word characters, such as superscripts, aren't."""
    found = _LETTERS.search(text)
    return found is not None and (found[0][0].isalpha() or any(c.isalpha() for c in text))


class Predictor:
    """Scores texts by collected entries; words that are new to it are scored together, on arrays."""

    def __init__(self, langs: list[str], entries: dict[int, Entries]):
        self.langs, self.entries = langs, entries
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.langs) + 1))
        self.others: dict[int, list[str]] = {}

    def _back_off(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words, and in the last column whether any n-gram is known."""
        out = np.zeros((len(words), len(self.langs) + 1))
        left = np.arange(len(words))
        for order in ORDERS:
            entries = self.entries[order]
            if not len(left) or not len(entries.keys):
                continue
            pad = " " if order > 1 else ""
            parts = [f"{pad}{words[i]}{pad}" for i in left]
            lengths = np.array([len(p) for p in parts])
            found = _gram_keys(_codes("".join(parts)), order)
            owner = np.repeat(np.arange(len(parts)), lengths)[: len(found)]
            ends = np.repeat(np.cumsum(lengths), lengths)[: len(found)]
            inside = np.flatnonzero(np.arange(len(found)) + order <= ends)
            there, rows = entries.find(found[inside])
            if len(there):
                who = owner[inside[there]]
                n = np.bincount(who, minlength=len(parts))
                sums = np.stack([np.bincount(who, rows[:, k], len(parts)) for k in range(len(self.langs))], axis=1)
                done = n > 0
                out[left[done], :-1] = sums[done] / n[done, None]
                out[left[done], -1] = 1.0
                left = left[~done]
        return out

    def _learn(self, tokens: list[str], back_off: bool) -> None:
        """Rows for raw tokens: their words' summed scores, and how many words scored; others: the words that didn't."""
        words, owners = [], []
        for i, token in enumerate(tokens):
            for word in _LETTERS.findall(token.lower()):
                words.append(word)
                owners.append(i)
        rows = np.zeros((len(tokens), len(self.langs) + 1))
        whose = np.array(owners, np.int64)
        there, scores = self.entries[0].find(_hashes(words))
        np.add.at(rows, whose[there], np.concatenate([scores, np.ones((len(there), 1))], axis=1))
        missing = np.setdiff1d(np.arange(len(words)), there)
        begin = len(self.seen) - len(tokens)
        if back_off and len(missing):
            np.add.at(rows, whose[missing], self._back_off([words[i] for i in missing]))
        elif not back_off:
            for i in missing.tolist():
                self.others.setdefault(begin + owners[i], []).append(words[i])
        end = len(self.seen)
        if end > len(self.matrix):  # room doubles, so that copying stays in proportion
            self.matrix = np.concatenate([self.matrix, np.zeros((max(end, len(self.matrix)), self.matrix.shape[1]))])
        self.matrix[begin:end] = rows

    def counted(self, texts: pa.Array, back_off: bool = True) -> Iterator[tuple[list[int], np.ndarray] | None]:
        """Numbers of a text's tokens (rows of matrix) and how often it has each; None if it has no letter.

        Only a few texts at a time are Python strings.
        """
        for begin in range(0, len(texts), _TOGETHER):
            if len(self.seen) > _REMEMBER:
                self.forget()
            out, fresh, seen = [], [], self.seen
            for text in texts.slice(begin, _TOGETHER).to_pylist():
                if text is None or not self.langs or not has_letter(text):
                    out.append(None)
                    continue
                counts = Counter(text.split())
                for token in counts:
                    if token not in seen:
                        seen[token] = len(seen)
                        fresh.append(token)
                out.append(([seen[token] for token in counts], np.fromiter(counts.values(), np.float64, len(counts))))
            if fresh:
                self._learn(fresh, back_off)
            yield from out

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        out = []
        for one in self.counted(texts):
            if one is None:
                out.append((UNKNOWN, 0.0))
                continue
            *totals, n = (one[1] @ self.matrix[one[0]]).tolist()
            best = max(range(len(totals)), key=lambda i: totals[i])  # of equals the first language by code point
            sharp = min(n, 20.0) / max(n, 1.0)
            out.append((self.langs[best], 1.0 / sum(exp((x - totals[best]) * sharp) for x in totals)))
        return out


def _fields(docs: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}, " for c in keep)


def _head(model: Model, max_numbers: int) -> DataFrame:
    """The words with the largest shares, about as many as max_numbers admits; rarer ones of one share stay out together."""
    words = model.table.where("kind = 0")
    spare = max(0.0, 1 - max_numbers / (len(model.langs) + 2) / max(1, words.count()))
    cut = words.agg(F.percentile_approx("share", spare, 10_000)).first()[0] or 0.0
    return words.where((F.col("share") > cut) | (F.col("share") >= MIN_SHARE))


def _unheaded(docs: DataFrame, model: Model, text: str, keep: list[str], names: tuple[str, str], max_numbers: int) -> DataFrame:
    """predict() for a model that is too large to be broadcast."""
    langs, k = model.langs, range(len(model.langs))
    shared = docs.sparkSession.sparkContext.broadcast(_collect(model, _head(model, max_numbers)))
    own = ["rid", "letter", "n", "sums", "w", "c"]
    free = dict(zip(own, (free_name(docs.select(*keep), f"_{x}") for x in own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Entries(np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))
        predictor = Predictor(langs, dict.fromkeys(ORDERS, empty) | {0: shared.value[0]})
        for batch in batches:
            out: tuple = ([], [], [], [], [])
            for one in predictor.counted(batch.column(0), back_off=False):
                *sums, n = (one[1] @ predictor.matrix[one[0]]).tolist() if one else [0.0] * (len(langs) + 1)
                rest: Counter = Counter()
                for token, times in zip(*one) if one else ():
                    for word in predictor.others.get(token, ()):
                        rest[word] += int(times)
                for x, v in zip(out, (one is not None, n, sums, list(rest), list(rest.values()))):
                    x.append(v)
            kinds = (pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x, t) for x, t in zip(out, kinds))], [*keep, free["rid"], *(free[x] for x in own[1:])])

    schema = _fields(docs, keep) + ", ".join(f"{free[x]} {t}" for x, t in zip(own, ("long", "boolean", "double", "array<double>", "array<string>", "array<long>")))
    rows = docs.select(F.col(text), *[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias(free["rid"]))
    heads = materialize(rows.mapInArrow(run, schema), "heads")
    tail = heads.select(F.col(free["rid"]).alias("rid"), F.explode(F.arrays_zip(F.col(free["w"]).alias("w"), F.col(free["c"]).alias("c"))).alias("x")).select("rid", "x.w", "x.c")
    spread = [F.col("row")[i].cast("float").cast("double").alias(f"r{i}") for i in k]
    # a number stands for the word where its n-grams go, as a word may be as long as a text
    met = numbered(tail.select("w").distinct().join(model.table.where("kind = 0").select(F.col("key").alias("w"), *spread), "w", "left"), "wid", "tailwords")
    unseen = met.where("r0 is null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wid, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for order in ORDERS:
                    if counts := Counter(ngrams(word, order)):
                        rows = len(counts)
                        yield pa.RecordBatch.from_arrays([pa.array([wid] * rows), pa.array([order] * rows, pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["wid", "kind", "key", "m"])

    asked = arrow_parts(unseen.select("wid", "w"), cut, "wid long, kind int, key string, m long")
    scored = asked.join(model.table.where("kind > 0").select("kind", "key", *spread), ["kind", "key"])
    scored = scored.groupBy("wid", "kind").agg(*[(F.sum(F.col("m") * F.col(f"r{i}")) / F.sum("m")).alias(f"r{i}") for i in k])
    backed = scored.groupBy("wid").agg(F.max_by(F.struct(*[f"r{i}" for i in k]), "kind").alias("r")).select("wid", *[F.col(f"r.r{i}").alias(f"r{i}") for i in k])
    backed = unseen.select("w", "wid").join(backed, "wid").drop("wid")
    values = materialize(met.where("r0 is not null").drop("wid").unionByName(backed), "tailvalues")
    rest = tail.join(values, "w").groupBy(F.col("rid").alias(free["rid"])).agg(F.sum("c").alias("_m"), *[F.sum(F.col("c") * F.col(f"r{i}")).alias(f"_s{i}") for i in k])
    rest = rest.select(free["rid"], F.struct("_m", *[f"_s{i}" for i in k]).alias(free["w"]))
    both = heads.drop(free["w"], free["c"]).join(rest, free["rid"], "left")
    more = F.col(free["w"])
    totals = F.array(*[F.col(free["sums"])[i] + F.coalesce(more[f"_s{i}"], F.lit(0.0)) for i in k])
    n = F.col(free["n"]) + F.coalesce(more["_m"], F.lit(0))
    best, letter = F.array_max(totals), F.col(free["letter"])
    sharp = F.least(n, F.lit(20.0)) / F.greatest(n, F.lit(1.0))
    name = F.element_at(F.array(*map(F.lit, langs)), F.array_position(totals, best).cast("int"))
    share = 1.0 / F.aggregate(F.transform(totals, lambda x: F.exp((x - best) * sharp)), F.lit(0.0), lambda s, x: s + x)
    return both.select(*[F.col(f"`{c}`") for c in keep], F.when(letter, name).otherwise(UNKNOWN).alias(names[0]), F.when(letter, share).otherwise(0.0).alias(names[1]))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"), max_numbers: int = MAX_NUMBERS) -> DataFrame:
    """docs -> the columns in keep, then lang_pred and score (0 to 1, the share of the best language), by these names.

    A null text, one without a letter, and any text under an empty model give ``und`` with score 0. A text none of whose
    words says anything gets the first language with an even share. Ties go to the first language by code point. Texts
    are read whole, one at a time. Repeated rows keep a row each, an empty table gives none. names must not be in keep.
    """
    keep = keep or []
    if model.langs and model.table.count() * (len(model.langs) + 2) > max_numbers:
        return _unheaded(docs, model, text, keep, names, max_numbers)
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast(_collect(model, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(langs, shared.value)
        for batch in batches:
            found = predictor.predict(batch.column(0))
            columns = [*batch.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return docs.select(F.col(text), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, _fields(docs, keep) + f"{names[0]} string, {names[1]} double")


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, max_numbers: int = MAX_NUMBERS) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score, learned from the rows that aren't held out.

    One row for each input row. A null doc_id isn't held out. Nulls, empty and long texts, ties and empty tables: see
    learn and predict. Other columns aren't read.
    """
    model = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["doc_id", "held_out"], max_numbers=max_numbers)


def keep_identified(docs: DataFrame, min_score: float = 0.5, max_numbers: int = MAX_NUMBERS) -> DataFrame:
    """The rows of docs whose language is identified with a score of at least min_score, with all their columns.

    Columns may have any names. Texts that are null or have no letter go. See predict for the other cases.
    """
    model = learn(docs.where(~held_out()))
    lang, score = names = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = predict(docs, model, keep=docs.columns, names=names, max_numbers=max_numbers)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).drop(*names)
