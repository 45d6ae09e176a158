"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (UTF-16 units) with ORDER = 4, so a gram is exactly one 64-bit number.

*Training* counts the trusted documents (labelled of good quality and not toxic) but a fifth of them, chosen by a checksum
of doc_id, which is held out: each partition counts first, then counts are summed by gram. Lower orders use continuation counts; discounts come from the counts of counts (Chen and
Goodman). Probabilities come from joining counts, contexts and the next lower order, sharded by gram and context.

*Scoring* looks up all grams of every document in the whole model. While that has MAX_ENTRIES at most, it is broadcast and
texts are scored where they are read. Beyond that only its head is: grams of the highest order that make up at least
MIN_SHARE of its counts, hence 1 / MIN_SHARE at most. All others are counted by document and word, and joins by gram and
context give their probabilities, or the back-off weights and lower orders of grams the model doesn't have. Both ways
give the same scores; broadcasts only save shuffling.

*Thresholds* are the UPPER and WORD_UPPER quantiles, over each language's held-out trusted documents, of two numbers: the perplexity of
the whole document, and that of its worst word, which a good document with a few foreign or abusive words in it doesn't
hide in its mean. A document above either threshold of its language goes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_parts, free_name, materialize

ORDER, UNIT = 4, 16
MIN_SHARE = 1e-6
#: Grams and contexts of a model that may be broadcast whole (16 bytes each).
MAX_ENTRIES = 4_000_000
#: Quantiles of documents' perplexities and of their worst words'.
UPPER, WORD_UPPER = 0.99, 0.995
#: A word's units count with the one after it; shorter words don't count by themselves.
WORD_UNITS = 3
#: One in so many trusted documents is held out, and a language with fewer held-out ones takes all its trusted ones.
HELD, MIN_HELD = 5, 20
#: Trusted ids that may be broadcast to the scan of the texts (8 bytes each).
MAX_BROADCAST = 4_000_000
_CHUNK = 1 << 20


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of some texts, each preceded by ORDER - 1 zeros, and how many each text has."""
    pad = "\0" * (ORDER - 1)
    units = [len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts]
    at = np.frombuffer("".join(pad + t for t in texts).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    out = np.zeros(max(0, len(at) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(UNIT)) | at[k : len(at) - ORDER + 1 + k]
    real = np.ones(len(out), bool)  # a window that ends in the padding of the next text isn't a gram
    starts = np.cumsum([n + ORDER - 1 for n in units])[:-1]
    for k in range(ORDER - 1):
        at_k = starts - ORDER + 1 + k
        real[at_k[(at_k >= 0) & (at_k < len(out))]] = False
    return out[real], np.array(units, np.int64)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about _CHUNK characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > _CHUNK:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in _chunks([x.as_py() or "" for x in batch.column(0)]):
            found, n = np.unique(grams(run)[0], return_counts=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "c"])


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of an order."""
    n = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), out)]


def _low(g: Column, order: int) -> Column:
    """The gram without its first unit, as a gram of one order less."""
    return g.bitwiseAND(F.lit((1 << UNIT * (order - 1)) - 1))


def _context(g: Column, order: int) -> Column:
    """The gram without its last unit; all grams of order 1 have one context."""
    return F.shiftrightunsigned(g, UNIT) if order > 1 else F.lit(0).cast("long")


def learn(trusted: DataFrame, text: str = "text") -> dict[tuple[str, int], DataFrame]:
    """trusted -> the whole model (null and empty texts teach nothing, an empty table gives empty tables): per order, ("p", k) has grams and ("w", k) contexts: g, c (counts), v (log probability
    or log back-off weight)."""
    counts = {ORDER: materialize(arrow_parts(trusted.select(text), _count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = materialize(counts[k + 1].groupBy(_low(F.col("g"), k + 1).alias("g")).agg(F.count("*").alias("c")), "grams")
    tables, lower = {}, None
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[k].select("g", "c", off.alias("d"), _context(F.col("g"), k).alias("ctx"))
        contexts = materialize(rows.groupBy("ctx").agg(F.sum("c").alias("s"), (F.sum("d") / F.sum("c")).alias("weight")), "contexts")
        joined = rows.join(contexts, "ctx")
        if lower is None:
            joined = joined.withColumn("rest", F.lit(1.0 / (1 << UNIT)))
        else:
            joined = joined.withColumn("low", _low(F.col("g"), k)).join(lower.select(F.col("g").alias("low"), F.col("p").alias("rest")), "low")
        lower = materialize(joined.select("g", "c", ((F.col("c") - F.col("d")) / F.col("s") + F.col("weight") * F.col("rest")).alias("p")), "probabilities")
        tables["p", k] = lower.select("g", "c", F.log("p").alias("v"))
        tables["w", k] = contexts.select(F.col("ctx").alias("g"), F.col("s").alias("c"), F.log("weight").alias("v"))
    return tables


def _head(table: DataFrame, min_share: float) -> tuple[np.ndarray, np.ndarray]:
    """The grams that make up at least min_share of a table's counts, sorted, with their values."""
    total = float(table.agg(F.sum("c")).first()[0] or 0)
    found = table.where(F.col("c") >= min_share * total).select("g", "v").toArrow()
    g, v = found["g"].to_numpy(), found["v"].to_numpy()
    order = np.argsort(g)
    return g[order], v[order]


def train(trusted: DataFrame, text: str = "text", min_share: float = MIN_SHARE) -> dict:
    """The heads of all tables, for perplexities(); with min_share = 0 that is the whole model, for few texts."""
    return {key: _head(table, min_share) for key, table in learn(trusted, text).items()}


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys' values, and which of the keys are there."""
    g, v = table
    if not len(g):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(g, keys), len(g) - 1)
    return v[at], g[at] == keys


def log_probabilities(model: dict, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
    """Log probabilities of grams of order k (as signed numbers), if the model's tables are whole."""
    if k == 0:
        return np.full(len(keys), -UNIT * np.log(2.0))
    out, known = _find(model["p", k], keys)
    if not known.all():
        rare = keys[~known]
        ctx = (rare.view(np.uint64) >> np.uint64(UNIT)).view(np.int64) if k > 1 else np.zeros(len(rare), np.int64)
        weight, seen = _find(model["w", k], ctx)
        low = rare & np.int64((1 << UNIT * (k - 1)) - 1)
        out[~known] = np.where(seen, weight, 0.0) + log_probabilities(model, low, k - 1)
    return out


def perplexities(model: dict, texts: list[str | None]) -> list[float | None]:
    out: list[float | None] = []
    for run in _chunks([t or "" for t in texts]):
        keys, units = grams(run)
        sums = np.concatenate([[0.0], np.cumsum(log_probabilities(model, keys.view(np.int64)), dtype=np.float64)])
        ends = np.cumsum(units)
        for a, b in zip(ends - units, ends):
            out.append(float(np.exp((sums[a] - sums[b]) / (b - a))) if b > a else None)
    return out


def _values(wanted: DataFrame, tables: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """wanted (g: distinct grams of the highest order) -> g, v: their log probabilities under the whole model."""
    out, value = wanted, F.lit(-UNIT * math.log(2.0))
    for k in range(1, ORDER + 1):
        key = _low(F.col("g"), k + 1) if k < ORDER else F.col("g")
        p = tables["p", k].select(F.col("g").alias("key"), F.col("v").alias(f"p{k}"))
        out = out.withColumn("key", key).join(F.broadcast(p) if k == 1 else p, "key", "left")  # 65,536 rows at most
        if k == 1:
            only = tables["w", 1].first()
            weight = F.lit(only["v"] if only else 0.0)
        else:
            w = tables["w", k].select(F.col("g").alias("ctx"), F.col("v").alias(f"w{k}"))
            out = out.withColumn("ctx", _context(F.col("key"), k)).join(F.broadcast(w) if k == 2 else w, "ctx", "left").drop("ctx")
            weight = F.coalesce(f"w{k}", F.lit(0.0))
        out, value = out.drop("key"), F.coalesce(F.col(f"p{k}"), weight + value)
    return out.select("g", value.alias("v"))


def _slots(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The word that each position belongs to, counted over all texts; -1 for white space but the first after a word, and
    for words of less than WORD_UNITS units."""
    unit = keys.view(np.uint64) & np.uint64((1 << UNIT) - 1)
    space = (unit == 32) | ((unit >= 9) & (unit <= 13))
    new = np.ones(len(keys), bool)
    new[1:] = row[1:] != row[:-1]
    before = np.concatenate([[True], space[:-1]]) | new
    word = np.cumsum(before & ~space) - 1
    word[space & before] = -1
    long = np.bincount(word[~space], minlength=1) >= WORD_UNITS
    return np.where((word >= 0) & long[np.maximum(word, 0)], word, -1) if len(keys) else word


def score(docs: DataFrame, tables: dict[tuple[str, int], DataFrame], text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang"), min_share: float = MIN_SHARE, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """docs -> the columns in keep, perplexity under the whole model (null for an empty or null text) and worst_word, the
    highest perplexity of any word (null if there is no word of WORD_UNITS units).

    Texts are read whole, a long one as one chunk; repeated rows keep a row each. Other columns aren't read; those in keep
    may have any name but these two.
    """
    whole = sum(t.count() for t in tables.values()) <= max_entries
    model = {key: _head(t, 0.0) for key, t in tables.items()} if whole else {("p", ORDER): _head(tables["p", ORDER], min_share)}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = ["rid", "units", "head", "worst", "s", "g", "c", "k", "p"]
    free = dict(zip(own, (free_name(docs.select(*keep), f"_{x}") for x in own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for texts in _chunks([x.as_py() or "" for x in batch.column(0)]):
                found, units = grams(texts)
                keys, row = found.view(np.int64), np.repeat(np.arange(len(units)), units)
                if whole:
                    values, known = log_probabilities(shared.value, keys), np.ones(len(keys), bool)
                else:
                    values, known = _find(shared.value["p", ORDER], keys)
                    values = np.where(known, values, 0.0)
                sums = np.bincount(row, values, len(units))
                slot = _slots(keys, row)
                size = np.bincount(slot[slot >= 0], minlength=1)
                part = np.bincount(slot[slot >= 0], values[slot >= 0], len(size))
                done = size > 0
                done[slot[~known & (slot >= 0)]] = False
                worst = np.full(len(units), np.inf)
                owner = np.zeros(len(size), np.int64)
                owner[slot[slot >= 0]] = row[slot >= 0]
                np.minimum.at(worst, owner[done], part[done] / size[done])
                row, keys, slot = row[~known], keys[~known], slot[~known]
                order = np.lexsort((keys, slot, row))
                row, keys, slot = row[order], keys[order], slot[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1]) | (slot[1:] != slot[:-1])])[: len(row)])
                cuts = pa.array(np.searchsorted(row[first], np.arange(len(units) + 1)).astype(np.int32))
                words = slot[first]
                lists = [words, keys[first], np.diff(first, append=len(row)).astype(np.int64), np.where(words >= 0, size[words], 0), np.where(words >= 0, part[words], 0.0)]
                rest = batch.slice(begin, len(texts))
                begin += len(texts)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(units), pa.array(sums, pa.float64()), pa.array(np.where(np.isinf(worst), np.nan, worst), pa.float64(), from_pandas=True), *(pa.ListArray.from_arrays(cuts, pa.array(x)) for x in lists)], [free["rid"], *keep, *(free[x] for x in own[1:])])

    kinds = dict(zip(own[1:], ("long", "double", "double", "array<long>", "array<long>", "array<long>", "array<long>", "array<double>")))
    schema = ", ".join([f"{free['rid']} long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{free[x]} {t}" for x, t in kinds.items())])
    heads = docs.select(F.col(text), F.monotonically_increasing_id().alias(free["rid"]), *keep).mapInArrow(run, schema)
    mean = F.col(free["head"]) / F.col(free["units"])
    if whole:
        return heads.select(*[F.col(f"`{c}`") for c in keep], F.when(F.col(free["units"]) > 0, F.exp(-mean)).alias("perplexity"), F.exp(-F.col(free["worst"])).alias("worst_word"))
    heads = materialize(heads, "heads")
    lists = F.arrays_zip(*[F.col(free[x]).alias(x) for x in ("s", "g", "c", "k", "p")])
    tail = heads.select(F.col(free["rid"]).alias("rid"), F.explode(lists).alias("x")).select("rid", "x.*")
    values = materialize(_values(tail.select("g").distinct(), tables), "values")
    words = tail.join(values, "g").groupBy("rid", "s").agg(F.sum(F.col("c") * F.col("v")).alias("rest"), F.first("k").alias("k"), F.first("p").alias("p"))
    rest = words.groupBy(F.col("rid").alias(free["rid"])).agg(F.sum("rest").alias(free["s"]), F.min(F.when(F.col("s") >= 0, (F.col("p") + F.col("rest")) / F.col("k"))).alias(free["p"]))
    joined = heads.drop(*(free[x] for x in ("s", "g", "c", "k", "p"))).join(rest, free["rid"], "left")
    mean = (F.col(free["head"]) + F.coalesce(free["s"], F.lit(0.0))) / F.col(free["units"])
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.when(F.col(free["units"]) > 0, F.exp(-mean)).alias("perplexity"), F.exp(-F.least(free["worst"], free["p"])).alias("worst_word"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The trusted documents that thresholds come from, and that the model doesn't learn from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(HELD)) == 0


def judge_quality(docs: DataFrame, labels: DataFrame, upper: float = UPPER, word_upper: float = WORD_UPPER, min_share: float = MIN_SHARE, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """documents, labels (doc_id, quality, toxic) -> doc_id, lang, perplexity, worst_word, threshold, word_threshold, kept;
    a row for each document.

    A language with less than MIN_HELD held-out trusted documents takes the quantiles of all its trusted ones; one without
    any (and a null one) those of all languages together. Without any trusted document all thresholds are null and every
    document with text is kept; if all trusted ones are held out, the model learns from them. Null and empty texts have no
    perplexity and are not kept. Repeated labels count once; repeated documents keep a row each. Very long texts are
    scored whole. An empty table of documents gives no rows. Other columns aren't read, so their names can't clash.
    """
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    small = F.broadcast if ids.count() <= MAX_BROADCAST else (lambda df: df)
    fit = ids.where(~held_out())
    trusted = docs.select("doc_id", "text").join(small(ids if fit.isEmpty() else fit), "doc_id", "left_semi")
    asked = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    scored = materialize(score(asked, learn(trusted), min_share=min_share, max_entries=max_entries), "perplexities")
    good = scored.join(small(ids), "doc_id", "left_semi").where("perplexity is not null").withColumn("held", held_out())

    def cuts(rows: DataFrame, *by: str) -> DataFrame:
        q = lambda x, only: F.percentile_approx(F.when(only, F.col(x)), upper if x == "perplexity" else word_upper, 10_000)
        everyone, enough = F.lit(True), F.count_if("held") >= F.lit(MIN_HELD)
        return rows.groupBy(*by).agg(*[F.when(enough, q(x, F.col("held"))).otherwise(q(x, everyone)).alias(y) for x, y in (("perplexity", "own"), ("worst_word", "own_word"))])

    each = materialize(cuts(good.where("lang is not null"), "lang"), "cuts")
    pooled = cuts(good).first() or {"own": None, "own_word": None}
    out = scored.join(F.broadcast(each) if each.count() <= 10_000 else each, "lang", "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(pooled["own"]).cast("double"))).withColumn("word_threshold", F.coalesce("own_word", F.lit(pooled["own_word"]).cast("double")))
    below = lambda x, y: F.coalesce(F.col(x) <= F.col(y), F.lit(True))
    kept = F.col("perplexity").isNotNull() & below("perplexity", "threshold") & below("worst_word", "word_threshold")
    return out.select("doc_id", "lang", "perplexity", "worst_word", "threshold", "word_threshold", kept.alias("kept"))
