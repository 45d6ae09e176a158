"""An inverted index that is kept: loads add to it, and queries read their terms' blocks only.

A load (a set of chunks) is tokenised once. Its chunks, longest first within a task's part, are cut into ranges of
``range_docs``; all postings of a term in a range are one row, a block, with the block's largest count and shortest chunk.
Blocks lie in folders by a hash of their term, sorted by term, so that a query's plan prunes folders and row groups. A load
becomes part of the index when its line in ``commits`` is there, as one rename: a load that fails leaves nothing that
counts, and loads may run side by side.

A search bounds each range by what its blocks allow at most (no term can add more than its weight at the largest count and
the shortest length, and none less than its negative weight or nothing). The ranges with the highest bounds are scored
first; their k-th score is a threshold, and ranges that can't reach it aren't read. What is left is scored in full, so the
result is that of scoring everything.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import term_counts, tokens
from ..sources.state import stored
from .retrieve import _PAIRS, B, K1, top_k

BUCKETS, RANGE_DOCS = 64, 128
#: Ranges of each query that are scored for a threshold.
PROBES = 4
#: Scores are compared rounded to six digits, so a range counts as out of reach only if it is more than that below.
_SLACK = 2e-6


class TermIndex:
    """AGG-02, AGG-03, TOP-02: an index over (key, text) at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "long", buckets: int = BUCKETS, range_docs: int = RANGE_DOCS):
        self.spark, self.path, self.key, self.buckets, self.range_docs = spark, path.rstrip("/"), key, buckets, range_docs
        self.documents_schema = f"`{key}` {key_type}, dl int, `range` long, terms array<struct<term:string,tf:int>>, load string"
        self.blocks_schema = f"term string, `range` long, n int, total long, max_tf int, min_dl int, postings array<struct<`{key}`:{key_type},tf:int,dl:int>>, load string, bucket int"

    # loads

    def add(self, chunks: DataFrame, text: str = "text") -> str:
        """Adds chunks that the index doesn't hold yet; reads nothing else. Returns the load's name.

        A null text has no terms and counts as a chunk of length 0. Chunks are read once.
        """
        found = chunks.select(F.col(self.key), term_counts(tokens(F.col(text))).alias("terms"))
        return self._load(found.withColumn("dl", F.aggregate("terms", F.lit(0), lambda n, t: n + t["tf"])), [])

    def _load(self, rows: DataFrame, replaces: list[str]) -> str:
        load = uuid.uuid4().hex
        ordered = rows.sortWithinPartitions(F.desc("dl"), self.key)
        # running numbers of a partition begin at a multiple of any power of two
        ordered = ordered.withColumn("range", F.floor(F.monotonically_increasing_id() / self.range_docs))
        ordered.select(self.key, "dl", "range", "terms").write.parquet(f"{self.path}/documents/load={load}")
        held = self._table("documents", self.documents_schema, [load])
        blocks = held.select(self.key, "dl", "range", "terms").mapInArrow(self._inverted, ", ".join(self.blocks_schema.split(", ")[:-2]))
        blocks = blocks.withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range")
        blocks.write.partitionBy("bucket").parquet(f"{self.path}/blocks/load={load}")
        sums = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.lit(replaces).cast("array<string>").alias("replaces"))
        sums.coalesce(1).write.parquet(f"{self.path}/commits/load={load}")
        return load

    @staticmethod
    def _inverted(batches):
        """Blocks of rows (key, dl, range, terms), made where the rows are: a range's rows lie together, so no posting is moved
        alone. A range that two batches hold has two blocks of a term."""
        for batch in batches:
            keys, dl, ranges, lists = (batch.column(i) for i in range(4))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            held = lists.flatten()
            if not len(held):
                continue
            rank = np.empty(len(keys), np.int64)
            rank[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
            coded = held.field("term").dictionary_encode()
            doc, term = np.repeat(np.arange(len(keys)), sizes), coded.indices.to_numpy().astype(np.int64)
            at = ranges.to_numpy()[doc]
            order = np.lexsort((rank[doc], term, at))
            doc, term, at, tf = doc[order], term[order], at[order], held.field("tf").to_numpy()[order]
            heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (at[1:] != at[:-1])]))
            long = dl.to_numpy()[doc]
            postings = pa.StructArray.from_arrays([keys.take(pa.array(doc)), pa.array(tf), pa.array(long)], [batch.schema.names[0], "tf", "dl"])
            ends = np.append(heads, len(doc)).astype(np.int32)
            made = [coded.dictionary.take(pa.array(term[heads])), pa.array(at[heads]), pa.array(np.diff(ends)), pa.array(np.add.reduceat(tf.astype(np.int64), heads)), pa.array(np.maximum.reduceat(tf, heads)), pa.array(np.minimum.reduceat(long, heads)), pa.ListArray.from_arrays(pa.array(ends), postings)]
            blocks = pa.RecordBatch.from_arrays(made, ["term", "range", "n", "total", "max_tf", "min_dl", "postings"])
            for first in range(0, len(heads), 10_000):
                yield blocks.slice(first, 10_000)

    def rewritten(self, without: DataFrame | None = None) -> str:
        """All loads as one, without some keys; no text is read. Readers see the old loads until the new one is committed."""
        loads = self.loads()
        held = self._table("documents", self.documents_schema, loads)
        return self._load((held if without is None else held.join(without.select(self.key), self.key, "left_anti")).select(self.key, "dl", "terms"), loads)

    def loads(self) -> list[str]:
        """The loads that count; as many as have been added since the last rewriting."""
        return [r["load"] for r in self._commits()]

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _commits(self) -> list[Row]:
        """A line a load: load, n, n_tokens; without loads that a later one replaces."""
        if not self._exists(f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema("n long, n_tokens long, replaces array<string>, load string").option("basePath", f"{self.path}/commits").parquet(f"{self.path}/commits").collect()
        gone = {x for r in rows for x in r["replaces"]}
        return [r for r in rows if r["load"] not in gone]

    def _table(self, name: str, schema: str, loads: list[str]) -> DataFrame:
        if not loads:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("load").isin(loads))

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.hash(term), F.lit(self.buckets)).cast("int")

    # reading

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """The blocks, or those of some terms (term): folders are pruned by the terms' hashes, which are few."""
        rows = self._table("blocks", self.blocks_schema, self.loads())
        return rows if terms is None else self._pruned(rows, terms).join(terms.select("term"), "term", "left_semi")

    def _pruned(self, rows: DataFrame, terms: DataFrame) -> DataFrame:
        asked = [r["b"] for r in terms.select(self._bucket(F.col("term")).alias("b")).distinct().collect()]
        return rows.where(F.col("bucket").isin(asked))

    def terms(self) -> DataFrame:
        """AGG-01: (term, df, total), from the blocks' heads."""
        return self.blocks().groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("total"))

    def stats(self) -> tuple[int, float]:
        """How many chunks there are, and their mean length."""
        return self._stats(self._commits())

    @staticmethod
    def _stats(commits: list[Row]) -> tuple[int, float]:
        n = sum(r["n"] for r in commits)
        return n, sum(r["n_tokens"] for r in commits) / n if n else 0.0

    # searching

    def search(self, queries: DataFrame, k: int, query_key: str = "item_id", text: str = "text", standard: bool = False, digits: int = 6) -> DataFrame:
        """The k best chunks of each query by BM25 (see retrieve.bm25): query_key, key, score, rank.

        Queries are taken so many at once that their terms can be told to every task.
        """
        parts = self._parts(queries, query_key, text)
        out = self._search(parts[0], k, standard, digits)
        for more in parts[1:]:
            out = out.unionByName(self._search(more, k, standard, digits))
        return out.withColumnRenamed("q", query_key)

    def _parts(self, queries: DataFrame, query_key: str, text: str) -> list[DataFrame]:
        """(q, term, qtf) of the queries, in parts of some _PAIRS rows."""
        asked = stored(queries.select(F.col(query_key).alias("q"), F.inline(term_counts(tokens(F.col(text))))).withColumnRenamed("tf", "qtf"), "asked")
        parts = max(1, -(-asked.count() // _PAIRS))
        return [asked if parts == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i) for i in range(parts)]

    def _placed(self, asked: DataFrame, k: int, standard: bool, digits: int) -> tuple[DataFrame, DataFrame, DataFrame, _Asked, DataFrame]:
        """Each query's ranges by what they allow at most (q, load, range, bound, place), the scores of its first ones, its k-th
        score so far where it has one, and what it takes to score others."""
        ranges, told, blocks = self._ranges(asked, standard)
        best = W.partitionBy("q").orderBy(F.desc("bound"), "load", "range")
        placed = stored(ranges.withColumn("place", F.row_number().over(best)), "bounds")
        first = stored(self._scores(placed.where(F.col("place") <= PROBES), told, blocks, standard, k, digits), "probes")
        least = top_k(first, k, "q", self.key, digits=digits).groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("found"))
        return placed, first, least.where(F.col("found") >= k), told, blocks  # without k chunks there is no threshold

    def _search(self, asked: DataFrame, k: int, standard: bool, digits: int) -> DataFrame:
        placed, first, least, told, blocks = self._placed(asked, k, standard, digits)
        rest = stored(placed.where(F.col("place") > PROBES).join(least, "q", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)), "rest")
        both = first.unionByName(self._scores(rest, told, blocks, standard, k, digits))
        return top_k(both, k, "q", self.key, digits=digits)

    def reach(self, queries: DataFrame, k: int, query_key: str = "item_id", text: str = "text", standard: bool = False, digits: int = 6) -> DataFrame:
        """How many of each query's ranges a search reads: query_key, n_ranges, n_read."""
        read = (F.col("place") <= PROBES) | F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)
        out = []
        for asked in self._parts(queries, query_key, text):
            placed, _, least, _, _ = self._placed(asked, k, standard, digits)
            out.append(placed.join(least, "q", "left").groupBy(F.col("q").alias(query_key)).agg(F.count("*").alias("n_ranges"), F.count_if(read).alias("n_read")))
        return reduce(DataFrame.unionByName, out)

    def _ranges(self, asked: DataFrame, standard: bool) -> tuple[DataFrame, _Asked, DataFrame]:
        """(q, load, range, bound), the queries as they are told to tasks, and their terms' blocks; all of the loads that count
        now. The heads of a range's blocks meet in one task, which tells the bounds of all queries."""
        commits = self._commits()
        n, avgdl = self._stats(commits)
        terms = asked.select("term").distinct()
        blocks = self._pruned(self._table("blocks", self.blocks_schema, [r["load"] for r in commits]), terms).join(terms, "term", "left_semi")
        heads = stored(blocks.select("term", "load", "range", "n", "max_tf", "min_dl"), "heads")
        told = _Asked(asked.toArrow(), heads.groupBy("term").agg(F.sum("n").alias("df")).toArrow(), n, avgdl)
        kind = asked.schema["q"].dataType.simpleString()

        def one(heads: pa.Table) -> pa.Table:
            t = told.places(heads["term"])
            most = np.maximum(told.amount(t, heads["max_tf"].to_numpy(), heads["min_dl"].to_numpy(), standard), 0)
            block, pair = told.pairs(t)
            bound = np.bincount(told.who[pair], most[block] * told.often[pair], len(told.names))
            found = np.flatnonzero(np.bincount(told.who[pair], minlength=len(told.names)))
            return pa.table({"q": told.names.take(pa.array(found)), "load": heads["load"].take(pa.array(np.zeros(len(found), np.int64))), "range": np.full(len(found), heads["range"][0].as_py()), "bound": bound[found]})

        return heads.groupBy("load", "range").applyInArrow(one, f"q {kind}, load string, range long, bound double"), told, blocks

    def _scores(self, ranges: DataFrame, told: _Asked, blocks: DataFrame, standard: bool, k: int, digits: int) -> DataFrame:
        """(q, key, score) of what may be among a query's best k in some ranges (q, load, range), ties included.

        A range's blocks and the queries that want it meet in one task and are scored as a matrix; the chunks of a range are
        few, so a task holds little, and no score of a chunk that its range surpasses is shuffled. Queries' terms are told to
        the task, and blocks of ranges that nobody wants stay where they are.
        """
        wanted = ranges.select("q", "load", "range")
        held = blocks.select("load", "range", "term", "postings").join(wanted.select("load", "range").distinct(), ["load", "range"], "left_semi")
        kind, key = ranges.schema["q"].dataType, self.key
        schema = StructType([StructField("q", kind), StructField(key, StructType.fromDDL(self.documents_schema)[key].dataType), StructField("score", DoubleType())])

        def one(asked: pa.Table, blocks: pa.Table) -> pa.Table:
            lists = pa.concat_arrays(blocks["postings"].chunks) if blocks.num_rows else None
            if lists is None or not asked.num_rows:
                return pa.table({"q": asked["q"].slice(0, 0), key: pa.array([], to_arrow_type(schema[key].dataType)), "score": pa.array([], pa.float64())})
            flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            chunks, t = flat.field(key).dictionary_encode(), told.places(blocks["term"])
            document, tf, dl = (x.to_numpy() for x in (chunks.indices, flat.field("tf"), flat.field("dl")))
            amount = told.amount(np.repeat(t, np.diff(ends)), tf, dl, standard)
            queries = np.unique(pc.index_in(asked["q"], value_set=told.names).to_numpy())
            place = np.full(len(told.names), -1)
            place[queries] = np.arange(len(queries))
            scores = np.zeros((len(queries), len(chunks.dictionary)))
            shared = np.zeros(scores.shape, bool)
            for i, x in enumerate(t):
                mine, pair = slice(ends[i], ends[i + 1]), slice(told.first[x], told.first[x + 1])
                row = place[told.who[pair]]
                cells = np.ix_(row[row >= 0], document[mine])
                scores[cells] += told.often[pair][row >= 0][:, None] * amount[mine]
                shared[cells] = True
            rounded = np.where(shared, np.round(scores, digits), -np.inf)
            if k < rounded.shape[1]:
                # a little less than the k-th, as rounding here and in the result may differ in the last digit
                shared &= rounded >= np.partition(rounded, -k, axis=1)[:, -k, None] - _SLACK
            i, j = np.nonzero(shared)
            return pa.table({"q": told.names.take(pa.array(queries[i])), key: chunks.dictionary.take(pa.array(j)), "score": scores[i, j]})

        return wanted.groupBy("load", "range").cogroup(held.groupBy("load", "range")).applyInArrow(one, schema)


class _Asked:
    """Queries as they are told to tasks: the asked terms that the index holds, and by term who asks for it and how often."""

    def __init__(self, asked: pa.Table, found: pa.Table, n: int, avgdl: float):
        self.terms, df = pa.concat_arrays(found["term"].chunks or [pa.array([], pa.string())]), found["df"].to_numpy().astype(float)
        self.idf, self.avgdl = np.log((n - df + 0.5) / (df + 0.5)), avgdl
        known = asked.filter(pc.is_in(asked["term"], value_set=self.terms))
        t = pc.index_in(known["term"], value_set=self.terms).to_numpy().astype(np.int64)
        self.names = known["q"].unique()
        order = np.argsort(t, kind="stable")
        self.who = pc.index_in(known["q"], value_set=self.names).to_numpy().astype(np.int64)[order]
        self.often = known["qtf"].to_numpy().astype(float)[order]
        self.first = np.searchsorted(t[order], np.arange(len(self.terms) + 1))

    def places(self, terms: pa.ChunkedArray) -> np.ndarray:
        return pc.index_in(terms, value_set=self.terms).to_numpy().astype(np.int64)

    def pairs(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms: which of them, and where the queries are that ask for it."""
        times = self.first[t + 1] - self.first[t]
        return np.repeat(np.arange(len(t)), times), np.repeat(self.first[t] - np.cumsum(times) + times, times) + np.arange(times.sum())

    def amount(self, t: np.ndarray, tf: np.ndarray, dl: np.ndarray, standard: bool) -> np.ndarray:
        """What a term adds to a chunk's score, for each time that it is asked for (see retrieve.bm25_weight)."""
        tf = tf.astype(float)
        return self.idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl)) * (1 if standard else tf)
