"""Pluggable models, each with a deterministic stand-in that needs no network."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from .functions.text import let, tokens, unfenced_json


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """LLM-01's stand-in: signed term counts by hash, scaled to unit length, inside the JVM."""
    cells = F.transform(tokens(text), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dim)).alias("i"), F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    summed = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(held, lambda c: c["i"] == i), F.lit(0.0), lambda a, c: a + c["s"]))
    scaled = lambda sums: let(F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(sums, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))
    return let(let(cells, summed), scaled).cast("array<float>")


def embed(chunks: DataFrame, text: str = "content", into: str = "embedding", model: Callable[[list[str]], list[list[float] | None]] | None = None) -> DataFrame:
    """LLM-01: with a vector for each chunk. model embeds a batch; vectors it can't give are null."""
    if model is None:
        return chunks.withColumn(into, hash_embedding(F.col(text)))

    @F.pandas_udf(ArrayType(FloatType()))
    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series(model(texts.fillna("").tolist()))

    return chunks.withColumn(into, batch(F.col(text)))


def ask(rows: DataFrame, prompt: Column, into: str, model: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """LLM-02 to LLM-14: a text model's answers, batch by batch; errors of the model are the caller's."""

    @F.pandas_udf(StringType())
    def batch(prompts: pd.Series) -> pd.Series:
        return pd.Series(model(prompts.fillna("").tolist()), dtype=object)

    return rows.withColumn(into, batch(prompt))


def extract(rows: DataFrame, answer: str, schema: str, into: str) -> DataFrame:
    """LLM-04, LLM-11, LLM-12: an answer's JSON by a schema; what doesn't parse is null."""
    return rows.withColumn(into, F.from_json(unfenced_json(F.col(answer)), schema))


def facts(answer: Column, most: int = 10) -> Column:
    """LLM-05: a JSON list of facts, or else the answer's lines of more than ten characters."""
    listed = F.from_json(unfenced_json(answer), "array<string>")
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^(?:[-*•]|\d+[.)])\s*", "")), lambda x: F.length(x) > 10)
    return F.slice(F.when(listed.isNotNull() & (F.size(listed) > 0), listed).otherwise(lines), 1, most)


def facts_add_on(chunks: DataFrame, model: Callable[[list[str]], list[str | None]] | None = None, text: str = "content", into: str = "facts", most: int = 10) -> DataFrame:
    """LLM-05: chunks with their facts; without a model, the sentences of more than ten characters stand in."""
    if model is None:
        from .functions.text import sentences

        return chunks.withColumn(into, F.slice(F.filter(sentences(F.col(text)), lambda x: F.length(x) > 10), 1, most))
    prompt = F.concat(F.lit(f"List up to {most} facts of this text as a JSON list:\n"), F.col(text))
    return ask(chunks, prompt, "_answer", model).withColumn(into, F.coalesce(facts(F.col("_answer"), most), F.array().cast("array<string>"))).drop("_answer")


def capitalised_entities(prompts: list[str]) -> list[str]:
    """LLM-06's stand-in as a model: capitalised words that don't start a sentence, as JSON."""
    import json
    import re

    return [json.dumps([{"kind": "Entity", "text": m} for m in re.findall(r"(?<=[^.!?\s] )([A-ZÀ-Þ][a-zà-ÿ]+)", p)], ensure_ascii=False) for p in prompts]


def keyword_entities(text: Column, kind: str = "Entity") -> Column:
    """LLM-06's stand-in: capitalised words that don't start a sentence, with their offsets."""
    pieces = F.split(text, r"(?<=[^.!?\s] )(?=\p{Lu}\p{Ll}+)")
    return F.filter(F.transform(pieces, lambda p: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(p, r"^(\p{Lu}\p{Ll}+)", 1).alias("text"))), lambda e: e["text"] != "")
