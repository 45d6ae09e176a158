"""Registries of named components and hooks around pipeline stages."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, functions as F

from .operators import chunk

HOOKS = ("before_extract", "after_extract", "before_chunk", "after_chunk", "before_crawl", "after_crawl")


class Registry:
    """EXT-01: components by name; a factory shadows a component of the same name."""

    def __init__(self, kind: str):
        self.kind = kind
        self._parts: dict[str, Any] = {}
        self._factories: dict[str, Callable[..., Any]] = {}

    def register(self, name: str, part: Any) -> Any:
        self._parts[name] = part
        return part

    def register_factory(self, name: str, factory: Callable[..., Any]) -> None:
        self._factories[name] = factory

    def get(self, name: str) -> Any:
        if name not in self:
            raise KeyError(f"no {self.kind} named {name!r}; there are: {', '.join(self.names())}")
        return self._factories.get(name) or self._parts[name]

    def create(self, name: str, **options) -> Any:
        return self.get(name)(**options)

    def names(self) -> list[str]:
        return sorted({*self._parts, *self._factories})

    def __contains__(self, name: str) -> bool:
        return name in self._parts or name in self._factories


class Hooks:
    """EXT-07: ordered DataFrame transformations at named points; None from a hook skips the stage."""

    def __init__(self):
        self._at: dict[str, list[Callable[[DataFrame], DataFrame | None]]] = {h: [] for h in HOOKS}

    def register(self, point: str, hook: Callable[[DataFrame], DataFrame | None]) -> None:
        self._at[point].append(hook)

    def unregister(self, point: str, hook: Callable[[DataFrame], DataFrame | None]) -> bool:
        if hook not in self._at[point]:
            return False
        self._at[point].remove(hook)
        return True

    def clear(self, point: str | None = None) -> None:
        for p in [point] if point else HOOKS:
            self._at[p].clear()

    def has(self, point: str) -> bool:
        return bool(self._at[point])

    def run(self, point: str, df: DataFrame) -> DataFrame | None:
        for hook in self._at[point]:
            df = hook(df)
            if df is None:
                return None
        return df


#: EXT-02, EXT-08. What a component of each kind is:
#: chunker: (documents, key=, text=, **options) -> chunks (key, chunk_index, content); extractor: bytes -> text, by suffix;
#: crawler: candidates (url) -> with status_code, content, markdown, error; search provider: queries (round_number, query)
#: -> results; chunk add-on: chunks -> chunks; validator: chunks -> a condition on them; store: a factory of stores;
#: model: texts -> answers.
chunkers, crawlers, extractors, search_providers, add_ons, validators, stores, models = (Registry(k) for k in ("chunker", "crawler", "extractor", "search provider", "chunk add-on", "validator", "store", "model"))


def _semantic(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, most: int = 1000, least: int = 100, embedder: Callable | None = None) -> DataFrame:
    """CHK-10 from texts: sentences, their vectors, the similarity of neighbours, and the cuts."""
    from .functions.text import sentences
    from .models import embed
    from .operators.validate import adjacent_similarity

    rows = docs.select(key, F.posexplode(sentences(F.col(text))).alias("sent_idx", "sentence"))
    near = adjacent_similarity(embed(rows, "sentence", "embedding", embedder), [key], "sent_idx")
    return chunk.semantic_chunks(near, key, threshold=threshold, most=most, least=least)


def _register() -> None:
    from .models import facts_add_on, hash_embedding
    from .sources.fetch import fetched
    from .sources.formats import READERS
    from .sources.stub import stub_provider

    for name, part in (("sentence", chunk.sentence_chunks), ("sliding_window", chunk.sliding_chunks), ("hierarchical", chunk.hierarchical_chunks), ("semantic", _semantic)):
        chunkers.register(name, part)
    for suffix, reader in READERS.items():
        extractors.register(suffix, reader)
    crawlers.register("http", fetched)
    search_providers.register("stub", stub_provider)
    add_ons.register("facts", facts_add_on)
    models.register("hash", hash_embedding)
    validators.register("not_blank", lambda chunks: chunks["content"].rlike(r"\S"))


def chunker_for(name: str, strict: bool = False) -> Callable[..., DataFrame]:
    """CHK-15: a chunker by name; an unknown name is hierarchical, or a KeyError if strict."""
    return chunkers.get(name if strict or name in chunkers else "hierarchical")


def run_add_ons(chunks: DataFrame, names: list[str], **options) -> DataFrame:
    """EXT-05: chunks through add-ons in order; an unknown name is an error, an add-on that fails while its plan is made is
    passed over and logged."""
    for name in names:
        add_on = add_ons.get(name)
        try:
            chunks = add_on(chunks, **options.get(name, {}))
        except Exception as x:  # noqa: BLE001
            logging.getLogger("lodestrand").warning("add-on %s was passed over: %s: %s", name, type(x).__name__, x)
    return chunks


def validated(chunks: DataFrame, names: list[str]) -> DataFrame:
    """EXT-04: the chunks that all validators pass; an unknown name is an error, an unknown answer (null) doesn't pass."""
    for name in names:
        chunks = chunks.where(F.coalesce(validators.get(name)(chunks), F.lit(False)))
    return chunks


_register()
