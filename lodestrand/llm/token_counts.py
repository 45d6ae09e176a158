"""Token counts of a document's sections, attributed by offsets.

A whole document is encoded once with a byte-level vocabulary. Its tokens cover its UTF-8 bytes without gaps, so the
running sum of token lengths gives each token's span in bytes, and the offsets of the characters turn it into a span of
characters. An interval join (binary search over the sections' starts) gives each token to a section. A token that
crosses a boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first character.
* ``most``: to the section that holds most of its bytes, the earlier one of equals.

Encoding sections by themselves gives other counts, as tokens merge across boundaries; sums over sections plus what
lies outside any section always equal the document's count here.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits a text before merging: a fixed value that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SECTIONS = "array<struct<name:string,start:long,end:long>>"


class Encoder:
    """Token ids and byte lengths, from the bytes of a vocabulary file."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.lengths[i] = len(piece)

    def spans(self, text: str) -> np.ndarray:
        """The first byte of each token, and after them the text's length in bytes."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])


def head_and_body(text: Column) -> Column:
    """A document's first line and the rest, as sections in characters; together they cover the text."""
    cut = F.locate("\n", text).cast("long")
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    end = F.when(cut > 0, cut).otherwise(n)
    part = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    return F.array(part("head", F.lit(0), end), part("body", end, n))


def allocate(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens cross each section's end or start from within it.

    spans, starts, ends: in bytes; sections are sorted and don't overlap.
    """
    first, after = spans[:-1], spans[1:]
    at = np.searchsorted(starts, first, "right") - 1
    inside = (at >= 0) & (first < ends[np.maximum(at, 0)]) if len(starts) else np.zeros(len(first), bool)
    if rule == "most" and len(starts):
        for t in np.flatnonzero(~inside | (after > ends[np.maximum(at, 0)])):
            held = np.minimum(after[t], ends) - np.maximum(first[t], starts)
            inside[t] = held.max() > 0
            at[t] = int(held.argmax())
    chosen = at[inside]
    crossing = (first[inside] < starts[chosen]) | (after[inside] > ends[chosen])
    return np.bincount(chosen, minlength=len(starts)), np.bincount(chosen[crossing], minlength=len(starts))


def count_tokens(docs: DataFrame, sections: Column | None = None, text: str = "text", doc_id: str = "doc_id", rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs -> one row per section: doc_id, section, start, end (characters), n_tokens, n_crossing, doc_tokens.

    sections: an array of (name, start, end) in characters, sorted, without overlaps; spans beyond the text are cut.
    A null text counts as empty and null sections as none; an empty section has no tokens. Repeated rows and repeated
    section names keep a row each; an empty table gives none. A text is encoded whole, however long, one at a time. Other
    columns aren't read, so their names can't clash.
    """
    if rule not in ("start", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a file of fixed size
    held: list[Encoder] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Encoder(shared.value))
        out: dict[str, list] = {k: [] for k in ("row", "name", "start", "end", "n", "crossing", "total")}
        for row, (text, parts) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
            value = text.as_py() or ""
            spans = held[0].spans(value)
            parts = parts or []
            raw = np.frombuffer(value.encode(), np.uint8)
            # the first byte of each character, and the text's end
            offsets = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])
            a, b = (offsets[np.clip(np.array([p[k] or 0 for p in parts], np.int64), 0, len(offsets) - 1)] for k in ("start", "end"))
            n, crossing = allocate(spans, a, b, rule)
            out["row"] += [row] * len(parts)
            for k in ("name", "start", "end"):
                out[k] += [p[k] for p in parts]
            out["n"] += n.tolist()
            out["crossing"] += crossing.tolist()
            out["total"] += [len(spans) - 1] * len(parts)
        ids = batch.column(0).take(pa.array(out["row"], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(out["name"], pa.string()), *(pa.array(out[k], pa.int64()) for k in ("start", "end", "n", "crossing", "total"))], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    sections = head_and_body(F.col(text)) if sections is None else sections
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), sections.cast(SECTIONS).alias("sections"))
    return arrow_rows(rows, work, "doc_id long, section string, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
