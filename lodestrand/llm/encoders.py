"""Public tokenizers inside tasks: token ids as numbers, and the bytes that each token stands for.

Vocabulary files are read by the driver from a path that is a parameter, and their bytes (of fixed size) are broadcast.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: How the byte-level vocabulary splits a text before merging: a fixed value that belongs to it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The printable bytes, which a byte-level vocabulary writes as themselves; the others are written from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    others = [b for b in range(256) if b not in _PRINTED]
    return {chr(b): b for b in _PRINTED} | {chr(0x100 + k): b for k, b in enumerate(others)}


def flat_ids(ids: list[int]) -> np.ndarray:
    return np.frombuffer(array("I", ids), np.uint32)


class ByteBpe:
    """A byte-level BPE vocabulary from the tokenizers library's file.

    Merges run in the tiktoken library, five times as fast, with the file's entries as ranks: a token's id is its rank, as
    loading checks. Ids are those of the tokenizers library, over all characters.
    """

    def __init__(self, raw: bytes):
        import tiktoken

        file = json.loads(raw)
        vocabulary, letters = file["model"]["vocab"], byte_letters()
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        if any(vocabulary[a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
            raise ValueError("the ids of this vocabulary aren't its merges' ranks")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (1 + max([*ranks.values(), *self.added.values()]))
        for token, i in [*ranks.items(), *[(t.encode(), i) for t, i in self.added.items()]]:
            self.tokens[i] = token

    def plain(self, text: str) -> list[int]:
        """Ids of a text; the strings of added tokens in it are plain text."""
        return self.encoding.encode_ordinary(text)

    def ids(self, text: str) -> list[int]:
        """Ids of a text; the strings of added tokens in it are these tokens."""
        for content, i in self.added.items():
            if content in text:
                parts = text.split(content)
                out = self.ids(parts[0])
                for part in parts[1:]:
                    out += [i, *self.ids(part)]
                return out
        return self.encoding.encode_ordinary(text)


class PieceBpe:
    """A sentencepiece vocabulary with byte fallback; it puts a space before each text."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = self.encoder.get_piece_size()
        pieces = [self.encoder.id_to_piece(i) for i in range(n)]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.encoder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.encoder.encode(texts, num_threads=1)


def joined(table: pa.Array, codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The table's strings at codes as one run of bytes, and where each begins (and the last ends)."""
    taken = table.take(pa.array(codes))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return memoryview(taken.buffers()[2] or b"").cast("B"), offsets
