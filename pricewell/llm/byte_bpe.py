"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a pre-token the table keeps the length of its one valid last token
(`prefix_bpe`). Appending bytes extends the table; an edit recomputes it from the edited place on,
until the table agrees with the old one again.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tokenizer_path
from .prefix_bpe import PrefixBpe

RANKS = "byte_bpe_multi_50k.tiktoken"
#: White space other than these two makes a text take the pattern as a whole.
PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​-‍⁠﻿]")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe(dict):
    """chunk of text -> its ids as little-endian 32-bit integers; at most `cap` chunks are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cap: int = 900_000):
        super().__init__()
        self.ranks, self.cap, self.pattern = ranks, cap, regex.compile(pattern)
        self.bpe = PrefixBpe(ranks)
        self.token = {v: k for k, v in ranks.items()}
        self.lasts: dict[bytes, bytes] = {}

    def piece(self, b: bytes) -> list[int]:
        if (whole := self.ranks.get(b)) is not None:  # the library looks a pre-token up before it merges
            return [whole]
        known = next((x for k in range(1, 7) if len(b) > k and (x := self.lasts.get(b[:-k])) is not None), None)
        last = self.bpe.last_lengths(b, known)
        if len(b) < 100 and len(self.lasts) < self.cap // 2:
            self.lasts[b] = bytes(last)
        return [self.ranks[t] for t in self.bpe.tokens(b, last)]

    def __missing__(self, chunk: str) -> bytes:
        parts = self.pattern.findall(chunk)
        if len(parts) > 1:
            out = b"".join(map(self.__getitem__, parts))
        else:
            ids = self.piece(chunk.encode("utf-8")) if chunk else []
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.cap and len(chunk) < 100:
            self[chunk] = out
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Pre-tokens never start within a word and never end within a run of white space before one,
        so a chunk of white space and the word after it can be matched by itself."""
        if OTHER_SPACE.search(text):
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        return b"".join(map(self.__getitem__, PLAIN.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Editable:
    """A pre-token's bytes with their table; append() and replace() keep it exact."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, bpe.last_lengths(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put `new` in place of bytes start:end. Entries before the edit stay. After it, once a stretch
        as long as the longest token has its old values, so have all that follow."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        last, same, i = old[: start + 1], 0, start + 1
        while i <= len(self.data):
            self.bpe.extend(self.data, last, i)
            settled = i - self.bpe.longest > start + len(new)
            same = same + 1 if settled and last[i] == old[i - shift] else 0
            if same > 2 * self.bpe.longest:
                last += old[i - shift + 1 :]
                break
            i += 1
        self.last = last

    def tokens(self) -> list[bytes]:
        return self.bpe.tokens(self.data, self.last)


@lru_cache(maxsize=2)
def shared_coder(path: str, pattern: str) -> ByteBpe:
    """One table for all tasks that a Python worker runs."""
    return ByteBpe(read_ranks(path), pattern)


def byte_bpe(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (binary: little-endian unsigned 32-bit integers), decoded (binary).

    The ids are those of the tiktoken library without special tokens; `decoded` is made from the ids.
    Null and empty texts: no ids, no bytes. Rows with null or repeated ids are encoded each. Other
    columns are not read.
    """
    path, pattern = ranks_path or tokenizer_path(RANKS), pattern or default_pattern()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = shared_coder(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 500):  # ids take more room than texts
                part = b.slice(at, 500)
                ids = [coder.encode_bytes(x or "") for x in part.column(1).to_pylist()]
                decoded = [coder.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")
