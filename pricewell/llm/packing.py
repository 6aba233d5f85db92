"""Packing documents into windows of a fixed number of tokens, online, by the sum-of-squares rule.

Each task packs its own partition. An array counts the open windows at every fill level; a document goes
to the level that leaves the least sum of squared counts, a new window being level 0. Few windows then
stay open at any level, and what is open at the end is cut and joined so that none is left half full.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean, text_slices, tokenizer_path

VOCABULARY, END_ID, CAPACITY = "word_bpe_49k.json", 2, 4096
#: Windows that a task keeps open at most, and so the tokens that it holds: CAPACITY times as many.
MOST_OPEN = 1024


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, then others."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds(dict):
    """word -> its ids as little-endian 32-bit integers, as the tokenizers library gives them.

    The vocabulary lower-cases, drops white space, and starts a new pre-token where punctuation follows a
    letter, so words between blanks, and the marks at a word's end, are encoded by themselves. A word of Latin
    letters is one pre-token and goes to the merges at once. A text with one of the vocabulary's special
    strings goes through the library whole: those are found before words are. At most `cap` words are kept,
    under 200 bytes each; others are encoded anew.
    """

    #: Marks that may end a word. The apostrophe starts pre-tokens of its own.
    ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    BYTES, LATIN_END = _byte_letters(), "\u0250"

    def __init__(self, path: str, cap: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.cap, self.tokenizer = cap, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(self.ENDS)
        if stem and len(stem) < len(word) and stem[-1].isalpha() and stem.isascii():
            out = self[stem] + self[word[len(stem) :]]
        elif word.isalpha() and max(word) < self.LATIN_END and word == word.lower() and (word.isascii() or is_normalized("NFC", word)):
            ids = [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.BYTES))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            out = self.encode_one(word)
        if len(self) < self.cap and len(word) < 60:
            self[word] = out
        return out

    def encode_one(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if "|>" in text and any(x in text.lower() for x in self.special):
            return self.encode_one(text)
        text = text.replace("\n", " ")
        if "Σ" not in text:  # a final sigma depends on its word, which the library does not look at
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def shared_words(path: str) -> WordIds:
    """One table for all tasks that a Python worker runs."""
    return WordIds(path)


class Packer:
    """Open windows by fill level; windows that are full leave at once."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = MOST_OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.count = np.zeros(capacity + 1, np.int64)
        self.at: dict[int, list[list]] = {}

    def level(self, size: int) -> int:
        """The level at which a piece of this size leaves the least sum of squares; of equals the fullest."""
        n, c = self.count, self.capacity
        after = 2 * n[size : c + 1] + 1  # of the level it leads to, from level 0 on
        after[-1] = 0  # a full window counts no more
        gain = after.copy()
        gain[1:] += np.where(n[1 : c - size + 1] > 0, 1 - 2 * n[1 : c - size + 1], 1 << 60)
        return len(gain) - 1 - int(np.argmin(gain[::-1]))

    def add(self, piece: tuple, size: int) -> list[list]:
        """Place a piece; the windows that are complete now."""
        if size == self.capacity:
            return [[piece]]
        h = self.level(size)
        if h:
            window = self.at[h].pop()
            self.count[h] -= 1
        else:
            window = []
        window.append(piece)
        if h + size == self.capacity:
            return [window]
        self.count[h + size] += 1
        self.at.setdefault(h + size, []).append(window)
        return self.joined(False) if self.count.sum() > self.most_open else []

    def joined(self, last: bool) -> list[list]:
        """Close all open windows, cutting pieces to fill them. What is left over opens a window again or,
        at the last, is cut into windows whose lengths are powers of two, which need no padding."""
        pieces = [p for h in sorted(self.at, reverse=True) for w in self.at[h] for p in w]
        self.at, self.count = {}, np.zeros(self.capacity + 1, np.int64)
        total = sum(len(p[2]) // 4 for p in pieces)
        sizes = [self.capacity] * (total // self.capacity)
        if last:
            sizes += [1 << k for k in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> k & 1]
        out, rest = [], pieces[::-1]
        for size in sizes:
            window, left = [], size
            while left:
                key, start, ids, n = rest.pop()
                if len(ids) > 4 * left:
                    rest.append((key, start + left, ids[4 * left :], n))
                    ids = ids[: 4 * left]
                window.append((key, start, ids, n))
                left -= len(ids) // 4
            out.append(window)
        if rest:
            fill = sum(len(p[2]) // 4 for p in rest)
            self.count[fill], self.at[fill] = 1, [rest[::-1]]
        return out


def packed(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", most_open: int = MOST_OPEN) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its tokens and then end_id; null and empty texts are end_id alone. Documents longer than
    a window are cut into whole windows and a rest, and the rest is packed. Rows with null or repeated ids
    are packed each. Other columns are not read. sequence_id is unique over all tasks. The ids are those that
    the library gives by default: special strings in a text become their ids. A task that has more than
    most_open windows open cuts and joins what is in them, as at its end: no token is lost, but up to one
    document a window is cut that the rule alone would leave whole.
    """
    path = vocabulary_path or tokenizer_path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    @lean
    def run(batches):
        coder, packer = shared_words(path), Packer(capacity, most_open)
        number = TaskContext.get().partitionId() << 32

        def rows(windows):
            nonlocal number
            out = []
            for window in windows:
                offset = 0
                for key, start, ids, n in window:
                    out.append((key, start, len(ids) // 4, ids, n, number, offset))
                    offset += len(ids) // 4
                number += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        key_type, end = None, struct.pack("<I", end_id)
        for part in text_slices(batches, 1):
            key_type, done = part.schema.field(0).type, []
            for key, ids in zip(part.column(0).to_pylist(), map(coder.encode, part.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    done += packer.add((key, start, piece, n), len(piece) // 4)
            yield rows(done)
        if key_type is not None:
            yield rows(packer.joined(True))

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
