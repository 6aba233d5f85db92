"""Token counts by prefix dynamic programming for a sentencepiece BPE model with byte fallback.

`PrefixCounts` keeps, for each stretch of text between two places that no token crosses, the exact
token count of every prefix. The count of any prefix of a document is then a sum of whole stretches
plus one stored count, so truncation and budget questions need no second encoding.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices, tokenizer_path
from .prefix_bpe import PrefixBpe

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: No piece has a space mark after another character, none holds a line break: tokens never cross these places.
STRETCH = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
TOTAL = itemgetter(-1)


class PrefixCounts(dict):
    """stretch -> for each of its prefixes the length of its last token, and then for each its token count.

    At most `cap` stretches are kept, so a worker's memory is bounded; others are computed anew.
    """

    def __init__(self, model_path: str, cap: int = 700_000):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
        ids = [i for i in range(model.get_piece_size()) if not special(i)]
        ranks = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in ranks):
            raise ValueError("this model has pieces that cross spaces or line breaks")
        self.bpe, self.cap = PrefixBpe(ranks), cap

    def __missing__(self, s: str):
        n, last, count = len(s), [0], [0]
        for k in range(n - 1, max(0, n - 7), -1):  # goes on from a prefix of it that is known
            if (known := self.get(s[:k])) is not None:
                last += known[:k]
                count += known[k:]
                break
        self.bpe.extend(s, last, n)
        ranks = self.bpe.ranks
        for i in range(len(count), n + 1):
            m = last[i]
            # a character without a piece becomes its UTF-8 bytes
            count.append(count[i - m] + (1 if m > 1 or s[i - 1] in ranks else len(s[i - 1].encode("utf-8", "surrogatepass"))))
        both = last[1:] + count[1:]
        if n < 100 and both[-1] < 256:  # counts ascend
            both = bytes(both)
            if len(self) < self.cap:
                self[s] = both
        return both

    def counts(self, s: str) -> list[int]:
        """counts[i]: tokens of the first i + 1 characters of the stretch."""
        return list(self[s][len(s) :])

    def stretches(self, text: str) -> list[str]:
        """The model puts one space mark before a text that isn't empty."""
        return STRETCH.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str) -> int:
        return sum(map(TOTAL, map(self.__getitem__, self.stretches(text))))

    def prefix_counts(self, text: str) -> list[int]:
        """counts[k]: tokens of text[:k], for k = 0 .. len(text)."""
        out, base = [], 0
        for s in self.stretches(text):
            out += [base + c for c in self.counts(s)]
            base = out[-1]
        if out:
            out[0] = 0
        return out or [0]

    def longest_prefix(self, text: str, budget: int) -> int:
        """The largest k such that text[:k] has at most `budget` tokens."""
        parts = self.stretches(text)
        ends = list(accumulate(map(len, parts)))
        bases = list(accumulate(map(TOTAL, map(self.__getitem__, parts)), initial=0))
        for j in range(len(parts) - 1, -1, -1):
            # a prefix that ends within stretch j has at least bases[j] tokens
            if bases[j] < budget:
                counts = self.counts(parts[j])
                for i in range(len(counts) - 1, -1, -1):
                    if bases[j] + counts[i] <= budget:
                        return ends[j] - len(parts[j]) + i  # the first mark isn't part of the text
        return 0


@lru_cache(maxsize=2)
def shared_table(path: str) -> PrefixCounts:
    """One table for all tasks that a Python worker runs."""
    return PrefixCounts(path)


def token_counts(docs: DataFrame, budget: int = 4096, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > budget), fit_chars.

    fit_chars is the number of code points of the longest prefix within the budget. Counts equal the
    library's, without begin or end tokens. Null and empty texts: 0 bytes, 0 tokens. Ids may be null or
    repeat; each row is counted. Other columns are not read.
    """
    path = model_path or tokenizer_path(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        table = shared_table(path)
        for b in text_slices(batches, 1):
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = [table.count(x) for x in texts]
            fit = [len(x) if c <= budget else table.longest_prefix(x, budget) for x, c in zip(texts, n, strict=True)]
            size = [len(x.encode("utf-8")) for x in texts]
            yield pa.record_batch(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([c > budget for c in n], pa.bool_()), pa.array(fit, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def truncated(docs: DataFrame, budget: int = 4096, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with every text cut to its longest prefix of at most `budget` tokens; nulls stay null."""
    path, at = model_path or tokenizer_path(MODEL), docs.columns.index(text_col)

    def run(batches):
        table = shared_table(path)
        for b in text_slices(batches, at):
            cut = [x if x is None else x[: table.longest_prefix(x, budget)] for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
