"""Prefix dynamic programming over byte-pair merges, shared by token counting and byte-level encoding.

In a byte-pair vocabulary a token sequence is the encoding of its text exactly when each token is what
its own symbols merge to and each neighbouring pair stays apart when merged. So every prefix of a text
has one valid last token, and that of prefix i follows from those of the shorter prefixes in at most
`longest` look-ups: time is linear in the text, however long a word is. An automaton that knows the longest
end of what is read with which a token can begin names the tokens that end at each place.
"""

from __future__ import annotations

NEVER = float("inf")
#: Bits of a token's number: vocabulary and code points together are fewer.
SHIFT = 24


class PrefixBpe:
    """Works on str (symbols are code points) and bytes (symbols are bytes).

    ranks: token -> rank; the pair whose union has the least rank merges first, the leftmost of equals.
    A symbol outside `ranks` merges with nothing and stands as a token of its own.
    """

    def __init__(self, ranks: dict, memo: int = 1_000_000):
        self.ranks, self.memo = ranks, memo
        self.longest = max(map(len, ranks), default=1)
        #: what tokens begin with, the tokens themselves included
        self.starts = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.steps_to: dict = {}
        self.made: dict = {}
        #: token -> its number, also of symbols outside ranks once they are met: at most one for each code point more
        self.number = {t: k for k, t in enumerate(ranks)}
        #: numbers of two tokens, as one -> whether they stay apart
        self.apart: dict[int, bool] = {}

    def merged(self, s) -> list:
        return self._merge(s)[0]

    def _merge(self, s) -> tuple[list, list[tuple[int, object, object]]]:
        """The tokens of s, and for each merge in order its rank and the first and last part after it."""
        parts, ranks, steps = [s[i : i + 1] for i in range(len(s))], self.ranks, []
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            r, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append((r, parts[0], parts[-1]))
        return parts, steps

    def steps(self, t) -> list | None:
        """The merges that make token t of its symbols; None if they don't end in t."""
        if t not in self.made:
            parts, steps = self._merge(t)
            self.made[t] = steps if parts == [t] else None
        return self.made[t]

    def whole(self, t) -> bool:
        return self.steps(t) is not None

    def follows(self, a, b) -> bool:
        """True if token b may directly follow token a: merging a + b never joins symbols of both.

        Both tokens' merges run in order of rank, the left one first when equal, and the parts that
        meet at the border are tried against them.
        """
        key = self._number(a) << SHIFT | self._number(b)
        if (ok := self.apart.get(key)) is None:
            ok = self._apart(a, b)
            if len(self.apart) < self.memo:
                self.apart[key] = ok
        return ok

    def _number(self, t) -> int:
        """Of a token, or of a symbol outside ranks."""
        return self.number.setdefault(t, len(self.number))

    def _apart(self, a, b) -> bool:
        left, right = self.steps(a), self.steps(b)
        if left is None or right is None:
            return False
        x, y, i, j, ranks = a[-1:], b[:1], 0, 0, self.ranks
        while True:
            p, q = left[i][0] if i < len(left) else NEVER, right[j][0] if j < len(right) else NEVER
            r = ranks.get(x + y, NEVER)
            if r < p and r <= q and r is not NEVER:
                return False
            if p is NEVER and q is NEVER:
                return True
            if p <= q:
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1

    def last_lengths(self, s, last: list[int] | None = None) -> list[int]:
        """last[i]: length of the last token of the encoding of s[:i] (last[0] = 0).

        `last` may hold the values for a prefix of s; only the rest is computed (an append).
        """
        last = [0] if last is None else list(last)
        self.extend(s, last, len(s))
        return last

    def extend(self, s, last: list[int], end: int) -> None:
        """Append to `last`, which has the values for a prefix of s, those up to s[:end]."""
        steps_to, apart, first = self.steps_to, self.apart, len(last)
        base = max(0, first - self.longest)
        at = [-1] * (first - base)  # from base on, the number of each prefix's last token; those given, once needed
        state = self._longest_start(s[base : first - 1])
        for i in range(first, end + 1):
            key = state + s[i - 1 : i]
            state, found = steps_to.get(key) or self._step(key)
            for n, b in found:
                j = i - n
                if j:
                    if (a := at[j - base]) < 0:
                        a = at[j - base] = self._number(s[j - last[j] : j])
                    ok = apart.get(a << SHIFT | b)
                    if ok or ok is None and self.follows(s[j - last[j] : j], s[j:i]):
                        break
                elif self.whole(s[:i]):
                    break
            else:
                raise ValueError(f"no token ends at {i}")
            last.append(n)
            at.append(b)

    def _longest_start(self, s):
        """The longest end of s that is the beginning of a token."""
        starts = self.starts
        while s and s not in starts:
            s = s[1:]
        return s

    def _step(self, key) -> tuple:
        """(longest end of key that begins a token, (length, number) of each token that key ends with, longest first).

        key is such an end of what stands before a symbol, and the symbol: no longer token can end with it.
        """
        ends = [key[k:] for k in range(len(key) - 1)]
        out = self._longest_start(key), (*((len(e), self.number[e]) for e in ends if e in self.ranks), (1, self._number(key[-1:])))
        if len(self.steps_to) < self.memo // 4:
            self.steps_to[key] = out
        return out

    @staticmethod
    def tokens(s, last: list[int], end: int | None = None) -> list:
        """The encoding of s[:end], walked back from its last token."""
        out, i = [], len(s) if end is None else end
        while i:
            out.append(s[i - last[i] : i])
            i -= last[i]
        return out[::-1]
