"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
STEP = np.uint64(int(_RNG.integers(0, 1 << 63)) * 2 + 1)
PLACES = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= M1
    h ^= h >> np.uint64(33)
    h *= M2
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts, each with a zero byte after it, and where each part starts (one more at the end)."""
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return data, np.concatenate([[0], np.cumsum(size)])


def words_of(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes b with inside[b]; byte 0 must not be inside."""
    mask = np.concatenate([[False], inside[data], [False]])
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], or of its first bytes only."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if first is not None:
        end = np.minimum(end, start + first)
    size = end - start
    heads = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) - np.repeat(heads, size)
    value = BYTE[data[place + np.repeat(start, size)]] * powers(int(size.max()))[place]
    return mixed(np.add.reduceat(value, heads) + size.astype(np.uint64))
