"""Hashes of words and of runs of words, for whole batches of texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import WS_BYTES

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    blank = np.zeros(256, bool)
    blank[list(WS_BYTES)] = True
    return blank, mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """0, 1, .. n-th power of a factor, modulo 2 to the 64th."""
    global _POWERS
    if len(_POWERS) <= n:
        factor = np.full(max(n + 1, 1 << 16), 0xD6E8FEB86659FD93, np.uint64)
        factor[0] = 1
        _POWERS = np.multiply.accumulate(factor)
    return _POWERS


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts with A-Z in lower case, and where each text's begin and end: (hashes, bounds).

    A word's hash is a sum over its bytes, by place, of random numbers times powers of a factor, mixed.
    Bytes that aren't ASCII stay as they are.
    """
    return word_hashes_of([(x or "").encode().lower() for x in texts])


def word_hashes_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, of UTF-8 whose A-Z are in lower case already."""
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    blank, letter = _tables()
    space = blank[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    inside = ~space
    # Each byte's place in its word, counted over the words alone.
    size = end - begin
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    values = letter[data[inside]] * _powers(int(size.max()))[offset]
    hashes = mix(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64) * _STEP)
    starts = np.cumsum([1, *(len(x) + 1 for x in raw)])
    return hashes, np.searchsorted(begin, starts)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each word but the last n - 1; of fewer words, that of the whole sequence as one."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(3) + words[i : len(words) - n + 1 + i] + np.uint64((i + 1) * int(_STEP) % 2**64))
    return out
