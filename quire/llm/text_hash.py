"""Words, shingles and character n-grams of many texts at once, as 64-bit hashes, in numpy over Arrow's buffers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A value for each byte (a fixed pseudo-random table, the same in every process).
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of texts that are hashed together, about; a longer text stands alone.
SLICE = 1_000_000


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(SLICE + 2)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; only a table of the usual size is kept in memory."""
    return _usual_powers() if n <= SLICE + 2 else _made_powers(n)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins (one more: the end). Nulls must have been filled."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every run of True that crosses no border between texts."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = at[(at > 0) & (at < n)]
    first[border] = inside[border]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[border - 1] = inside[border - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(at, begin, side="right") - 1


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run, wherever it stands."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)])])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and text number of every word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the number of texts."""
    data, at = flat(texts)
    data = LOWER[data]
    begin, end, doc = runs(~_SPACE[data], at)
    return run_hashes(data, begin, end), doc, len(texts)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; with fewer words, of the whole sequence; without words none."""
    word, doc, n = words(texts)
    out = np.zeros(len(word), np.uint64)
    count = np.bincount(doc, minlength=n)
    k = np.uint64(0xFF51AFD7ED558CCD)
    for j in range(width):  # fewer words than the width: those that are there
        m = max(0, len(word) - j)
        there = np.zeros(len(word), bool)
        there[:m] = doc[:m] == doc[j : j + m]
        nxt = np.zeros(len(word), np.uint64)
        nxt[:m] = word[j : j + m]
        out = np.where(there, out * k + nxt, out)
    out = mix(out)
    first = np.concatenate([[0], np.cumsum(count)])
    return [np.unique(out[a : a + max(1, c - width + 1)]) if c else out[:0] for a, c in zip(first[:-1].tolist(), count.tolist(), strict=True)]
