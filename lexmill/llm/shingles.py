"""Words and word shingles of whole Arrow batches as 64-bit hashes, by numpy on the text's own bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20_240_101)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes whose words are hashed by one running sum.
STRETCH = 65_536
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PLACES = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' bounds in them; nulls are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, bounds - bounds[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((int(_STEP), pow(int(_STEP), -1, 2**64))):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _POWERS[i] = np.cumprod(full)
    return _POWERS[0], _POWERS[1]


def word_places(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all rows start and end."""
    inside = ~_BLANK[body]
    edge = np.zeros(len(body) + 1, bool)  # no word goes on over a row's start
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def place_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for every word, lower-cased in A-Z, from running sums over a stretch of words at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STRETCH)))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(max(STRETCH * 2, b - a))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[body[a:b]] * up[: b - a], out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * down[s]
        i = j
    return mix(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of the column, lower-cased in A-Z, and the bounds of each row's words."""
    body, bounds = column_bytes(column)
    starts, ends = word_places(body, bounds)
    return place_hashes(body, starts, ends), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all k-word shingles, repeats included, and each row's bounds.

    A row of fewer words has its whole sequence as one; a row without words none.
    """
    n, counts = len(words), np.diff(bounds)
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        runs += words[j : n - k + 1 + j] * _PLACES[j]
    wide = np.maximum(counts - k + 1, 0)
    # Start of each row's shingles among all runs, those across rows left out.
    take = np.repeat(bounds[:-1] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
    out, sizes = mix(runs[take]) if len(take) else np.zeros(0, np.uint64), wide.copy()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        ends = np.cumsum(sizes)
        place = np.arange(int(counts[short].sum())) - np.repeat(np.cumsum(counts[short]) - counts[short], counts[short])
        own = words[np.repeat(bounds[short], counts[short]) + place] * _PLACES[place]
        own = mix(np.add.reduceat(own, np.flatnonzero(place == 0)) + counts[short].astype(np.uint64) * _STEP)
        out = np.insert(out, ends[short], own)
        sizes[short] = 1
    return out, np.concatenate([[0], np.cumsum(sizes)])


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every row."""
    hashes, bounds = shingle_hashes(*word_hashes(column), k)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
