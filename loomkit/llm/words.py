"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SEPARATORS, mix

#: Bytes whose words are hashed together.
PART = 1 << 20
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LETTER = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n, modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        held = np.full(max(n, PART) + 1, base, np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if n <= 4 * PART:
            _powers[base] = held
    return held


def texts_at_a_time(offsets: np.ndarray, limit: int = 2 * PART) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that have about `limit` bytes; a longer text is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, A-Z taken as a-z; number of words of each text)."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = ~_IS_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(stops, low + PART, "right")))
        size = int(stops[b - 1]) - low
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_LETTER[data[low : low + size]] * _power(_BASE, size)[:size], dtype=np.uint64, out=sums[1:])
        s, e = starts[a:b] - low, stops[a:b] - low
        out[a:b] = (sums[e] - sums[s]) * _power(_INVERSE, size)[s] + (e - s).astype(np.uint64)
        a = b
    return mix(out), counts


def joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` successive hashes."""
    out = hashes[: max(0, len(hashes) - size + 1)].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += hashes[k : k + len(out)]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, sorted in it; number of each text's).

    Texts with fewer than `size` words have one shingle, all their words; those without words have none.
    """
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    runs = joined(words, size)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for k, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if n >= size:
            own = np.sort(runs[end - n : end - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = joined(words[end - n : end], n) + np.uint64(n)
        else:
            continue
        out.append(own)
        sizes[k] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes
