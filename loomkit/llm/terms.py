"""Places and hashes of the terms of many texts at once, in numpy, for any class of bytes that terms consist of."""

from __future__ import annotations

import numpy as np

from .common import mix
from .words import _BASE, _INVERSE, _LETTER, PART, _power


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of each maximal run of bytes that `inside` names; number of each text's). No run crosses texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    within = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, stop = within.copy(), within.copy()
    start[1:] &= ~within[:-1] | edge[1:-1]
    stop[:-1] &= ~within[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, stops, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, A-Z taken as a-z; spans lie in order and don't overlap."""
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
    return mix(out)


def span_bytes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes, joined, A-Z as a-z, and their n + 1 offsets."""
    sizes = stops - starts
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])].copy()
    capital = (out >= 65) & (out <= 90)
    out[capital] += 32
    return out, ends


def places(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The index of each key in the sorted array `known`, -1 where it isn't there."""
    if not len(known):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)
