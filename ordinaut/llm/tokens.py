"""Vectorised word tokens, word shingles and their 64-bit hashes.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters, after lower-casing.  Hashes are
equal on every machine and in every run.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = np.ones(1, np.uint64)


def powers_of(n: int) -> np.ndarray:
    """Powers of the rolling hash's base, ``n`` at least."""
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 256), _BASE, np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, offsets, lengths)``: the words of text ``i`` are ``hashes[offsets[i]:offsets[i + 1]]``; ``lengths``
    are the words' sizes in bytes."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begins[1:])
    word = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    sizes = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(parts) + 1, np.int64), sizes
    power = powers_of(int(sizes.max()) + 1)
    inside = data[word]
    first = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=first[1:])
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    hashes = mix(np.add.reduceat(_BYTE[inside] * power[place], first) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(starts, begins), sizes


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _BASE
        out += hashes[k : k + n]
    return mix(out)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Shingle hashes of one text; a text of fewer words is one shingle of all its words, one of none has no shingle."""
    if 0 < len(hashes) < width:
        return windows(hashes, len(hashes)) ^ _U(len(hashes))
    return windows(hashes, width)


def bag(hashes: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of one text, in order, and how often it has each."""
    return np.unique(shingles(hashes, width), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of the counts of two bags; 1 for two empty ones."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][ia], b[1][ib]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def multiset_jaccard(a: np.ndarray, b: np.ndarray, width: int = 5) -> float:
    """The similarity of two texts' words."""
    return similarity(bag(a, width), bag(b, width))
