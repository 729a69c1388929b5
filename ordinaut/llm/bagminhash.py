"""BagMinHash signatures of multisets, by the hierarchical Poisson processes of the published method.

A multiset gives each element a weight, its multiplicity.  Weights are discretised to whole levels, and over the axis of
levels runs one Poisson process for each element, of rate 1 a level.  Each point has a time, a level and a register; an
element of weight w sees the points of its levels below w, and a register keeps its earliest point.  Two multisets then
agree in a register with the probability of their weighted Jaccard similarity (sum of minima over sum of maxima).

The process is kept as a hierarchy of dyadic intervals [0,1), [1,2), [2,4), [4,8), ... and their halves, each with a seed of
its own.  An interval's next point comes after an exponential time of its length.  Then the interval is split in halves
until the point has a level to itself; each half without the point goes on as a process of its own from that time.  So what
is drawn for an interval depends on the element alone and never on its weight; halves at or above the weight are dropped
unseen, and so is every process that is later than the latest register of its text.
"""

from __future__ import annotations

import numpy as np

from .tokens import mix

_U = np.uint64
_STEP, _PLACE, _HALF = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7)


def _roots(n: int, keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """``document, weight, begin, length, seed`` of the intervals that a split of [0, 2^k) down to its first level leaves."""
    doc = np.repeat(np.arange(n), np.array([len(k) for k in keys], np.int64))
    key = np.concatenate(keys) if n else np.zeros(0, np.uint64)
    weight = np.concatenate(weights).astype(np.int64) if n else np.zeros(0, np.int64)
    # intervals 0..top of each element, where top is the one with level weight - 1
    top = np.frexp(np.maximum(weight - 1, 0).astype(float))[1].astype(np.int64)
    at = np.repeat(np.arange(len(key)), top + 1)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    begin = np.where(piece > 0, np.int64(1) << np.maximum(piece - 1, 0), 0)
    return doc[at], weight[at], begin, np.maximum(begin, 1), mix(key[at] + mix((piece.astype(np.uint64) + _U(1)) * _PLACE))


def signatures(keys: list[np.ndarray], weights: list[np.ndarray], registers: int) -> np.ndarray:
    """A row of ``registers`` 64-bit values for each multiset, elements ``keys[i]`` (distinct) with whole weights
    ``weights[i]``.  An empty multiset's row is all ones, the value of no point."""
    n = len(keys)
    doc, weight, begin, length, seed = _roots(n, keys, weights)
    first = np.full(n * registers, np.inf)
    value = np.full(n * registers, ~_U(0), np.uint64)
    time = np.zeros(len(seed))
    while len(seed):
        draw = mix(seed + _STEP)
        time = time - np.log1p(-(draw >> _U(11)).astype(float) * 2.0**-53) / length
        spot = mix(draw ^ _PLACE)
        level = begin + ((spot >> _U(32)) % length.astype(np.uint64)).astype(np.int64)
        register = doc * registers + (spot % _U(registers)).astype(np.int64)
        seen = np.flatnonzero(level < weight)
        seen = seen[time[seen] < first[register[seen]]]
        if len(seen):
            order = seen[np.argsort(-time[seen], kind="stable")]  # the earliest is written last
            first[register[order]] = time[order]
            value[register[order]] = spot[order]
        latest = first.reshape(n, registers).max(1)
        go = time < latest[doc]
        doc, weight, begin, length, seed, time, level = (x[go] for x in (doc, weight, begin, length, draw, time, level))
        if not (length > 1).any():
            continue
        parts = []
        while len(wide := np.flatnonzero(length > 1)):
            half = length[wide] // 2
            right = level[wide] >= begin[wide] + half
            # the half without the point: a process of its own, if any of its levels is seen
            other = np.where(right, begin[wide], begin[wide] + half)
            use = other < weight[wide]
            own = mix(seed[wide] ^ (half.astype(np.uint64) * _HALF))
            parts.append((doc[wide][use], weight[wide][use], other[use], half[use], own[use], time[wide][use]))
            begin[wide] = np.where(right, begin[wide] + half, begin[wide])
            length[wide] = half
        use = begin < weight  # a point above the weight ends its level's process
        parts.append((doc[use], weight[use], begin[use], length[use], seed[use], time[use]))
        doc, weight, begin, length, seed, time = (np.concatenate(x) for x in zip(*parts, strict=True))
    return value.reshape(n, registers)


def band_keys(rows: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """One 64-bit key for each band of ``per_band`` registers, different for different bands."""
    out = np.zeros((len(rows), bands), np.uint64)
    for k in range(per_band):
        out = mix(out * _STEP + rows[:, k : bands * per_band : per_band])
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * _PLACE)
