"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five words that a document shares with a benchmark item, joined by rolling hash.  For each document
and item with a seed in common, the longest matches are marked one after another, each word of either side in one tile
at most, until none of five words is left (running Karp-Rabin greedy string tiling, with the matches read off the
diagonals of shared seeds, or by length where words repeat so often that the pairs of seeds are too many to list).  The
item's share of marked words is its coverage; passages whose parts come in another order are covered all the same.  A
document is contaminated by an item when coverage reaches the threshold.

The items are the query set: blocks of them, bounded in words whatever the benchmark's size, are held against all
documents one after another, so documents are never shuffled.  Null and empty texts match nothing; items of fewer than
five words, which stand in clean texts by chance, match nothing (a smaller ``least`` finds them); rows that repeat an id are reported once for each row; rows with a null id
are searched like any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of, written
from .tokens import powers_of, tokens, windows

LEAST = 5
COVERAGE = 0.5
#: Characters of item texts that a block holds about, which bounds what is sent to executors.
BLOCK_CHARS = 16 << 20


def tiles(item_at: np.ndarray, doc_at: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(length, item place, document place)`` of the tiles, given the places of all shared runs of ``least`` words.
    Ties go to the earlier item place, then the earlier document place."""
    order = np.lexsort((item_at, doc_at - item_at))
    i, j = item_at[order], doc_at[order]
    new = np.flatnonzero(np.append(True, (np.diff(j - i) != 0) | (np.diff(i) != 1)))
    lengths = np.diff(np.append(new, len(i))) + least - 1
    heap = list(zip((-lengths).tolist(), i[new].tolist(), j[new].tolist(), strict=True))
    heapq.heapify(heap)
    used_i: set[int] = set()
    used_j: set[int] = set()
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + k not in used_i and b + k not in used_j for k in range(-n)]
        if all(free):
            out.append((-n, a, b))
            used_i.update(range(a, a - n))
            used_j.update(range(b, b - n))
            continue
        run = 0  # what is left of the match on either side of marked words
        for k, ok in enumerate([*free, False]):
            if ok:
                run += 1
                continue
            if run >= least:
                heapq.heappush(heap, (-run, a + k - run, b + k - run))
            run = 0
    return out


def _prefix_hashes(words: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=out[1:])
    return out


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Places where a run of ``n`` words begins of which none is marked."""
    sums = np.append(0, np.cumsum(marked))
    return np.flatnonzero(sums[n:] == sums[:-n]) if len(marked) >= n else np.zeros(0, np.int64)


def tiles_by_length(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The tiles of two texts' words by running Karp-Rabin: the longest length at which an unmarked run of one is an unmarked
    run of the other is found by halving, all such runs are marked, and so on down to ``least``.  Memory follows the two
    texts, however often words repeat in them."""
    powers = powers_of(max(len(item), len(doc)) + 1)
    sums = [_prefix_hashes(x, powers) for x in (item, doc)]
    marks = [np.zeros(len(x), bool) for x in (item, doc)]
    last = powers[len(powers) - 1 :: -1]

    def runs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and rolling hashes of unmarked runs, the hashes brought to the highest power."""
        at = [_free(m, n) for m in marks]
        return [(p, (h[p + n] - h[p]) * last[p]) for p, h in zip(at, sums, strict=True)]

    out, high = [], min(len(item), len(doc))
    while high >= least:
        low, top = least - 1, high  # runs of length low are shared, unless it is least - 1
        while low < top:
            mid = (low + top + 1) // 2
            (_, x), (_, y) = runs(mid)
            low, top = (mid, top) if len(x) and len(y) and np.isin(x, y).any() else (low, mid - 1)
        if low < least:
            break
        n = low
        (at, x), (there, y) = runs(n)
        order = np.argsort(y, kind="stable")
        keys, begin = np.unique(y[order], return_index=True)
        places, end = there[order], np.append(begin[1:], len(y))
        nexts = begin.copy()
        k = np.searchsorted(keys, x).clip(max=len(keys) - 1)
        for i, kk in zip(at[keys[k] == x].tolist(), k[keys[k] == x].tolist(), strict=True):
            if marks[0][i] or marks[0][i + n - 1]:
                continue
            while nexts[kk] < end[kk]:  # what is marked stays so, so no place is looked at twice
                j = int(places[nexts[kk]])
                if not marks[1][j] and not marks[1][j + n - 1] and (item[i : i + n] == doc[j : j + n]).all():
                    out.append((n, i, j))
                    marks[0][i : i + n] = marks[1][j : j + n] = True
                    break
                nexts[kk] += 1
        high = n - 1
    return out


class Items:
    """A block of benchmark items with an index of their seeds."""

    def __init__(self, ids: list, texts: list[str], least: int = LEAST) -> None:
        hashes, at, _ = tokens(texts)
        self.ids, self.least = ids, least
        self.hashes, self.at, self.words = hashes, at, np.diff(at)
        where = np.repeat(np.arange(len(ids)), self.words)
        place = np.arange(len(hashes)) - at[where]
        seeds = windows(hashes, least)
        ok = np.flatnonzero(where[: len(seeds)] == where[len(hashes) - len(seeds) :]) if len(seeds) else np.zeros(0, np.int64)
        order = ok[np.argsort(seeds[ok], kind="stable")]
        self.seeds, self.item, self.place = seeds[order], where[order].astype(np.int32), place[order].astype(np.int32)
        # a table of the seeds' first 22 bits tells most words' runs apart before any search
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def search(self, texts: list[str], coverage: float = 0) -> list[tuple[int, int, int, int]]:
        """``(text, item, marked words, tiles)`` for each pair with a seed in common, but for those whose shared seeds hold
        less than ``coverage`` of the item's words."""
        hashes, at, _ = tokens(texts)
        runs = windows(hashes, self.least)
        hit = np.flatnonzero(self.bits[(runs >> np.uint64(42)).astype(np.int64)])
        low, high = (np.searchsorted(self.seeds, runs[hit], side=s) for s in ("left", "right"))
        found = high > low
        hit, low, high = hit[found], low[found], high[found]
        text = np.searchsorted(at, hit, side="right") - 1
        inside = hit + self.least <= at[text + 1]
        hit, low, high, text = hit[inside], low[inside], high[inside], text[inside]
        out: list[tuple[int, int, int, int]] = []
        if not len(hit):
            return out
        cut = np.flatnonzero(np.diff(text)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(text)).tolist(), strict=True):
            t = int(text[a])
            out += ((t, *row) for row in self._one(hashes[at[t] : at[t + 1]], hit[a:b] - at[t], low[a:b], high[a:b], coverage))
        return out

    def _one(self, doc: np.ndarray, hit: np.ndarray, low: np.ndarray, high: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int]]:
        """The items of one text, whose runs at ``hit`` are the seeds from ``low`` to ``high``."""
        first, at = np.unique(low, return_index=True)  # each seed once, however often the text has it
        n = high[at] - first
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        item, place = self.item[entry], self.place[entry].astype(np.int64)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        new = np.append(True, item[1:] != item[:-1])
        # words that seeds hold: each one's own, less what the one before holds of them
        held = np.where(new, self.least, np.minimum(self.least, np.diff(place, prepend=0)))
        begins = np.flatnonzero(new)
        held = np.add.reduceat(held, begins)
        several = np.add.reduceat(np.ones(len(item), np.int64), begins)
        items = item[begins]
        keep = held >= coverage * self.words[items]
        items, several = items[keep], several[keep]
        if not len(items):
            return
        if int((high - low).sum()) > 4 * (len(hit) + len(entry)):  # seeds that both sides repeat: their pairs are too many to list
            for i in items.tolist():
                marked = tiles_by_length(self.hashes[self.at[i] : self.at[i + 1]], doc, self.least)
                yield i, sum(n for n, _, _ in marked), len(marked)
            return
        n = high - low
        row = np.repeat(np.arange(len(hit)), n)
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[row]
        entry, row = entry[use := np.isin(self.item[entry], items)], row[use]
        item, item_at, doc_at = self.item[entry], self.place[entry].astype(np.int64), hit[row]
        order = np.argsort(item, kind="stable")
        item, item_at, doc_at = item[order], item_at[order], doc_at[order]
        cut = np.flatnonzero(np.diff(item)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(item)).tolist(), strict=True):
            marked = tiles(item_at[a:b], doc_at[a:b], self.least)
            yield int(item[a]), sum(n for n, _, _ in marked), len(marked)


def _search(docs: DataFrame, items: Items, coverage: float, schema: T.StructType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by the block's size

    def run(batches):
        own = shared.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        for batch in batches:
            for part in slices(batch, max_bytes=2 << 20):
                ids = part.column(0).to_pylist()
                rows = [(ids[t], own.ids[i], marked, marked / int(own.words[i]), n) for t, i, marked, n in own.search(texts_of(part), coverage) if marked >= coverage * own.words[i]]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=schema.names)

    return docs.mapInArrow(run, schema)


def blocks_of(benchmark: DataFrame, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, Items]]:
    """``(number of blocks, items)`` for each block of ``benchmark(item_id, text)``."""
    items = benchmark.select(F.col("item_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(chars) // block_chars) or 1
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        got = block.orderBy("item_id", "text").toArrow().to_pydict()
        yield blocks, Items(got["item_id"], got["text"], least)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, matched_words, coverage, tiles`` for each pair of ``docs(doc_id, text)`` and
    ``benchmark(item_id, text)`` whose coverage reaches the threshold."""
    own = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T._parse_datatype_string("doc_id long, item_id long, matched_words long, coverage double, tiles long")
    found = None
    for blocks, items in blocks_of(benchmark, least, block_chars):
        part = _search(own, items, coverage, schema)
        if blocks > 1:
            part = written(part, "tiled")
        found = part if found is None else found.unionAll(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates."""
    for blocks, items in blocks_of(benchmark, least, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by the block's size

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                for part in slices(batch, max_bytes=2 << 20):
                    keep = np.ones(part.num_rows, bool)
                    keep[[t for t, i, marked, _ in own.search(texts_of(part), coverage) if marked >= coverage * own.words[i]]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if blocks > 1:
            docs = written(docs, "clean")
    return docs
