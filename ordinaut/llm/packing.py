"""Best-two-fit packing of documents into fixed-length token sequences.

Lengths are whole numbers up to the sequence length, so the packing is worked out on their histogram, whose size does
not depend on the input: a plan is a list of bins (multisets of lengths) with the number of times each is used.  A bin
takes the longest piece left, is filled greedily with the longest that fit, and then its smallest piece is replaced by
two unpacked pieces where these fit the expanded gap more tightly.  The bin is used as often as the counts allow, which
uses up at least one length, so that the plan stays a few thousand bins long.  Pieces then take the plan's places by
their rank among the pieces of their length; ranks come from counts by (length, block), never from one ordered task.

A null or empty text is the closing id alone.  Repeated rows are packed like any others: pieces of equal length take
their places by numbers of their own, which are arbitrary but fixed in the written table of pieces.  An empty table gives no rows.  A text of
any length is tokenised whole.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, texts_of, written

SEQUENCE = 2048
TOKENIZER = "byte_bpe_50k.json"
_CACHE = 600_000  # remembered pieces of text, about 130 MB


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to those of ``tokenizers`` without special tokens added.

    The tokenizer never joins what stands before a single space between two non-blank characters with what follows, so a
    text is the concatenation of its space-led pieces' ids, and these are remembered.  New pieces, and texts with other
    white space at a cut, go through the same vocabulary's merges in ``tiktoken``, which takes a fifth of the time;
    texts with a special token's string go through ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): n for token, n in vocabulary.items() if token not in self.special}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.encode(text)).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) + len(self.first) > _CACHE:
            self.known.clear()
            self.first.clear()
        known, first = self.known, self.first
        cut = [t.split(" ") for t in texts]
        encode = self.encode
        for w in {w for words in cut for w in words[1:]}.difference(known):
            if w and not w[0].isspace() and not w[-1].isspace():
                known[w] = array("I", encode(" " + w)).tobytes()
        for w in {words[0] for words in cut}.difference(first):
            if w and not w[-1].isspace():
                first[w] = array("I", encode(w)).tobytes()
        out: list[bytes] = []
        for text, words in zip(texts, cut, strict=True):
            try:
                if any(s in text for s in self.special):
                    raise KeyError
                out.append(first[words[0]] + b"".join(map(known.__getitem__, words[1:])))
            except KeyError:
                out.append(self._whole(text))
        return out


def pieces(docs: DataFrame, path: str, limit: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each text's ids and a closing id 0.  Longer ones are cut into pieces
    of ``limit``, of which the first may be shorter."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encode = _encoder(path)
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                where, rows = [], []
                for i, ids in enumerate(encode(texts_of(part))):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    at, end, k = 0, n % limit or min(n, limit), 0
                    while at < n:
                        where.append(i)
                        rows.append((k, at, end - at, zlib.crc32(memoryview(ids)[4 * at : 4 * end])))
                        at, end, k = end, end + limit, k + 1
                cols = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where, pa.int64())), *cols], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each Python worker: what it has learned serves the worker's later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def plan(histogram: Iterable[tuple[int, int]], limit: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """``(times, lengths)`` of each bin for a histogram ``(length, count)``."""
    left = np.zeros(limit + 1, np.int64)
    for length, count in histogram:
        left[length] += count
    out: list[tuple[int, list[int]]] = []

    each = np.arange(limit + 1)

    def longest() -> np.ndarray:
        """For each length the longest one left that is no longer, or 0."""
        return np.maximum.accumulate(np.where(left > 0, each, 0))

    while first := int(longest()[limit]):
        took, gap = [first], limit - first
        left[first] -= 1
        while gap and (k := int(longest()[gap])):
            took.append(k)
            left[k] -= 1
            gap -= k
        if gap and len(took) > 1:  # two for the smallest, where they leave less
            small = min(took)
            room, below = gap + small, longest()
            one = np.flatnonzero(left[1:room]) + 1
            two = below[np.minimum(one, room - one)]
            two = np.where((two == one) & (left[one] < 2), below[two - 1], two)
            sums = np.where(two > 0, one + two, 0)
            if len(sums) and sums.max() > small:
                best = int(sums.argmax())
                took.remove(small)
                left[small] += 1
                for k in (int(one[best]), int(two[best])):
                    took.append(k)
                    left[k] -= 1
        lengths, uses = np.unique(took, return_counts=True)
        more = int((left[lengths] // uses).min())
        left[lengths] -= more * uses
        out.append((1 + more, sorted(took, reverse=True)))
    return out


def places(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, begin, end, uses, sequence, offset of the first``: pieces of a length with ranks in [begin, end) fill a run
    of ``(end - begin) / uses`` equal bins from ``sequence`` on, ``uses`` in each, one after another from ``offset``."""
    out, used, sequence = [], {}, 0
    for times, took in bins:
        at = 0
        lengths, uses = np.unique(took, return_counts=True)
        for length, n in zip(lengths[::-1].tolist(), uses[::-1].tolist(), strict=True):
            begin = used.get(length, 0)
            used[length] = begin + times * n
            out.append((length, begin, used[length], n, sequence, at))
            at += length * n
        sequence += times
    return out


def ranked(table: DataFrame, by: str, order: list[str], blocks: int, name: str = "rank") -> DataFrame:
    """The rank (from 0) of each row among those with the same ``by``, for a written ``table``: row numbers within
    (by, block) plus the counts of the earlier blocks, so that a frequent value is dealt over all blocks."""
    block = F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int")
    rows = table.withColumn("_block", block)
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(by, "_block").orderBy(*order)
    rows = rows.withColumn("_row", F.row_number().over(inner))
    return rows.join(counts, [by, "_block"]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_block", "_before", "_row")


def pack(docs: DataFrame, path: str, limit: int = SEQUENCE) -> DataFrame:
    """``docs(doc_id, text)`` packed: a row for each piece with its sequence and place."""
    table = written(pieces(docs, path, limit).withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    histogram = table.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``limit`` rows
    bins = plan(((r.length, r.n) for r in histogram), limit)
    total = sum(r.n for r in histogram)
    spark = docs.sparkSession
    schema = "length long, _begin long, _end long, _uses long, _sequence long, _at long"
    slots = spark.createDataFrame(pa.table(list(zip(*places(bins), strict=True)) or [[]] * 6, names=["length", "_begin", "_end", "_uses", "_sequence", "_at"]).to_pandas().astype("int64"), schema)
    own = ranked(table, "length", ["_piece"], blocks=max(8, total // 20_000))
    # the plan's size follows the sequence length alone, so it is small enough to send to every executor
    placed = own.join(F.broadcast(slots), "length").where("rank >= _begin and rank < _end")
    step = F.col("rank") - F.col("_begin")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(step / F.col("_uses"))).alias("sequence_id"),
        (F.col("_at") + (step % F.col("_uses")) * F.col("length")).alias("offset"),
    )
