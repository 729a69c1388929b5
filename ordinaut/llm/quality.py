"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in whole-text statistics (character classes, word and line repetition, lengths).
The weights maximise the Bradley-Terry likelihood of preference pairs (a document marked good is preferred to one
marked bad): logistic loss on feature differences.  They are fitted on a bounded sample of both marks; the features'
means and scales are those of all documents, and the cut is the exact quantile of the strengths of all labelled
documents, that of the share of bad ones among them.  A score is the logistic of the strength's distance from the cut,
so 0.5 is the cut.

Null and empty texts are scored like any text (all statistics 0).  Repeated rows get equal scores.  Labels that are
null, or whose document is missing, are left out; with no pair of labels to learn from, every score is 0.5.  Of an id's
several labels the smaller counts, of its several texts the one with the smallest statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, texts_of, written
from .tokens import tokens, windows

#: Labelled documents that a fit looks at, at most: those of either mark with the smallest hash of the id.
FIT_ROWS = 6000
#: The quantile is bracketed to one in so many rows, then counted exactly.
ACCURACY = 100_000
PAIRS = 60_000

_CLASSES = np.full(256, 9, np.int64)  # other symbols
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".,;:", "!?", "|\t", "'\"()-")):
    _CLASSES[[ord(c) for c in _chars]] = _k
_CLASSES[128:] = 10
_N_CLASSES = 11
N_FEATURES = 2 * _N_CLASSES + 9


def features(texts: list[str]) -> np.ndarray:
    """One row of statistics for each text."""
    out = np.zeros((len(texts), N_FEATURES))
    hashes, at, sizes = tokens(texts)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if not len(raw):
            continue
        share = np.bincount(_CLASSES[raw], minlength=_N_CLASSES) / len(raw)
        words, size = hashes[at[i] : at[i + 1]], sizes[at[i] : at[i + 1]]
        n = len(words)
        lines = text.split("\n")
        out[i, : 2 * _N_CLASSES] = np.concatenate((share, np.sqrt(share)))
        out[i, 2 * _N_CLASSES :] = (
            math.log1p(n),
            size.mean() if n else 0,
            size.std() if n else 0,
            len(np.unique(words)) / n if n else 0,
            len(np.unique(windows(words, 3))) / (n - 2) if n > 2 else 1,
            (words[1:] == words[:-1]).mean() if n > 1 else 0,
            len(set(lines)) / len(lines),
            math.log1p(len(raw) / len(lines)),
            n / len(raw),
        )
    return out


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        # a sum of its own for each row: a product's last bits depend on how many rows it has, and a row at the cut on those
        return (((x - self.mean) / self.scale).clip(-6, 6) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-((self.strength(x) - self.cut) / self.spread).clip(-30, 30)))


def drawn_pairs(good: np.ndarray, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the preferred and the other document of each pair, each document being in about as many as any other of its
    mark."""
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    draw = np.random.default_rng(7)
    n = min(most, 20 * len(good))
    return np.resize(draw.permutation(up), n), draw.permutation(np.resize(down, n))


def fit_ranker(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = 300, ridge: float = 1e-3, moments: tuple[np.ndarray, np.ndarray] | None = None) -> Ranker:
    """Weights that maximise the likelihood of (good, bad) pairs, less ``ridge / 2`` times their squares.  ``moments``: the
    features' means and scales, where ``x`` is a sample."""
    mean, scale = moments or ((x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES)))
    z = ((x - mean) / scale).clip(-6, 6)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Ranker(mean, scale, np.zeros(N_FEATURES), 0.0, 1.0)
    first, other = drawn_pairs(good, pairs)
    d, n = z[first] - z[other], len(first)
    w = np.zeros(z.shape[1])
    m, v = w.copy(), w.copy()
    for t in range(1, steps + 1):  # Adam on the whole of the pairs
        p = 1 / (1 + np.exp((d @ w).clip(-30, 30)))
        g = -(p @ d) / n + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    strength = np.sort(z @ w)
    k = len(down)  # the quantile: as many training documents lie below the cut as are marked bad
    cut = (strength[k - 1] + strength[min(k, len(strength) - 1)]) / 2
    return Ranker(mean, scale, w, float(cut), float(strength.std() / 4 + 1e-9))


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of ``docs(doc_id, text)``, written."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(features(texts_of(part))), pa.list_(pa.float64()))], ["doc_id", "x"])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>"), "features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_FEATURES)


def moments(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and scales of all rows of ``table(x)``; one row of sums a task comes to the driver."""

    def run(batches):
        n, mean, square = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for batch in batches:
            if k := batch.num_rows:
                x = _matrix(batch.column(0))
                own, apart = x.mean(0), x.mean(0) - mean
                square += ((x - own) ** 2).sum(0) + apart**2 * (n * k / (n + k))
                mean, n = mean + apart * (k / (n + k)), n + k
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([square.tolist()])], ["n", "mean", "square"])

    got = sorted(tuple(r) for r in table.select("x").mapInArrow(run, "n long, mean array<double>, square array<double>").collect() if r.n)
    if not got:
        return np.zeros(N_FEATURES), np.ones(N_FEATURES)
    n, mean, square = (np.array(c, float) for c in zip(*got, strict=True))
    whole = (n @ mean) / n.sum()
    return whole, np.sqrt((square.sum(0) + n @ (mean - whole) ** 2) / n.sum()) + 1e-6


def _cut(strengths: DataFrame, k: int, n: int) -> float:
    """The middle between the ``k``-th and the next of ``n`` values ``strengths(s)``.  Few rows come to the driver: those
    by which an approximate quantile is wrong, at most."""
    near = strengths.agg(F.percentile_approx("s", k / n, ACCURACY)).first()[0]
    below = strengths.where(F.col("s") < near).count()
    upto = strengths.where(F.col("s") <= near).count()
    if below < k < upto:  # equal values on both sides
        return near
    if k <= below:
        down = [r.s for r in strengths.where(F.col("s") <= near).orderBy(F.desc("s")).limit(upto - k + 1).collect()]
        return (down[-1] + down[-2]) / 2
    up = [near, *(r.s for r in strengths.where(F.col("s") > near).orderBy("s").limit(k - upto + 1).collect())]
    return (up[k - upto] + up[min(k - upto + 1, len(up) - 1)]) / 2


def learn(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = FIT_ROWS) -> Ranker:
    """``learn_from`` the features of ``docs(doc_id, text)``."""
    return learn_from(featured(docs), labels, keep, rows)


def learn_from(table: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = FIT_ROWS) -> Ranker:
    """Fit on at most ``rows`` labelled documents of ``table(doc_id, x)``, half of them bad where there are as many; means and
    scales are those of the whole table, the cut that of all its labelled documents.  ``keep``: which ids may be learned from."""
    chosen = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("mark")).where("doc_id is not null and mark is not null")
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy("doc_id").agg(F.min("mark").alias("mark"))
    marked = written(table.join(chosen.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("mark").alias("mark"), F.min("x").alias("x")), "marked")
    counts = {bool(r.good): r.n for r in marked.groupBy((F.col("mark") == 1).alias("good")).agg(F.count("*").alias("n")).collect()}
    n_good, n_bad = counts.get(True, 0), counts.get(False, 0)
    # what one mark leaves free goes to the other
    bad = min(n_bad, max(rows // 2, rows - n_good))
    order = (F.xxhash64("doc_id"), "doc_id")
    got = [marked.where(which).orderBy(*order).limit(k).toPandas() for which, k in (("mark = 1", rows - bad), ("mark <> 1", bad))]
    x = np.array([v for g in got for v in g.x], float).reshape(-1, N_FEATURES)
    ranker = fit_ranker(x, np.repeat([True, False], [len(g) for g in got]), moments=moments(table))
    if not n_good or not n_bad:
        return ranker

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranker.strength(_matrix(batch.column(0))))], ["s"])

    strengths = written(marked.select("x").mapInArrow(run, "s double"), "strengths")
    ranker.spread = float(strengths.agg(F.stddev_pop("s")).first()[0] / 4 + 1e-9)
    # the quantile: as many labelled documents lie below the cut as are marked bad
    ranker.cut = float(_cut(strengths, n_bad, n_good + n_bad))
    return ranker


def with_score(docs: DataFrame, ranker: Ranker, name: str) -> DataFrame:
    """All columns of ``docs`` (it has ``text``) and the score, without a shuffle."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ranker.score(features(texts_of(part))))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> DataFrame:
    """``doc_id, score`` for each row of ``docs(doc_id, text)``."""
    table = featured(id_text(docs))
    ranker = learn_from(table, labels, keep)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double")
