"""Toxicity scores by a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

Features are the presence of byte n-grams (orders 4 to 8, with the blanks around words) of the lower-cased whole text,
known by 32-bit hashes.  For each n-gram the log ratio of its smoothed frequencies in toxic and in other training documents
scales the feature; logistic regression on the scaled features gives the weights.  Counts stay on the executors; only
n-grams that are frequent enough and mark toxic documents come to the driver.  Scores are calibrated by the regression itself: 0.5 is its boundary.

Null and empty texts have no n-gram and score by the intercept alone.  Repeated rows get equal scores.  Labels that
are null, or whose document is missing, are left out; with labels of one kind only, every score is that kind's side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, slices, texts_of, written

#: Labelled documents that a fit looks at, at most: those with the smallest hash of the id.
FIT_ROWS = 8000
ORDERS = (4, 5, 6, 7, 8)
LEAST_SHARE, EVEN = 0.002, 1.5
_BLOCK = 1 << 20  # bytes of one text hashed at a time


def grams(text: str, useful: np.ndarray | None = None) -> np.ndarray:
    """The distinct 32-bit hashes of a text's n-grams, in order; only those that ``useful``, a table of their first 22 bits,
    lets pass.  Memory follows a block of the text and what is found."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    out = np.zeros(0, np.uint32)
    for at in range(0, len(data), _BLOCK):
        parts = [out]
        raw = data[at : at + _BLOCK + max(ORDERS) - 1].astype(np.uint32)
        h = raw
        for order in range(2, max(ORDERS) + 1):
            n = len(raw) - order + 1
            if n <= 0:
                break
            h = h[:n] * np.uint32(0x01000193) + raw[order - 1 :]
            if order in ORDERS:
                g = (h + np.uint32(order)) * np.uint32(0x9E3779B1)
                g ^= g >> np.uint32(15)
                parts.append(g if useful is None else g[useful[g >> np.uint32(10)]])
        out = np.unique(np.concatenate(parts))
    return out


@dataclass
class Scorer:
    """``weights`` of n-grams ``ids``, in order: regression weight times log-count ratio."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.useful = np.zeros(1 << 22, bool)
        self.useful[self.ids >> np.uint32(10)] = True

    def places(self, text: str) -> np.ndarray:
        """Which of ``ids`` a text has."""
        own = grams(text, self.useful)
        at = np.searchsorted(self.ids, own).clip(max=max(len(self.ids) - 1, 0))
        return at[self.ids[at] == own] if len(self.ids) else at

    def score(self, texts: list[str]) -> np.ndarray:
        z = np.array([self.weights[self.places(t)].sum() for t in texts], float) + self.bias
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def log_count_ratio(up: Column, down: Column, all_up: float, all_down: float, size: float) -> Column:
    """Log ratio of an n-gram's smoothed frequency in toxic (``up``) and other training documents, of ``size`` n-grams that are
    counted ``all_up`` and ``all_down`` times."""
    return F.log((up + 1.0) / F.lit(all_up + size)) - F.log((down + 1.0) / F.lit(all_down + size))


def counts(sample: DataFrame) -> DataFrame:
    """``gram, up, down`` of ``sample(doc_id, mark, text)``: how many toxic and other documents have each n-gram.  A task adds
    up a block of documents before it sends anything."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=8 << 20):
                marks = np.array([m == 1 for m in part.column(1).to_pylist()], bool)
                own = [grams(t) for t in texts_of(part)]
                ids, at = np.unique(np.concatenate(own), return_inverse=True)
                row = np.repeat(marks, [len(g) for g in own])
                up, down = (np.bincount(at[row == k], minlength=len(ids)) for k in (True, False))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(up.astype(np.int32)), pa.array(down.astype(np.int32))], ["gram", "up", "down"])

    return sample.mapInArrow(run, "gram long, up int, down int").groupBy("gram").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def ratios(table: DataFrame, n: int, least: float = LEAST_SHARE, even: float = EVEN) -> tuple[np.ndarray, np.ndarray]:
    """``ids, ratios`` of the n-grams of ``table(gram, up, down)`` that mark toxic documents, of ``n`` in all; those rare among
    the documents, even or commoner in others stay behind: a toxic text is clean but for a few words, so that what is clean
    in it says nothing.  What comes to the driver is in at least ``least`` of the sampled documents each."""
    size, up, down = table.agg(F.count("*"), F.sum("up"), F.sum("down")).first()
    if not size:
        return np.zeros(0, np.uint32), np.zeros(0)
    rows = table.where(F.col("up") + F.col("down") >= max(4.0, least * n))
    rows = rows.withColumn("ratio", log_count_ratio(F.col("up"), F.col("down"), float(up), float(down), float(size))).where(F.col("ratio") >= even)
    got = rows.select("gram", "ratio").toArrow().sort_by("gram")
    return got["gram"].to_numpy().astype(np.uint32), got["ratio"].to_numpy()


def fit_scorer(docs: list[np.ndarray], toxic: np.ndarray, ids: np.ndarray, ratio: np.ndarray, steps: int = 300, ridge: float = 2e-4) -> Scorer:
    """docs: the places in ``ids`` of each one's n-grams; toxic: their marks; ratio: the features' scales.  The weights
    minimise the logistic loss, in which both marks weigh the same, plus ``ridge / 2`` times their squares."""
    n = len(docs)
    if not n or toxic.all() or not toxic.any():
        return Scorer(ids, np.zeros(len(ids)), 0.0 if not n else 6.0 if toxic.all() else -6.0)
    col = np.concatenate(docs).astype(np.int64)
    row = np.repeat(np.arange(n), [len(d) for d in docs])
    x = ratio[col]
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    w, b = np.zeros(len(ids)), 0.0
    m, v, mb, vb = w.copy(), w.copy(), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on all rows
        z = np.bincount(row, weights=x * w[col], minlength=n) + b
        e = (1 / (1 + np.exp(-z.clip(-30, 30))) - toxic) * share
        g = np.bincount(col, weights=x * e[row], minlength=len(ids)) + ridge * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        rate = min(1.0, 3 * (1 - t / (steps + 1)))
        w -= rate * 0.02 * (m / c) / (np.sqrt(v / d) + 1e-7)
        b -= rate * 0.05 * (mb / c) / (np.sqrt(vb / d) + 1e-7)
    return Scorer(ids, w * ratio, float(b))


def learn(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = FIT_ROWS) -> Scorer:
    """Fit on at most ``rows`` labelled documents, half of them toxic where there are as many; ``keep``: which ids may be
    learned from.  Of an id's several labels the smaller counts, of its several texts the one with the smallest digest."""
    spark = docs.sparkSession
    chosen = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("mark")).where("doc_id is not null and mark is not null")
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy("doc_id").agg(F.min("mark").alias("mark"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = chosen.where("mark = 1").orderBy(*order).limit(rows // 2).unionAll(chosen.where("mark <> 1").orderBy(*order).limit(rows - rows // 2))
    picked = spark.createDataFrame(chosen.toPandas().astype("int64"), "doc_id long, mark long")

    # the picked ids are at most ``rows``, so they are small enough to send to every executor
    found = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "mark", "text")
    sample = written(found.groupBy("doc_id", "mark").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text")), "toxic-sample")
    ids, ratio = ratios(written(counts(sample), "toxic-grams"), picked.count())
    own = Scorer(ids, ratio, 0.0)

    def select(batches):
        for batch in batches:
            for part in slices(batch):
                x = [own.places(t).astype(np.uint32).tobytes() for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], ["doc_id", "mark", "x"])

    got = sample.mapInArrow(select, "doc_id long, mark long, x binary").toArrow().sort_by("doc_id").to_pydict()
    return fit_scorer([np.frombuffer(x, np.uint32) for x in got["x"]], np.array([m == 1 for m in got["mark"]], bool), ids, ratio)


def with_score(docs: DataFrame, scorer: Scorer, name: str) -> DataFrame:
    """All columns of ``docs`` (it has ``text``) and the score, without a shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by the sample that was learned from

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(texts_of(part)))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> DataFrame:
    """``doc_id, score`` for each row of ``docs(doc_id, text)``."""
    own = id_text(docs)
    return with_score(own, learn(own, labels, keep), "score").select("doc_id", "score")
