"""Maps, fills, copies, replacements and slices: projections and filters that need no shuffle, except where two
sequences meet or positions must be counted anew."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, OutOfBounds
from ..partition import block_offset, block_owner, quotient
from ..plans.blockscan import kept_index
from ..seq import Seq

Rule = Callable[[Column], Column]


def transform(seq: Seq, rule: Rule) -> Seq:
    return seq.with_df(seq.df.withColumn(seq.value, rule(seq.v)))


def transform_indexed(seq: Seq, rule: Callable[[Column, Column], Column]) -> Seq:
    return seq.with_df(seq.df.withColumn(seq.value, rule(seq.idx, seq.v)))


def transform_python(seq: Seq, function: Callable, returns: str) -> Seq:
    """An opaque Python function of a pandas Series, in Arrow batches."""
    return seq.with_df(seq.df.withColumn(seq.value, F.pandas_udf(function, returns)(seq.v)))


def zip_pairs(a: Seq, b: Seq) -> DataFrame:
    """``idx, a, b`` by position."""
    if a.size != b.size:
        raise InvalidArgument(f"sizes {a.size} and {b.size} differ")
    return a.df.select("idx", a.v.alias("a")).join(b.df.select("idx", b.v.alias("b")), "idx")


def transform_pairs(a: Seq, b: Seq, rule: Callable[[Column, Column], Column]) -> Seq:
    return a.with_df(zip_pairs(a, b).select("idx", rule(F.col("a"), F.col("b")).alias(a.value)))


def for_each(seq: Seq, action: Callable) -> None:
    """Side effects: ``action`` gets an iterator over the rows of each partition."""
    seq.df.foreachPartition(action)


def transform_first(seq: Seq, n: int, rule: Rule) -> Seq:
    return seq.with_df(seq.df.withColumn(seq.value, F.when(seq.idx < n, rule(seq.v)).otherwise(seq.v)))


def transform_first_of_blocks(seq: Seq, n: int, rule: Rule) -> Seq:
    local = seq.idx - block_offset(block_owner(seq.idx, seq.size, seq.n_blocks), seq.size, seq.n_blocks)
    return seq.with_df(seq.df.withColumn(seq.value, F.when(local < n, rule(seq.v)).otherwise(seq.v)))


def fill(seq: Seq, value: Any) -> Seq:
    return transform(seq, lambda v: F.lit(value))


def fill_first(seq: Seq, n: int, value: Any) -> Seq:
    return transform_first(seq, n, lambda v: F.lit(value))


def copy(seq: Seq) -> Seq:
    return seq.with_df(seq.df)


def copy_first(seq: Seq, n: int) -> Seq:
    return take(seq, n)


def copy_if(seq: Seq, test: Rule) -> Seq:
    """The values that pass, numbered anew in their order."""
    rows, n = kept_index(seq.df, test(seq.v), seq.size, seq.n_blocks)
    return Seq(rows, n, seq.n_blocks, seq.value)


def replace_if(seq: Seq, test: Rule, new: Any) -> Seq:
    return transform(seq, lambda v: F.when(test(v), F.lit(new)).otherwise(v))


def replace(seq: Seq, old: Any, new: Any) -> Seq:
    return replace_if(seq, lambda v: v == F.lit(old), new)


def replaced(seq: Seq, test: Rule) -> DataFrame:
    """How many values a replacement changes."""
    return seq.df.agg(F.count_if(test(seq.v)).alias("count"))


def subview(seq: Seq, offset: int, count: int) -> Seq:
    if offset < 0 or count < 0 or offset + count > seq.size:
        raise OutOfBounds(f"[{offset}, {offset + count}) of {seq.size}")
    rows = seq.df.where((seq.idx >= offset) & (seq.idx < offset + count)).withColumn("idx", seq.idx - offset)
    return Seq(rows, count, 0, seq.value)


def take(seq: Seq, n: int) -> Seq:
    return subview(seq, 0, min(max(n, 0), seq.size))


def drop(seq: Seq, n: int) -> Seq:
    n = min(max(n, 0), seq.size)
    return subview(seq, n, seq.size - n)


first = take


def last(seq: Seq, n: int) -> Seq:
    return drop(seq, seq.size - min(max(n, 0), seq.size))


def strided(seq: Seq, stride: int, offset: int = 0) -> Seq:
    if stride < 1 or offset < 0:
        raise InvalidArgument("a stride is positive and an offset not negative")
    rows = seq.df.where((seq.idx >= offset) & ((seq.idx - offset) % stride == 0)).withColumn("idx", quotient(seq.idx - offset, stride))
    return Seq(rows, max(0, math.ceil((seq.size - offset) / stride)), 0, seq.value)


def pipe(seq: Seq, *views: Callable[[Seq], Seq]) -> Seq:
    """Views one after another; Catalyst merges their filters."""
    for view in views:
        seq = view(seq)
    return seq


def rotate(seq: Seq, n: int) -> Seq:
    """To the left by ``n``, any sign and size; only indices change."""
    return seq.with_df(seq.df.withColumn("idx", F.pmod(seq.idx - n, F.lit(max(seq.size, 1)).cast("long"))))


def shift_left(seq: Seq, n: int, value: Any) -> Seq:
    """Values move ``n`` to the left; the freed places get ``value``.  Each row makes its own place, and the freed ones
    come from a range, so that nothing is ordered."""
    return _shift(seq, -n, value)


def shift_right(seq: Seq, n: int, value: Any) -> Seq:
    return _shift(seq, n, value)


def shift_kept(seq: Seq, n: int) -> int:
    """How many values a shift keeps."""
    return max(0, seq.size - n) if n >= 0 else 0


def _shift(seq: Seq, by: int, value: Any) -> Seq:
    size, k = seq.size, min(abs(by), seq.size)
    kind = seq.df.schema[seq.value].dataType
    moved = seq.df.select((seq.idx + by).alias("idx"), seq.v.alias(seq.value)).where((F.col("idx") >= 0) & (F.col("idx") < size))
    low = size - k if by < 0 else 0
    freed = seq.df.sparkSession.range(low, low + k).select(F.col("id").alias("idx"), F.lit(value).cast(kind).alias(seq.value))
    return Seq(moved.unionAll(freed), size, seq.n_blocks, seq.value)


def resize(seq: Seq, n: int, value: Any = 0) -> Seq:
    """Cut to ``n`` values, or extended with ``value``; those that stay keep their index."""
    if seq.fixed and n != seq.size:
        raise InvalidArgument("a fixed sequence keeps its size")
    rows = seq.df.select("idx", seq.v.alias(seq.value)).where(seq.idx < n)
    if n > seq.size:
        kind = seq.df.schema[seq.value].dataType
        rows = rows.unionAll(seq.df.sparkSession.range(seq.size, n).select(F.col("id").alias("idx"), F.lit(value).cast(kind).alias(seq.value)))
    return Seq(rows, n, 0, seq.value)


def redistribute(seq: Seq, blocks: int) -> Seq:
    """Another number of blocks, with the rows moved accordingly."""
    return Seq(seq.df.repartitionByRange(blocks, "idx"), seq.size, blocks, seq.value)


def point_get(seq: Seq, at: int) -> Any:
    if not 0 <= at < seq.size:
        raise OutOfBounds(f"{at} of {seq.size}")
    return seq.df.where(seq.idx == at).select(seq.v).first()[0]


def point_put(seq: Seq, at: int, value: Any) -> Seq:
    if not 0 <= at < seq.size:
        raise OutOfBounds(f"{at} of {seq.size}")
    return transform_indexed(seq, lambda i, v: F.when(i == at, F.lit(value)).otherwise(v))
