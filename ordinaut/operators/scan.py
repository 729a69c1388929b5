"""Prefix scans, adjacent differences, halos and stencils over blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import Reduction, reduction
from ..partition import block_owner
from ..plans.blockscan import Key, by_index, by_order, keys, with_offsets, with_window
from ..seq import Seq
from .elementwise import Rule

def _frame(last: int):
    """From the beginning of a block to the row itself, or the one before it."""
    return Window.partitionBy("_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, last)


def scan(seq: Seq, op: str | Reduction = "sum", init: Any = None, exclusive: bool = False, rule: Rule | None = None) -> Seq:
    """The running reduction of ``rule(value)``.  Inclusive: value ``i`` takes part in result ``i``; exclusive: it doesn't,
    and the first result is ``init`` (null without one).  ``init`` takes part once, whatever the number of blocks."""
    kind = reduction(op)
    value = rule(seq.v) if rule else seq.v
    rows = by_index(seq.df.withColumn("_x", value), seq.size, seq.n_blocks)
    combine = REDUCE_TOTALS.get(op, kind) if isinstance(op, str) else kind
    rows = with_offsets(rows, kind.agg(F.col("_x")), lambda t, w: combine.agg(t).over(w))
    frame = _frame(-1 if exclusive else 0)
    rows = rows.withColumn("_own", kind.agg(F.col("_x")).over(frame))
    parts = [F.col("_before"), F.col("_own")]
    if init is not None:
        parts.insert(0, init if isinstance(init, Column) else F.lit(init))
    out = parts[0]
    for p in parts[1:]:
        out = F.coalesce(combine.join(out, p), out, p)
    if kind is reduction("count"):
        out = F.coalesce(out, F.lit(0))
    return seq.with_df(rows.withColumn(seq.value, out).drop("_x", "_own", "_before", "_block"))


#: How the totals of blocks combine, where that is not the reduction itself.
REDUCE_TOTALS = {"count": reduction("sum")}


def inclusive_scan(seq: Seq, op: str | Reduction = "sum", init: Any = None) -> Seq:
    return scan(seq, op, init)


def exclusive_scan(seq: Seq, op: str | Reduction = "sum", init: Any = 0) -> Seq:
    return scan(seq, op, init, exclusive=True)


def transform_inclusive_scan(seq: Seq, rule: Rule, op: str | Reduction = "sum", init: Any = None) -> Seq:
    return scan(seq, op, init, rule=rule)


def transform_exclusive_scan(seq: Seq, rule: Rule, op: str | Reduction = "sum", init: Any = 0) -> Seq:
    return scan(seq, op, init, exclusive=True, rule=rule)


partial_sum = inclusive_scan


def local_scan(seq: Seq, op: str | Reduction = "sum", exclusive: bool = False, identity: Any = None) -> Seq:
    """A scan that begins anew in every block; an exclusive one's first result is ``identity``."""
    kind = reduction(op)
    frame = _frame(-1 if exclusive else 0)
    own = kind.agg(seq.v).over(frame)
    if exclusive and identity is not None:
        own = F.coalesce(own, F.lit(identity))
    rows = by_index(seq.df, seq.size, seq.n_blocks).withColumn("_own", own)
    return seq.with_df(rows.withColumn(seq.value, F.col("_own")).drop("_own", "_block"))


def block_scan(seq: Seq, op: str = "sum", exclusive: bool = False):
    """``block, value``: the scan of the blocks' reductions, one row a block."""
    kind = reduction(op)
    combine = REDUCE_TOTALS.get(op, kind)
    frame = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    totals = seq.df.withColumn("block", block_owner(seq.idx, seq.size, seq.n_blocks)).groupBy("block").agg(kind.agg(seq.v).alias("t"))
    return totals.select("block", combine.agg(F.col("t")).over(frame).alias("value"))


def keyed_scan(df: DataFrame, key: str, order: Sequence[str | Key], value: Column, op: str | Reduction = "sum", exclusive: bool = False, n: int | None = None, blocks: int | None = None) -> DataFrame:
    """``df`` with ``scan``: the running reduction of ``value`` among the rows of one ``key`` in ``order`` (null before the first
    in an exclusive one).  Rows are dealt to blocks by key and order; what a key has in earlier blocks is carried over by one
    row for each block, so a key with a third of all rows is scanned by many tasks."""
    kind = reduction(op)
    combine = REDUCE_TOTALS.get(op, kind) if isinstance(op, str) else kind
    n = df.count() if n is None else n
    rows = by_order(df.withColumn("_x", value), [key, *order], n, blocks)
    # the last key of a block is the only one that goes on in the next
    ends = rows.groupBy("_block").agg(F.min(F.struct(key)).alias("_first"), F.max(F.struct(key)).alias("_last"))
    ends = df.sparkSession.createDataFrame(ends.collect(), ends.schema)  # a row a block
    last = rows.join(F.broadcast(ends), "_block").where(F.struct(key) == F.col("_last")).groupBy("_block", "_first", "_last").agg(kind.agg(F.col("_x")).alias("_t"))
    last = df.sparkSession.createDataFrame(last.collect(), last.schema)
    # of the blocks before, those that end with the key a block begins with
    run = Window.partitionBy("_last").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    sums = last.withColumn("_t", combine.agg(F.col("_t")).over(run))
    to_next = Window.orderBy("_block")
    sums = sums.select("_block", "_first", F.lag("_last").over(to_next).alias("_key"), F.lag("_t").over(to_next).alias("_carry"))
    carry = sums.where(F.col("_key") == F.col("_first")).select("_block", "_key", "_carry")
    own = Window.partitionBy("_block", key).orderBy(*(k.column for k in keys(order))).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    rows = rows.withColumn("scan", kind.agg(F.col("_x")).over(own)).join(F.broadcast(carry), "_block", "left")
    carried = F.when(F.struct(key) == F.col("_key"), F.col("_carry"))
    out = F.coalesce(combine.join(carried, F.col("scan")), carried, F.col("scan"))
    return rows.withColumn("scan", out).drop("_block", "_x", "_key", "_carry")


def adjacent_difference(seq: Seq, rule: Callable[[Column, Column], Column] | None = None) -> Seq:
    """The first value, then ``rule(value, the one before)``: the difference unless told otherwise."""
    rule = rule or (lambda now, before: now - before)
    rows = with_window(seq.df, seq.size, seq.n_blocks, {"_before": lambda w: F.lag(seq.v).over(w)}, left=1)
    return seq.with_df(rows.withColumn(seq.value, F.when(seq.idx == 0, seq.v).otherwise(rule(seq.v, F.col("_before")))).drop("_before"))


def neighbours(seq: Seq, width: int):
    """The frame with ``left_k`` and ``right_k`` for k up to ``width``: null beyond the ends."""
    columns = {f"left_{k}": (lambda w, k=k: F.lag(seq.v, k).over(w)) for k in range(1, width + 1)}
    columns |= {f"right_{k}": (lambda w, k=k: F.lead(seq.v, k).over(w)) for k in range(1, width + 1)}
    return with_window(seq.df, seq.size, seq.n_blocks, columns, left=width, right=width)


def stencil(seq: Seq, width: int, rule: Callable[..., Column]) -> Seq:
    """``rule(idx, value, [left_1..], [right_1..])`` at every place."""
    rows = neighbours(seq, width)
    left, right = ([F.col(f"{side}_{k}") for k in range(1, width + 1)] for side in ("left", "right"))
    out = rows.withColumn(seq.value, rule(seq.idx, seq.v, left, right))
    return seq.with_df(out.drop(*(f"{side}_{k}" for side in ("left", "right") for k in range(1, width + 1))))


def lag(seq: Seq, k: int = 1, default: Any = None) -> Seq:
    rows = with_window(seq.df, seq.size, seq.n_blocks, {"_l": lambda w: F.lag(seq.v, k).over(w)}, left=k)
    return seq.with_df(rows.withColumn(seq.value, F.when(seq.idx < k, F.lit(default)).otherwise(F.col("_l"))).drop("_l"))


def lead(seq: Seq, k: int = 1, default: Any = None) -> Seq:
    rows = with_window(seq.df, seq.size, seq.n_blocks, {"_l": lambda w: F.lead(seq.v, k).over(w)}, right=k)
    return seq.with_df(rows.withColumn(seq.value, F.when(seq.idx >= seq.size - k, F.lit(default)).otherwise(F.col("_l"))).drop("_l"))
