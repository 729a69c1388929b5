"""Search, predicates and reductions: one pass with partial aggregation, whose exchange carries a row a task."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import Reduction, max_location, min_location, reduction
from ..partition import block_owner
from ..plans.storage import written
from ..seq import Seq
from .elementwise import Rule, zip_pairs


def _lit(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def find_if(seq: Seq, test: Rule) -> DataFrame:
    """One row ``found, idx, value`` for the first match; nulls where there is none."""
    return seq.df.where(test(seq.v)).agg(F.min("idx").alias("idx"), F.min_by(seq.v, "idx").alias("value")).select(F.col("idx").isNotNull().alias("found"), "idx", "value")


def find(seq: Seq, value: Any) -> DataFrame:
    return find_if(seq, lambda v: v == _lit(value))


def find_if_not(seq: Seq, test: Rule) -> DataFrame:
    return find_if(seq, lambda v: ~test(v))


def find_if_in_blocks(seq: Seq, test: Rule) -> DataFrame:
    return with_block(seq).where(test(seq.v)).groupBy("block").agg(F.min("idx").alias("idx"))


def count_if(seq: Seq, test: Rule) -> DataFrame:
    return seq.df.agg(F.count_if(test(seq.v)).alias("count"))


def count(seq: Seq, value: Any) -> DataFrame:
    return count_if(seq, lambda v: v == _lit(value))


def predicates(seq: Seq, test: Rule) -> DataFrame:
    """``all_of, any_of, none_of``: true, false and true of an empty sequence."""
    every, some = F.coalesce(F.bool_and(test(seq.v)), F.lit(True)), F.coalesce(F.bool_or(test(seq.v)), F.lit(False))
    return seq.df.agg(every.alias("all_of"), some.alias("any_of"), (~some).alias("none_of"))


def all_of(seq: Seq, test: Rule) -> DataFrame:
    return predicates(seq, test).select("all_of")


def any_of(seq: Seq, test: Rule) -> DataFrame:
    return predicates(seq, test).select("any_of")


def none_of(seq: Seq, test: Rule) -> DataFrame:
    return predicates(seq, test).select("none_of")


def reduce(seq: Seq, op: str | Reduction, init: Any = None) -> DataFrame:
    """``value``: the reduction with ``init`` taking part once."""
    return transform_reduce(seq, lambda v: v, op, init)


def transform_reduce(seq: Seq, rule: Rule, op: str | Reduction, init: Any = None) -> DataFrame:
    return seq.df.agg(reduction(op).total(rule(seq.v), None if init is None else _lit(init)).alias("value"))


def transform_reduce_pairs(a: Seq, b: Seq, rule: Callable[[Column, Column], Column], op: str | Reduction, init: Any = None) -> DataFrame:
    return zip_pairs(a, b).agg(reduction(op).total(rule(F.col("a"), F.col("b")), None if init is None else _lit(init)).alias("value"))


def inner_product(a: Seq, b: Seq, init: Any = None) -> DataFrame:
    return transform_reduce_pairs(a, b, lambda x, y: x * y, "sum", init)


dot = inner_product


def sum_of_squares(seq: Seq) -> DataFrame:
    return transform_reduce(seq, lambda v: v * v, "sum")


def sum_of_abs(seq: Seq) -> DataFrame:
    return transform_reduce(seq, F.abs, "sum")


def array_dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns, within the row."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_block(seq: Seq) -> DataFrame:
    return seq.df.withColumn("block", block_owner(seq.idx, seq.size, seq.n_blocks))


def block_reduce(seq: Seq, op: str | Reduction) -> DataFrame:
    """``block, local``: each block's own reduction."""
    return with_block(seq).groupBy("block").agg(reduction(op).agg(seq.v).alias("local"))


def distributed_reduce(seq: Seq, op: str | Reduction) -> DataFrame:
    """``block, local, global``: block results with the overall one, from one pass."""
    kind = reduction(op)
    combine = {"count": "sum"}.get(op, op) if isinstance(op, str) else op
    return block_reduce(seq, kind).withColumn("global", reduction(combine).agg(F.col("local")).over(Window.partitionBy(F.lit(1))))


def min_element(seq: Seq) -> DataFrame:
    return seq.df.agg(min_location(seq.v, seq.idx).alias("m")).select("m.value", "m.idx")


def max_element(seq: Seq) -> DataFrame:
    return seq.df.agg(max_location(seq.v, seq.idx).alias("m")).select("m.value", "m.idx")


def minmax_element(seq: Seq) -> DataFrame:
    """Both ends with their first places."""
    both = seq.df.agg(min_location(seq.v, seq.idx).alias("a"), max_location(seq.v, seq.idx).alias("b"))
    return both.select(F.col("a.value").alias("min_value"), F.col("a.idx").alias("min_idx"), F.col("b.value").alias("max_value"), F.col("b.idx").alias("max_idx"))


def block_min_max(seq: Seq) -> DataFrame:
    both = with_block(seq).groupBy("block").agg(min_location(seq.v, seq.idx).alias("a"), max_location(seq.v, seq.idx).alias("b"))
    return both.select("block", F.col("a.value").alias("min_value"), F.col("a.idx").alias("min_idx"), F.col("b.value").alias("max_value"), F.col("b.idx").alias("max_idx"))


def concat_fold(seq: Seq, between: str = "", init: str = "") -> DataFrame:
    """Values as text, in order: each block's part is put together on its own, and the parts then in block order."""
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", seq.v.cast("string").alias("s")))), lambda x: x["s"]), between)
    parts = with_block(seq).groupBy("block").agg(part.alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), between)
    return parts.agg(F.concat(F.lit(init), F.coalesce(whole, F.lit(""))).alias("value"))


def ordered_fold(seq: Seq, init: Any, step: Callable[[Column, Column], Column], most: int = 1_000_000) -> DataFrame:
    """A fold that is not associative.  Each step needs the one before, so blocks of ``most`` values follow one another: each
    is gathered from a table written by block and folded on, and the result goes into the next.  The time follows the
    sequence, no task holds more than a block."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("idx", seq.v.alias("v")))), lambda x: x["v"])
    if seq.size <= most:
        return seq.df.agg(F.aggregate(values, _lit(init), step).alias("value"))
    parts = -(-seq.size // most)
    rows = seq.df.select("idx", seq.v.alias(seq.value), block_owner(seq.idx, seq.size, parts).alias("block"))
    rows = written(rows.repartition(parts, "block").sortWithinPartitions("block"), "fold")  # a block's files tell its range
    state, kind = _lit(init), None
    for k in range(parts):
        part = rows.where(F.col("block") == k).agg(F.aggregate(values, state, step).alias("value"))
        kind = part.schema["value"].dataType
        state = F.lit(part.first()[0]).cast(kind)
    return seq.df.sparkSession.range(1).select(state.alias("value"))


def fold_python(seq: Seq, zero: Any, update: Callable, merge: Callable, returns: str) -> DataFrame:
    """A Python reduction ``(zero, update, merge)``, associative and with ``zero`` as identity: each block folds its
    values in order, and one row a block is merged in order."""
    import functools

    import pandas as pd

    schema = f"block long, part {returns}"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("idx")["_v"].tolist()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [functools.reduce(update, values, zero)]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"value": [functools.reduce(merge, pdf.sort_values("block")["part"].tolist(), zero)]})

    parts = with_block(seq).select("block", "idx", seq.v.alias("_v")).groupBy("block").applyInPandas(fold, schema)
    return parts.groupBy().applyInPandas(join, f"value {returns}")


def statistics(seq: Seq) -> DataFrame:
    """Count, sum, smallest and largest, as a histogram metric keeps them."""
    return seq.df.agg(F.count("*").alias("count"), F.sum(seq.v).alias("sum"), F.min(seq.v).alias("min"), F.max(seq.v).alias("max"))
