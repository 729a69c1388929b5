"""Sorts, selection, top-k, partitions and runs of equal values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidArgument, OutOfBounds
from ..partition import block_offset
from ..plans.blockscan import Key, before_cut, by_index, dense_index, kept_index, keys, totals, with_window
from ..seq import Seq
from .elementwise import Rule


def sort(seq: Seq, descending: bool = False, keys: Sequence[str | Key] | None = None) -> Seq:
    """Stable: equal values keep their order, as the old index ends the sort key.  ``keys`` names other sort columns.  The
    old index stays in ``origin``."""
    order = [*(keys or [Key(seq.value, descending)]), "origin"]
    rows = dense_index(seq.df.withColumnRenamed("idx", "origin"), order, seq.size, seq.n_blocks)
    return seq.with_df(rows)


stable_sort = sort


def sort_by(seq: Seq, key: Rule, descending: bool = False) -> Seq:
    """Sorted by a key of the value, in place of a comparator."""
    out = sort(seq.with_df(seq.df.withColumn("_key", key(seq.v))), keys=[Key("_key", descending)])
    return out.with_df(out.df.drop("_key"))


def local_sort(seq: Seq, descending: bool = False) -> Seq:
    """Every block sorted on its own."""
    key = seq.v.desc() if descending else seq.v.asc()
    rows = by_index(seq.df, seq.size, seq.n_blocks).withColumn("_row", F.row_number().over(Window.partitionBy("_block").orderBy(key, "idx")))
    return seq.with_df(rows.withColumn("idx", block_offset(F.col("_block"), seq.size, seq.n_blocks) + F.col("_row") - 1).drop("_block", "_row"))


def _pairs(seq: Seq) -> DataFrame:
    return with_window(seq.df, seq.size, seq.n_blocks, {"_before": lambda w: F.lag(seq.v).over(w), "_has": lambda w: F.lag(F.lit(True)).over(w)}, left=1)


def is_sorted(seq: Seq, descending: bool = False) -> DataFrame:
    """One row ``is_sorted``; true for none or one value."""
    wrong = (seq.v > F.col("_before")) if descending else (seq.v < F.col("_before"))
    return _pairs(seq).agg(F.coalesce(F.bool_and(~wrong), F.lit(True)).alias("is_sorted"))


def is_sorted_in_blocks(seq: Seq) -> DataFrame:
    rows = by_index(seq.df, seq.size, seq.n_blocks).withColumn("_before", F.lag(seq.v).over(Window.partitionBy("_block").orderBy("idx")))
    return rows.groupBy(F.col("_block").alias("block")).agg(F.coalesce(F.bool_and(~(seq.v < F.col("_before"))), F.lit(True)).alias("is_sorted"))


#: Rows that are ordered as they are; what is more is narrowed first.
FEW = 1 << 17
_NUMBERS = ("double", "float", "long", "integer", "short", "byte")


def _narrowed(df: DataFrame, key: Key, n: int, size: int) -> tuple[DataFrame, int, int]:
    """Fewer rows among which the one at sorted place ``n`` is, its place there, and their number.  Approximate quantiles
    bracket the place, and two exact counts tell whether they do."""
    c = F.col(key.name)
    while size > FEW and df.schema[key.name].dataType.typeName() in _NUMBERS:
        at = (n + 0.5) / size
        at = 1 - at if key.descending else at
        got = df.agg(F.percentile_approx(c, F.array(F.lit(max(0.0, at - 0.001)), F.lit(min(1.0, at + 0.001))), 10_000)).first()[0]
        if got is None:
            break
        inside = c.between(*got)
        before, k = df.agg(F.count_if(c > got[1] if key.descending else key.before(F.lit(got[0]))), F.count_if(inside)).first()
        if not before <= n < before + k or k > size // 2 and got[0] != got[1]:
            break
        df, n, size = df.where(inside), n - before, k
        if got[0] == got[1]:
            break
    return df, n, size


def nth_row(df: DataFrame, order: Sequence[str | Key], n: int, size: int | None = None) -> DataFrame:
    """The row at sorted place ``n`` of any frame, without ordering it: brackets of the leading columns leave few rows, and
    only those are ordered.  What can't be bracketed (text, or mostly equal values) takes places by blocks."""
    order = keys(order)
    size = df.count() if size is None else size
    if not 0 <= n < size:
        return df.limit(0)
    for key in order:
        df, n, size = _narrowed(df, key, n, size)
    columns = [k.column for k in order]
    if size > FEW:
        return dense_index(df, order, size, name="_place").where(F.col("_place") == n).drop("_place")
    return df.orderBy(*columns).offset(n).limit(1)


def _valid(row: DataFrame, value: str = "value") -> DataFrame:
    return row.agg(F.count("*").alias("k"), F.first(value).alias("value"), F.first("idx").alias("idx")).select((F.col("k") > 0).alias("valid"), "value", "idx")


def nth_element(seq: Seq, n: int, descending: bool = False) -> DataFrame:
    """``valid, value, idx`` of the value at sorted place ``n`` with its own index; not valid outside the sequence."""
    return _valid(nth_row(seq.df.select("idx", seq.v.alias("value")), [Key("value", descending), "idx"], n, seq.size))


def nth_of(df: DataFrame, order: Sequence[str | Key], value: str, n: int | None = None, descending: bool = False) -> DataFrame:
    """The same of a table that is no sequence yet: ``idx`` is the number of rows before the found one in ``order``, which is
    counted, so that nothing is numbered.  Without ``n``: the upper median."""
    size = df.count()
    n = size // 2 if n is None else n
    order = keys(order)
    row = nth_row(df, [Key(value, descending), *order], n, size).select(value, *(k.name for k in order)).first()
    if row is None:
        return _valid(df.select(F.col(value), F.lit(0).cast("long").alias("idx")).limit(0), value)
    at = df.agg(F.count_if(before_cut(order, [F.lit(row[k.name]) for k in order])).alias("idx"))
    return at.select(F.lit(True).alias("valid"), F.lit(row[value]).cast(df.schema[value].dataType).alias("value"), "idx")


def median(seq: Seq) -> DataFrame:
    """The upper median: the value at sorted place ``size div 2``, never an average."""
    return nth_element(seq, seq.size // 2)


def partial_sort(seq: Seq, n: int, descending: bool = False) -> DataFrame:
    """The first ``n`` in order, ``idx`` being their own; equal values by it.  Tasks send ``n`` rows each at most."""
    if n < 0:
        raise InvalidArgument("a number of values is not negative")
    return seq.df.select(seq.v.alias("value"), "idx").orderBy(F.col("value").desc() if descending else F.col("value").asc(), "idx").limit(n)


def top_k(seq: Seq, k: int) -> DataFrame:
    return partial_sort(seq, k, descending=True)


def bottom_k(seq: Seq, k: int) -> DataFrame:
    return partial_sort(seq, k)


def partition(seq: Seq, test: Rule) -> Seq:
    """Values that pass first, both sides in their order; the old index stays in ``origin``.  A value's new place follows from
    how many pass before it, so nothing is ordered anew."""
    rows = by_index(seq.df.withColumn("_side", F.coalesce(test(seq.v), F.lit(False)).cast("long")), seq.size, seq.n_blocks)
    sums = totals(rows, F.sum("_side"))
    passed = sums.agg(F.sum("_total")).first()[0] or 0
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("_side").over(Window.partitionBy("_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_side")
    rows = rows.join(F.broadcast(begins), "_block").withColumn("_before", F.col("_before") + own).withColumnRenamed("idx", "origin")
    place = F.when(F.col("_side") == 1, F.col("_before")).otherwise(F.lit(passed) + F.col("origin") - F.col("_before"))
    return seq.with_df(rows.withColumn("idx", place).drop("_block", "_before", "_side"))


stable_partition = partition


def partition_count(seq: Seq, test: Rule) -> DataFrame:
    return seq.df.agg(F.count_if(test(seq.v)).alias("count"))


def is_partitioned(seq: Seq, test: Rule) -> DataFrame:
    """One row ``is_partitioned``; true where a side is empty."""
    last = F.max(F.when(test(seq.v), seq.idx))
    first = F.min(F.when(~test(seq.v), seq.idx))
    return seq.df.agg(F.coalesce(last < first, F.lit(True)).alias("is_partitioned"))


def partition_point(seq: Seq, test: Rule) -> DataFrame:
    """``idx`` of the first value that doesn't pass, or the size."""
    return seq.df.agg(F.coalesce(F.min(F.when(~test(seq.v), seq.idx)), F.lit(seq.size)).alias("idx"))


def _same(seq: Seq, equal: Callable[[Column, Column], Column] | None) -> Column:
    equal = equal or (lambda a, b: a == b)
    return F.col("_has").isNotNull() & equal(F.col("_before"), seq.v)


def unique(seq: Seq, equal: Callable[[Column, Column], Column] | None = None) -> Seq:
    """Runs of equal values reduced to their first, numbered anew; across all blocks."""
    rows, n = kept_index(_pairs(seq), ~_same(seq, equal), seq.size, seq.n_blocks)
    return Seq(rows.drop("_before", "_has"), n, seq.n_blocks, seq.value)


def local_unique(seq: Seq) -> DataFrame:
    """``block, removed``: how many each block alone would drop."""
    rows = by_index(seq.df, seq.size, seq.n_blocks).withColumn("_before", F.lag(seq.v).over(Window.partitionBy("_block").orderBy("idx")))
    return rows.groupBy(F.col("_block").alias("block")).agg(F.count_if(F.col("_before") == seq.v).alias("removed"))


def count_duplicates(seq: Seq, equal: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Neighbouring equal pairs."""
    return _pairs(seq).agg(F.count_if(_same(seq, equal)).alias("count"))


def has_duplicates(seq: Seq) -> DataFrame:
    return _pairs(seq).agg(F.coalesce(F.bool_or(_same(seq, None)), F.lit(False)).alias("has_duplicates"))


def distinct(seq: Seq) -> DataFrame:
    """The sort-and-unique idiom as one hash aggregation."""
    return seq.df.select(seq.v.alias("value")).distinct()


def value_at(seq: Seq, place: int):
    if not 0 <= place < seq.size:
        raise OutOfBounds(f"{place} of {seq.size}")
    return nth_element(seq, place).first()["value"]
