"""Ordered computation without a single ordered task.

An ordered window over a whole table runs in one task.  Here rows are first dealt to blocks of neighbouring rows; every
block is scanned by a task of its own, one row for each block is combined in order, and its result goes back to the
block's rows.  Fixed-reach windows (lag, lead, sliding frames) copy the few rows at block borders instead.  Block ids
are Column expressions of the order key, never partition numbers, so a task that runs again sees the same blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..partition import block_owner
from .storage import written

ROWS_PER_BLOCK = 1 << 20
#: Blocks have one row each in what goes to the driver and back, so there is a bound to them; beyond it they grow.
MOST_BLOCKS = 8192
#: Cuts that are compared in one expression; more of them are looked up in an array.
FEW_CUTS = 64


def block_count(n: int, least: int = 1) -> int:
    """As many blocks as keep a block's sort within one task's memory; a larger one spills."""
    return max(least, min(MOST_BLOCKS, -(-n // ROWS_PER_BLOCK)), 1)


class Key:
    """One column of an order: nulls come first in an ascending one and last in a descending one, NaN is the largest value."""

    def __init__(self, name: str, descending: bool = False) -> None:
        self.name, self.descending = name, descending

    @property
    def column(self) -> Column:
        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()

    def before(self, cut: Column) -> Column:
        """Whether the row's value comes before a cut's, which may be null as well; never null."""
        c = F.col(self.name)
        if self.descending:
            return F.coalesce(c > cut, c.isNotNull() & cut.isNull())
        return F.coalesce(c < cut, c.isNull() & cut.isNotNull())


def keys(order: Sequence[str | Key]) -> list[Key]:
    return [k if isinstance(k, Key) else Key(k) for k in order]


def before_cut(order: list[Key], cut: Sequence[Column]) -> Column:
    """Whether a row stands before a cut."""
    out = F.lit(False)
    for key, value in reversed(list(zip(order, cut, strict=True))):
        out = key.before(value) | (F.col(key.name).eqNullSafe(value) & out)
    return out


def _number(order: list[Key], cuts: list[Sequence[Column]], low: int, high: int) -> Column:
    """The number of cuts at or before a row, by halving in one expression."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(before_cut(order, cuts[mid]), _number(order, cuts, low, mid)).otherwise(_number(order, cuts, mid + 1, high))


def _looked_up(order: list[Key], cuts: Column, n: int) -> Column:
    """The same over an array of ``n`` cuts, whose plan does not grow with them."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        cut = F.get(cuts, mid)
        left = before_cut(order, [cut[f"c{k}"] for k in range(len(order))])
        done = s["low"] >= s["high"]
        low = F.when(done | left, s["low"]).otherwise(mid + 1)
        return F.struct(low.alias("low"), F.when(~done & left, mid).otherwise(s["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, step)["low"]


def cut_points(df: DataFrame, order: list[Key], blocks: int, n: int) -> list[str]:
    """Keys at which blocks begin, as JSON, from a sample of some keys for each.  Any cuts are right; they only balance."""
    if blocks < 2 or n < 2:
        return []
    names = [k.name for k in order]
    each = 64 if blocks <= FEW_CUTS else 16
    every = max(1, n // (blocks * each))
    sample = df.select(*names).where(F.pmod(F.xxhash64(*names), F.lit(every)) == 0).orderBy(*(k.column for k in order)).limit(4 * blocks * each)
    # without a name of their own, as columns may be called alike but for their case
    json = F.to_json(F.struct(*(F.col(name).alias(f"c{k}") for k, name in enumerate(names))), {"timestampFormat": _TIME, "timestampNTZFormat": _TIME[:-5]})
    rows = [r[0] for r in sample.select(json).collect()]
    return list(dict.fromkeys(rows[len(rows) * k // blocks] for k in range(1, blocks))) if rows else []


_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS[XXX]"


def by_order(df: DataFrame, order: Sequence[str | Key], n: int, blocks: int | None = None, name: str = "_block") -> DataFrame:
    """``df`` with the block of each row by any order; rows of equal keys share a block, so end an order with a unique key."""
    order = keys(order)
    cuts = cut_points(df, order, blocks or block_count(n, 8), n)
    kinds = T.StructType([T.StructField(f"c{k}", df.schema[key.name].dataType) for k, key in enumerate(order)])
    options = {"timestampFormat": _TIME, "timestampNTZFormat": _TIME[:-5]}
    if len(cuts) > FEW_CUTS:
        array = F.from_json(F.lit(f"[{','.join(cuts)}]"), T.ArrayType(kinds), options)
        return df.withColumn(name, _looked_up(order, array, len(cuts)))
    parsed = [F.from_json(F.lit(c), kinds, options) for c in cuts]
    return df.withColumn(name, _number(order, [[c[f"c{k}"] for k in range(len(order))] for c in parsed], 0, len(cuts)).cast("int"))


def by_index(df: DataFrame, n: int, blocks: int, idx: str = "idx", name: str = "_block") -> DataFrame:
    return df.withColumn(name, block_owner(F.col(idx), n, blocks))


def totals(df: DataFrame, total: Column, block: str = "_block") -> DataFrame:
    """``block, _total`` of every block, worked out once: as many rows as blocks come to the driver, so that what follows
    neither repeats ``df`` in its own plan nor doubles it with each ordered step."""
    rows = df.groupBy(block).agg(total.alias("_total"))
    return df.sparkSession.createDataFrame(rows.collect(), rows.schema)


def offsets(df: DataFrame, total: Column, combine: Callable[[Column, Window], Column], block: str = "_block") -> DataFrame:
    """One row for each block with what all earlier blocks come to (null before the first)."""
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals(df, total, block).withColumn("_before", combine(F.col("_total"), before)).select(block, "_before")


def with_offsets(df: DataFrame, total: Column, combine: Callable[[Column, Window], Column], block: str = "_block") -> DataFrame:
    return df.join(F.broadcast(offsets(df, total, combine, block)), block)


def numbered(rows: DataFrame, order: Sequence[Column], counts: DataFrame, name: str) -> DataFrame:
    """``rows``, which have ``_block``, with their place: that in their block by ``order`` after the ``counts`` of earlier ones."""
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_begin"))
    own = Window.partitionBy("_block").orderBy(*order)
    return rows.join(F.broadcast(begins), "_block").withColumn(name, F.row_number().over(own) - 1 + F.col("_begin")).drop("_block", "_begin")


def dense_index(df: DataFrame, order: Sequence[str | Key], n: int | None = None, blocks: int | None = None, name: str = "idx", where: Column | None = None) -> DataFrame:
    """``df`` (or its rows that pass ``where``) with the position of each row in ``order``, from 0 without gaps."""
    order = keys(order)
    if where is not None:
        df = df.where(where)
    if n is None:
        n = df.count()
    rows = by_order(df, order, n, blocks)
    return numbered(rows, [k.column for k in order], totals(rows, F.count("*")), name)


def stored_index(df: DataFrame, order: Sequence[str | Key], columns: Sequence[Column], n: int, blocks: int | None = None) -> DataFrame:
    """``idx`` and ``columns`` of ``df``, written once with the place of each row in its block: ``df`` is read for the sample
    of its keys and once more, the counts of blocks come from what is written."""
    order = keys(order)
    own = F.row_number().over(Window.partitionBy("_block").orderBy(*(k.column for k in order)))
    rows = written(by_order(df, order, n, blocks).withColumn("_row", own - 1).select("_block", "_row", *columns), "sequence")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals(rows, F.count("*")).select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_begin"))
    return rows.join(F.broadcast(begins), "_block").withColumn("idx", F.col("_row") + F.col("_begin")).select("idx", *rows.columns[2:])


def kept_index(df: DataFrame, test: Column, n: int, blocks: int, idx: str = "idx") -> tuple[DataFrame, int]:
    """The rows that pass, numbered anew in the order of their index, and how many they are.  Two passes and no new order:
    the rows that pass are counted by block of the old index, and take their places after those of earlier blocks."""
    rows = by_index(df.where(test), n, blocks, idx)
    counts = totals(rows, F.count("*"))
    size = counts.agg(F.sum("_total")).first()[0] or 0
    return numbered(rows, [F.col(idx)], counts, "_new").drop(idx).withColumnRenamed("_new", idx), size


def halo(df: DataFrame, n: int, blocks: int, left: int = 0, right: int = 0, idx: str = "idx") -> DataFrame:
    """Rows by block, with copies (``_ghost``) of the ``left`` rows before and the ``right`` rows after each block."""
    at = F.col(idx)
    low = block_owner(F.greatest(at - right, F.lit(0)), n, blocks)
    high = block_owner(F.least(at + left, F.lit(max(n - 1, 0))), n, blocks)
    rows = df.withColumn("_block", F.explode(F.sequence(low, high)))
    return rows.withColumn("_ghost", F.col("_block") != block_owner(at, n, blocks))


def with_window(df: DataFrame, n: int, blocks: int, columns: dict[str, Callable[[Window], Column]], left: int = 0, right: int = 0, idx: str = "idx") -> DataFrame:
    """Columns over ordered windows that reach ``left`` rows back and ``right`` rows ahead, at most."""
    blocks = max(1, min(blocks, n // max(1, left, right))) if n else 1
    rows = halo(df, n, blocks, left, right, idx)
    w = Window.partitionBy("_block").orderBy(idx)
    return rows.select("*", *(make(w).alias(name) for name, make in columns.items())).where(~F.col("_ghost")).drop("_block", "_ghost")
