"""What ranks do together, over blocks: each is an aggregation, a re-keying or a broadcast of one row a block."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions import Reduction, reduction
from ..partition import block_owner, dynamic_owner
from ..plans.blockscan import MOST_BLOCKS, dense_index
from ..seq import Seq
from .scan import keyed_scan


def _each_block(rows: DataFrame, df: DataFrame, block: str) -> DataFrame:
    """``rows`` once for every block of ``df``.  The blocks' numbers, ``MOST_BLOCKS`` at most, go into the plan, so that no rows
    are sent to every executor; beyond them Spark joins both as it sees fit."""
    ids = df.select(block).distinct()
    few = [r[0] for r in ids.limit(MOST_BLOCKS + 1).collect()]
    if len(few) > MOST_BLOCKS:
        return ids.crossJoin(rows)
    kind = ids.schema[0].dataType
    listed = F.array(*(F.lit(b) for b in few)).cast(T.ArrayType(kind))
    return rows.select(F.explode(listed).alias(block), "*")


def broadcast(df: DataFrame, root: int, block: str = "block") -> DataFrame:
    """The root block's rows for every block."""
    return _each_block(df.where(F.col(block) == root).drop(block), df, block)


def replicated(df: DataFrame, most: int = 100_000) -> DataFrame:
    """An operand that every task joins with: sent to all executors when it has ``most`` rows at most, otherwise left to
    Spark's choice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def allreduce(df: DataFrame, value: str, op: str | Reduction, block: str = "block", slot: str | None = None) -> DataFrame:
    """``block[, slot], value``: the reduction over all blocks, for every block (and slot by slot)."""
    keys = [slot] if slot else []
    total = df.groupBy(*keys).agg(reduction(op).agg(F.col(value)).alias(value))
    blocks = df.select(block, *keys).distinct()
    return blocks.join(total, keys) if keys else blocks.join(F.broadcast(total))


def reduce_to_root(df: DataFrame, value: str, op: str | Reduction, root: int, block: str = "block") -> DataFrame:
    """The reduction at the root, null elsewhere."""
    return allreduce(df, value, op, block).withColumn(value, F.when(F.col(block) == root, F.col(value)))


def scatter(seq: Seq, p: int) -> DataFrame:
    return seq.df.withColumn("block", block_owner(seq.idx, seq.size, p))


def scatter_counts(seq: Seq, counts: Sequence[int]) -> DataFrame:
    return seq.df.withColumn("block", dynamic_owner(seq.idx, counts, seq.size))


def gather(df: DataFrame, order: Sequence[str], value: str, root: int = 0) -> DataFrame:
    """``block, idx, value``: all values in order, as the root receives them.  They are rows and stay spread, whatever their
    number."""
    rows = dense_index(df.select(*order, F.col(value).alias("_v")), order)
    return rows.select(F.lit(root).cast("long").alias("block"), "idx", F.col("_v").alias("value"))


def gather_row(df: DataFrame, order: Sequence[str], value: str, most: int = 1 << 16) -> DataFrame:
    """One row ``values`` in order, for results that fit one row: more than ``most`` are refused, ``gather`` takes any."""
    if df.limit(most + 1).count() > most:
        raise InvalidArgument(f"more than {most} values don't fit one row")
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.agg(F.transform(listed, lambda x: x["_v"]).alias("values"))


def allgather(df: DataFrame, order: Sequence[str], value: str, block: str = "block") -> DataFrame:
    """``block, idx, value``: all values in order, once for every block."""
    return _each_block(gather(df, order, value).drop("block"), df, block)


def alltoall(df: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Every row goes to its target: the two columns change names."""
    names = {source: target, target: source}
    return df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns))


def alltoall_counts(df: DataFrame, source: Column, target: Column) -> DataFrame:
    return df.groupBy(source.alias("src"), target.alias("dst")).agg(F.count("*").alias("n"))


def split(df: DataFrame, color: Column, key: Column) -> DataFrame:
    """``color`` groups with the rank of each member in its group; members are blocks, so few."""
    from pyspark.sql.window import Window

    return df.withColumn("color", color).withColumn("rank", (F.row_number().over(Window.partitionBy("color").orderBy(key)) - 1).cast("long"))


def scatter_reduce(target: Seq, updates: DataFrame, op: str | Reduction = "sum") -> Seq:
    """``accumulate`` at given places: updates ``idx, value`` are reduced by place before they meet the sequence."""
    kind = reduction(op)
    few = updates.groupBy("idx").agg(kind.agg(F.col("value")).alias("_u"))
    rows = target.df.join(few, "idx", "left")
    return target.with_df(rows.withColumn(target.value, F.coalesce(kind.join(target.v, F.col("_u")), target.v)).drop("_u"))


def get_accumulate(target: Seq, updates: DataFrame, op: str | Reduction = "sum") -> DataFrame:
    """``seq, idx, old`` for each of ``updates(seq, idx, value)``: what it finds at its place, which holds the target's value and
    all updates with a smaller ``seq``.  The updates are scanned by place and ``seq``, so a place with very many of them is
    shared out among blocks.  ``fetch_and_op`` is the same; the target afterwards is ``scatter_reduce``'s."""
    kind = reduction(op)
    before = keyed_scan(updates, "idx", ["seq"], F.col("value"), kind, exclusive=True)
    rows = before.join(target.df.select("idx", target.v.alias("_t")), "idx")
    return rows.select("seq", "idx", F.coalesce(kind.join(F.col("_t"), F.col("scan")), F.col("_t")).alias("old"))


fetch_and_op = get_accumulate


def with_role(df: DataFrame, roles: dict[str, Callable[[Column], Column]], block: str = "block") -> DataFrame:
    """``role`` by the first predicate of the block that holds."""
    out = F.lit(None).cast("string")
    for name, test in reversed(list(roles.items())):
        out = F.when(test(F.col(block)), F.lit(name)).otherwise(out)
    return df.withColumn("role", out)


def every_nth(n: int) -> Callable[[Column], Column]:
    return lambda b: b % n == 0


def first_n(n: int) -> Callable[[Column], Column]:
    return lambda b: b < n


def last_n(n: int, p: int) -> Callable[[Column], Column]:
    return lambda b: b >= p - n


def between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda b: (b >= low) & (b < high)


def fraction(share: float, p: int) -> Callable[[Column], Column]:
    return lambda b: b < int(share * p)
