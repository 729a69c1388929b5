"""Groups of blocks by role, and what goes from one group to another.  Members are blocks, so a table of members has no more
rows than there are blocks; rows move by joins with it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import Reduction, reduction

#: ``(block, number of blocks)`` to whether the block has the role.
Role = Callable[[Column, int], Column]


def first_only() -> Role:
    return lambda b, p: b == 0


def last_only() -> Role:
    return lambda b, p: b == p - 1


def everyone() -> Role:
    return lambda b, p: F.lit(True)


def nobody() -> Role:
    return lambda b, p: F.lit(False)


def specific(blocks: Sequence[int]) -> Role:
    return lambda b, p: b.isin(list(blocks))


def between(low: int, high: int) -> Role:
    return lambda b, p: (b >= low) & (b < high)


def first_n(n: int) -> Role:
    return lambda b, p: b < n


def last_n(n: int) -> Role:
    return lambda b, p: b >= p - n


def every_nth(n: int, offset: int = 0) -> Role:
    return lambda b, p: (b >= offset) & ((b - offset) % n == 0)


def fraction(share: float) -> Role:
    return lambda b, p: b < int(p * share)


def members(spark: SparkSession, role: Role, p: int) -> DataFrame:
    """``block, local`` of a group: its blocks with their numbers within it."""
    rows = spark.range(p).select(F.col("id").alias("block")).where(role(F.col("block"), p))
    return rows.withColumn("local", (F.row_number().over(Window.orderBy("block")) - 1).cast("long"))


def _of(df: DataFrame, role: Role, p: int) -> DataFrame:
    """Rows of a group's blocks, with ``local`` in place of ``block``."""
    return df.join(F.broadcast(members(df.sparkSession, role, p)), "block").drop("block")


def _leading(df: DataFrame, role: Role, p: int) -> DataFrame:
    return _of(df, role, p).where("local = 0").drop("local")


def transfer(df: DataFrame, source: Role, target: Role, p: int) -> DataFrame:
    """Rows of each source member go to the target member of the same number; what has no counterpart stays out."""
    return _of(df, source, p).join(F.broadcast(members(df.sparkSession, target, p)), "local").drop("local").select(df.columns)


def multicast(df: DataFrame, source: Role, targets: Sequence[Role], p: int) -> DataFrame:
    """``group`` and the rows of the source's leader for every member of each target group."""
    lead, out = _leading(df, source, p), None
    for k, role in enumerate(targets):
        own = members(df.sparkSession, role, p).agg(F.sort_array(F.collect_list("block")).alias("_to"))  # as many as blocks
        part = lead.join(F.broadcast(own)).select(F.lit(k).alias("group"), F.explode("_to").alias("block"), *(c for c in df.columns if c != "block"))
        out = part if out is None else out.unionAll(part)
    return out if out is not None else df.limit(0).withColumn("group", F.lit(0))


def multi_receive(df: DataFrame, sources: Sequence[Role], target: Role, p: int) -> DataFrame:
    """``source`` and the rows of each source group's leader at the target's leader."""
    at = F.broadcast(members(df.sparkSession, target, p).where("local = 0").select("block"))
    parts = [_leading(df, role, p).withColumn("source", F.lit(k)) for k, role in enumerate(sources)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.join(at)


def scatter(df: DataFrame, order: str, source: Role, target: Role, p: int) -> DataFrame:
    """The source leader's rows, one for each target member in order; ``order`` numbers them from 0."""
    return _leading(df, source, p).join(F.broadcast(members(df.sparkSession, target, p)), F.col(order) == F.col("local")).drop("local").select(df.columns)


def gather(df: DataFrame, source: Role, target: Role, p: int) -> DataFrame:
    """All rows of the source group at the target's leader; ``local`` tells whose they are."""
    return _of(df, source, p).join(F.broadcast(members(df.sparkSession, target, p).where("local = 0").select("block")))


def reduce(df: DataFrame, value: str, op: str | Reduction, source: Role, target: Role, p: int) -> DataFrame:
    """``block, value``: the source group's reduction at the target's leader."""
    total = _of(df, source, p).agg(reduction(op).agg(F.col(value)).alias(value))
    return members(df.sparkSession, target, p).where("local = 0").select("block").join(F.broadcast(total))


def forward(df: DataFrame, stages: Sequence[Role], p: int, steps: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """The first group's leader's rows passed on from leader to group, stage by stage; ``steps[k]`` is what stage ``k`` makes of
    them."""
    for k, (here, there) in enumerate(zip(stages, stages[1:], strict=False)):
        df = multicast(df, here, [there], p).drop("group").select(df.columns)
        if k < len(steps):
            df = steps[k](df)
    return df
