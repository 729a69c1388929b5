"""A globally ordered sequence: a DataFrame whose ``idx`` runs from 0 without gaps, with one ``value`` column or more."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import InvalidArgument, NullValue
from .plans.blockscan import Key, block_count, dense_index, stored_index


@dataclass(frozen=True)
class Seq:
    """Immutable: every operator returns a new one.  ``n_blocks`` is how many blocks ordered steps work on; results never
    depend on it."""

    df: DataFrame
    size: int
    n_blocks: int = 0
    value: str = "value"
    fixed: bool = field(default=False)

    def __post_init__(self) -> None:
        if self.size < 0:
            raise InvalidArgument("a size is not negative")
        if self.n_blocks < 1:
            object.__setattr__(self, "n_blocks", block_count(self.size, 8))

    @property
    def idx(self) -> Column:
        return F.col("idx")

    @property
    def v(self) -> Column:
        return F.col(self.value)

    def with_df(self, df: DataFrame, size: int | None = None) -> Seq:
        if self.fixed and size not in (None, self.size):
            raise InvalidArgument("a fixed sequence keeps its size")
        return replace(self, df=df, size=self.size if size is None else size)

    def checked(self) -> Seq:
        """Raises where a value is null or the index is not dense; one pass."""
        got = self.df.agg(F.count("*").alias("n"), F.count_if(self.v.isNull()).alias("nulls"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.count_distinct("idx").alias("ids")).first()
        if got.nulls:
            raise NullValue(f"{got.nulls} nulls in {self.value}")
        if got.n and (got.low, got.high, got.ids) != (0, got.n - 1, got.n) or got.n != self.size:
            raise InvalidArgument("idx is not 0..n-1")
        return self


def from_dense(df: DataFrame, idx: str, value: Column, n: int | None = None, n_blocks: int = 0, keep: Sequence[str] = ()) -> Seq:
    """A table whose key already runs from 0 without gaps."""
    rows = df.select(F.col(idx).cast("long").alias("idx"), value.alias("value"), *keep)
    return Seq(rows, df.count() if n is None else n, n_blocks)


def from_ordered(df: DataFrame, order: Sequence[str | Key], value: Column, n_blocks: int = 0, keep: Sequence[str] = (), store: bool = True) -> Seq:
    """Any table in a total order (end it with a unique key).  The sequence is written once, so that later steps read it and
    do not order the table again; without ``store`` it stays a plan, for what reads it once."""
    n = df.count()
    columns = [value.alias("value"), *(F.col(c) for c in keep)]
    if store:
        return Seq(stored_index(df, order, columns, n, n_blocks or None), n, n_blocks)
    return Seq(dense_index(df, order, n, n_blocks or None).select("idx", *columns), n, n_blocks)
