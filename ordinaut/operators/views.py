"""Chunk, window, run, tile and segment views: groupings by index arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidArgument
from ..partition import block_offset, block_owner, block_size, quotient
from ..plans.blockscan import by_index, with_offsets, with_window
from ..seq import Seq


def chunks(seq: Seq, k: int, **aggregates: Column) -> DataFrame:
    """``chunk`` and aggregates over each run of ``k`` values; the last may be shorter."""
    if k < 1:
        raise InvalidArgument("a chunk has one value at least")
    return seq.df.groupBy(quotient(seq.idx, k).alias("chunk")).agg(*(c.alias(n) for n, c in (aggregates or {"size": F.count("*")}).items()))


def chunk_values(seq: Seq, k: int) -> DataFrame:
    values = F.transform(F.array_sort(F.collect_list(F.struct("idx", seq.v.alias("v")))), lambda x: x["v"])
    return chunks(seq, k, values=values)


def n_windows(size: int, width: int, stride: int = 1) -> int:
    return 0 if size < width else (size - width) // stride + 1


def windows(seq: Seq, width: int, stride: int = 1, **aggregates: Callable[[], Column]) -> DataFrame:
    """``start`` and running aggregates over each full window of ``width`` values, one every ``stride``."""
    if width < 1 or stride < 1:
        raise InvalidArgument("a window and a stride are positive")
    frame = lambda w: w.rowsBetween(0, width - 1)
    columns = {name: (lambda w, make=make: make().over(frame(w))) for name, make in aggregates.items()}
    rows = with_window(seq.df, seq.size, seq.n_blocks, columns, right=width - 1)
    return rows.where((seq.idx % stride == 0) & (seq.idx + width <= seq.size)).select(seq.idx.alias("start"), *aggregates)


def window_values(seq: Seq, width: int, stride: int = 1) -> DataFrame:
    return windows(seq, width, stride, values=lambda: F.collect_list(seq.v))


def islands(seq: Seq, joined: Callable[[Column, Column], Column] | None = None) -> Seq:
    """The sequence with ``island``: a new one begins where ``joined(the value before, value)`` is false."""
    joined = joined or (lambda a, b: a == b)
    rows = with_window(seq.df, seq.size, seq.n_blocks, {"_before": lambda w: F.lag(seq.v).over(w)}, left=1)
    rows = rows.withColumn("_new", F.when((seq.idx == 0) | joined(F.col("_before"), seq.v), 0).otherwise(1))
    rows = with_offsets(by_index(rows.drop("_before"), seq.size, seq.n_blocks), F.sum("_new"), lambda t, w: F.sum(t).over(w))
    own = F.sum("_new").over(Window.partitionBy("_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return seq.with_df(rows.withColumn("island", own + F.coalesce("_before", F.lit(0))).drop("_before", "_new", "_block"))


def chunk_by(seq: Seq, joined: Callable[[Column, Column], Column] | None = None, **aggregates: Column) -> DataFrame:
    """``island`` and aggregates over each run of joined neighbours."""
    rows = islands(seq, joined).df
    return rows.groupBy("island").agg(*(c.alias(n) for n, c in (aggregates or {"size": F.count("*")}).items()))


def tiles(df: DataFrame, sides: dict[str, int], **aggregates: Column) -> DataFrame:
    """Blocks of an N-d frame: ``sides`` gives the tile's length along index columns; tiles at an edge are clipped."""
    groups = [quotient(F.col(name), side).alias(f"tile_{name}") for name, side in sides.items()]
    return df.groupBy(*groups).agg(*(c.alias(n) for n, c in (aggregates or {"size": F.count("*")}).items()))


def segments(seq: Seq) -> DataFrame:
    """``block, global_offset, size`` of every block, empty ones too."""
    blocks = seq.df.sparkSession.range(seq.n_blocks).select(F.col("id").alias("block"))
    return blocks.select("block", block_offset(F.col("block"), seq.size, seq.n_blocks).alias("global_offset"), block_size(F.col("block"), seq.size, seq.n_blocks).alias("size"))


def for_each_segment(seq: Seq, function: Callable, schema: str) -> DataFrame:
    """``function`` of every block as a pandas frame, ordered by index; blocks bound what a task holds."""
    rows = seq.df.withColumn("block", block_owner(seq.idx, seq.size, seq.n_blocks))
    return rows.groupBy("block").applyInPandas(lambda pdf: function(pdf.sort_values("idx")), schema)
