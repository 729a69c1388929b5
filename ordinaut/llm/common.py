"""Shared plumbing: scratch tables in the cluster's shared folder, and null-safe document columns."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path, shared_dir, written  # noqa: F401 - operators take them from here


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4 << 20):
    """Zero-copy slices of ``batch`` with at most ``max_bytes`` of text each (one row at least), so that memory in a
    worker follows the longest text and not the batch."""
    import numpy as np

    lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: Keys with more rows than this, and than one in so many of all rows, are hot.
HOT_ROWS, HOT_SHARE = 512, 20_000


def spread_join(many: DataFrame, one: DataFrame, key: str, total: int, most: int | None = None) -> DataFrame:
    """``many`` joined with ``one``, in which each ``key`` stands once with ``n``, its rows in ``many`` (``total`` in all, or
    less; ``most`` for one key, where that is known).  Hot keys are ``HOT_SHARE`` at most, as their rows are more than that
    share of the total, so they go to every executor and the rows of ``many`` stay where they are; other keys meet in a
    shuffle.  So no task gathers the rows of one key, however many it has."""
    least = max(HOT_ROWS, total // HOT_SHARE)
    rest = one.hint("merge")
    if min(total, total if most is None else most) <= least:  # no key is hot
        return many.join(rest, key)
    hot = F.col("n") > least
    few = F.broadcast(one.where(hot).withColumn("_hot", F.lit(True)))
    met = many.join(few, key, "left")
    cold = met.where("_hot is null").select(*many.columns).join(one.where(~hot).hint("merge"), key)
    return met.where("_hot").select(*cold.columns).unionAll(cold)


def sum_and_most(df: DataFrame, column: str) -> tuple[int, int]:
    """The sum and the largest of a column, which tell ``spread_join`` whether there are hot keys."""
    return tuple(int(x or 0) for x in df.agg(F.sum(column), F.max(column)).first())
