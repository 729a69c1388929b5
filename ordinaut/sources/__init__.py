"""Sequences from ranges, arrays and files, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..partition import block_offset, block_owner, cyclic_owner, delinear
from ..seq import Seq

#: Element types by name; there are no unsigned types, so those are widened by one step.
TYPES = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "byte": T.BinaryType(), "bool": T.BooleanType(), "string": T.StringType(),
}


def filled(spark: SparkSession, n: int, value: Any = 0, dtype: str = "float64", fixed: bool = False, n_blocks: int = 0) -> Seq:
    """``n`` equal values."""
    if dtype not in TYPES:
        raise InvalidArgument(f"no element type {dtype!r}")
    return Seq(spark.range(n).select(F.col("id").alias("idx"), F.lit(value).cast(TYPES[dtype]).alias("value")), n, n_blocks, fixed=fixed)


def generated(spark: SparkSession, n: int, rule: Callable[[Column], Column], n_blocks: int = 0) -> Seq:
    """A value for each index, by a Column rule."""
    return Seq(spark.range(n).select(F.col("id").alias("idx"), rule(F.col("id")).alias("value")), n, n_blocks)


def iota(spark: SparkSession, n: int, start: int = 0, step: int = 1, n_blocks: int = 0) -> Seq:
    return generated(spark, n, lambda i: F.lit(start) + i * F.lit(step), n_blocks)


def local_iota(spark: SparkSession, n: int, n_blocks: int, start: int = 0) -> Seq:
    """Counts anew in every block."""
    return generated(spark, n, lambda i: F.lit(start) + i - block_offset(block_owner(i, n, n_blocks), n, n_blocks), n_blocks)


def generated_by_state(spark: SparkSession, n: int, generator: Callable[[], Iterator[float]], n_blocks: int = 1) -> Seq:
    """Values from a Python generator that keeps state, one generator a block."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for block, size, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = generator()
                for at in range(0, size, 65_536):
                    k = min(65_536, size - at)
                    yield pa.RecordBatch.from_arrays([pa.array(range(offset + at, offset + at + k), pa.int64()), pa.array([float(next(own)) for _ in range(k)])], ["idx", "value"])

    q, r = divmod(n, n_blocks)
    blocks = spark.range(n_blocks).select(F.col("id").alias("block"), (F.lit(q) + (F.col("id") < r).cast("int")).cast("long").alias("size"), block_offset(F.col("id"), n, n_blocks).alias("offset"))
    return Seq(blocks.repartition(n_blocks, "block").mapInArrow(run, "idx long, value double"), n, n_blocks)


def from_values(spark: SparkSession, values: Sequence, dtype: str = "int64", n_blocks: int = 0, cyclic: int = 0) -> Seq:
    """A Python list or NumPy array by element type, sent as Arrow columns.  ``n_blocks`` is the block placement; with ``cyclic``
    the frame also has ``owner``, the block of each value when runs of that many go to the blocks in turn."""
    import pyarrow as pa

    kind = TYPES[dtype]
    schema = T.StructType([T.StructField("idx", T.LongType(), False), T.StructField("value", kind, False)])
    if dtype in _ARROW:
        table = pa.table({"idx": pa.array(range(len(values)), pa.int64()), "value": pa.array(values, getattr(pa, _ARROW[dtype])())})
        df = spark.createDataFrame(table, schema=schema)
    else:
        df = spark.createDataFrame([(i, v.item() if hasattr(v, "item") else v) for i, v in enumerate(values)], schema)
    out = Seq(df, len(values), n_blocks)
    return out.with_df(df.withColumn("owner", cyclic_owner(F.col("idx"), out.n_blocks, cyclic))) if cyclic else out


_ARROW = {"int8": "int8", "int16": "int16", "int32": "int32", "int64": "int64", "uint8": "int16", "uint16": "int32", "uint32": "int64", "float32": "float32", "float64": "float64", "bool": "bool_", "string": "string"}


def from_numpy(spark: SparkSession, array, n_blocks: int = 0) -> Seq:
    """Arrow all the way; the element type follows the array's."""
    import numpy as np
    import pandas as pd

    array = np.ascontiguousarray(array).ravel()
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(array), dtype="int64"), "value": array}))
    return Seq(df, len(array), n_blocks)


def to_numpy(seq: Seq):
    """The whole sequence on the driver, in order: for results that fit there."""
    return seq.df.select("idx", seq.v.alias("value")).orderBy("idx").toPandas()["value"].to_numpy()


def tensor_frame(spark: SparkSession, extents: Sequence[int], rule: Callable[..., Column], column_major: bool = False) -> DataFrame:
    """A row for each coordinate ``i0, i1, ...`` of a dense tensor."""
    n = 1
    for e in extents:
        n *= e
    coords = delinear(F.col("id"), extents, column_major)
    names = [f"i{k}" for k in range(len(extents))]
    df = spark.range(n).select(F.col("id").alias("idx"), *(c.alias(name) for c, name in zip(coords, names, strict=True)))
    return df.withColumn("value", rule(*(F.col(name) for name in names)))


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A file source with an explicit schema where the format has none of its own."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(form).load(path)


def write(seq: Seq, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Files ranged by index, so that a later slice reads few of them."""
    seq.df.repartitionByRange(seq.n_blocks, "idx").sortWithinPartitions("idx").write.mode(mode).format(form).save(path)
