"""A map of unique keys: hash-partitioned rows ``key, value`` and set-wise forms of its updates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..partition import hash_owner


@dataclass(frozen=True)
class KVMap:
    df: DataFrame

    def insert(self, rows: DataFrame) -> KVMap:
        """New keys only: a key that is there, or that came earlier (by ``seq``, then the smaller value), keeps its value."""
        fresh = rows.groupBy("key").agg(F.min(F.struct("seq", "value"))["value"].alias("value")).join(self.df, "key", "left_anti")
        return KVMap(self.df.unionByName(fresh.select("key", "value")))

    def assign(self, rows: DataFrame) -> KVMap:
        """Inserted or overwritten; the latest by ``seq`` wins, then the larger value.  One aggregation instead of a join."""
        old = self.df.select("key", "value", F.lit(0).alias("_new"), F.lit(0).cast("long").alias("_seq"))
        new = rows.select("key", "value", F.lit(1).alias("_new"), F.col("seq").cast("long").alias("_seq"))
        return KVMap(old.unionByName(new).groupBy("key").agg(F.max(F.struct("_new", "_seq", "value"))["value"].alias("value")))

    def erase(self, keys: DataFrame) -> KVMap:
        return KVMap(self.df.join(keys.select("key"), "key", "left_anti"))

    def apply(self, log: DataFrame) -> KVMap:
        """An operation log ``seq, op, key, value`` by kind: all inserts, then all assignments, then all erasures."""
        kind = lambda k: log.where(F.col("op") == k)
        return self.insert(kind("insert")).assign(kind("assign")).erase(kind("erase"))

    def merge(self, other: KVMap) -> KVMap:
        """Both maps' keys; the other's value where both have one."""
        return self.assign(other.df.withColumn("seq", F.lit(0)))

    def add(self, rows: DataFrame) -> KVMap:
        """``map[key] += value`` for every row."""
        return KVMap(self.df.select("key", "value").unionByName(rows.select("key", "value")).groupBy("key").agg(F.sum("value").alias("value")))

    def find(self, keys: DataFrame) -> DataFrame:
        """Every row of ``keys`` with the value of its key, or null."""
        return keys.join(self.df.select("key", "value"), "key", "left")

    def contains(self, keys: DataFrame) -> DataFrame:
        there = self.df.select("key", F.lit(True).alias("_there"))
        return keys.join(there, "key", "left").withColumn("contains", F.col("_there").isNotNull()).drop("_there")

    def get(self, key) -> DataFrame:
        return self.df.where(F.col("key") == F.lit(key)).select("value")

    def get_or(self, key, default) -> DataFrame:
        """One row: the value of a key, or the default."""
        return self.get(key).agg(F.coalesce(F.first("value"), F.lit(default)).alias("value"))

    def put(self, key, value) -> KVMap:
        """``map[key] = value``."""
        kind = self.df.schema
        row = self.df.sparkSession.range(1).select(F.lit(key).cast(kind["key"].dataType).alias("key"), F.lit(value).cast(kind["value"].dataType).alias("value"), F.col("id").alias("seq"))
        return self.assign(row)

    def discard(self, *keys) -> KVMap:
        return KVMap(self.df.where(~F.col("key").isin(list(keys)))) if keys else self

    def items(self, p: int) -> DataFrame:
        """All entries with their owners, as iteration meets them: owner by owner, keys in order."""
        return self.df.select(self.owner(p).alias("owner"), "key", "value")

    def size(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("size"))

    def local_sizes(self, p: int) -> DataFrame:
        return self.df.groupBy(self.owner(p).alias("owner")).agg(F.count("*").alias("size"))

    @staticmethod
    def owner(p: int) -> Column:
        return hash_owner(F.col("key"), p)

    def clear(self) -> KVMap:
        return KVMap(self.df.limit(0))
