"""Connected components by alternating large-star and small-star steps; no adjacency list is ever gathered, and the rows of
a node with very many neighbours are never in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours go to the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return spread_join(both, low, "a", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("low"))
    moved = spread_join(down, low, "a", n).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.unionAll(low.select("a", F.col("low").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``, where root is the smallest node of its component, itself with
    none but its own row left out.  Each step is written to the shared folder."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while True:
        middle = written(_large(now, state[0]), "stars")
        now = written(_small(middle, state[0]), "stars")
        last, state = state, _state(now)
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
