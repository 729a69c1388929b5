"""Whole computations: Monte Carlo pi, Jacobi relaxation, conjugate gradients, N-body steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import written
from ..seq import Seq
from .scan import stencil


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that the key alone decides, from the first 32 bits of its MD5: other than ``rand``, the same wherever and
    however often a row is made."""
    text = F.concat_ws(":", *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def monte_carlo_pi(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Four times the share of ``n`` drawn points of the unit square that lie in the circle."""
    i = F.col("id")
    inside = uniform(F.lit(seed), i) ** 2 + uniform(F.lit(seed + 1), i) ** 2 <= 1
    return spark.range(n).select(inside.alias("inside")).agg((4 * F.count_if("inside") / F.lit(n)).alias("pi"))


def jacobi_step(seq: Seq) -> Seq:
    """The mean of both neighbours inside, the ends as they are."""
    inside = lambda i: (i > 0) & (i < seq.size - 1)
    return stencil(seq, 1, lambda i, v, left, right: F.when(inside(i), (left[0] + right[0]) / 2).otherwise(v))


def jacobi(seq: Seq, tolerance: float = 1e-8, most: int = 1000, every: int = 8) -> tuple[Seq, int, float]:
    """Steps until the largest change is below ``tolerance``; lineage is cut every few steps."""
    change, k = float("inf"), 0
    while k < most and change > tolerance:
        before = seq
        seq = jacobi_step(seq)
        k += 1
        if k % every == 0 or k == most:
            seq = seq.with_df(written(seq.df, "step"))
            last = before.df.select("idx", before.v.alias("_b"))
            change = seq.df.join(last, "idx").agg(F.max(F.abs(seq.v - F.col("_b")))).first()[0] or 0.0
    return seq, k, change


def conjugate_gradient(b: Seq, tolerance: float = 1e-10, most: int = 200) -> tuple[Seq, int, float]:
    """Solves the tridiagonal system (-1, 2, -1) x = b.  The vectors x, r, p are columns of one frame."""
    df = written(b.df.select("idx", F.lit(0.0).alias("x"), b.v.cast("double").alias("r"), b.v.cast("double").alias("p")), "step")
    rr = df.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    k = 0
    while k < most and rr > tolerance * tolerance:
        p = Seq(df, b.size, b.n_blocks, "p")
        zero = F.lit(0.0)
        ap = stencil(p.with_df(df.withColumn("q", F.col("p"))), 1, lambda i, v, left, right: 2 * v - F.coalesce(left[0], zero) - F.coalesce(right[0], zero)).df
        df = written(ap.select("idx", "x", "r", F.col("q").alias("p"), F.col("p").alias("ap")), "step")
        alpha = rr / df.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        df = df.select("idx", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new = df.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        df = df.withColumn("p", F.col("r") + (new / rr) * F.col("p"))
        rr, k = new, k + 1
    return Seq(df.select("idx", F.col("x").alias("value")), b.size, b.n_blocks), k, rr**0.5


def nbody_forces(bodies: DataFrame, softening: float = 1e-9, most: int = 20_000) -> DataFrame:
    """``id, ax, ay, az`` from every pair of ``bodies(id, x, y, z, m)``: a direct sum, whose pairs are the operator's
    definition.  The other bodies are sent out in blocks of about ``most``, whose partial forces add up."""
    parts = max(1, -(-bodies.count() // most))
    partial = None
    for k in range(parts):
        block = bodies if parts == 1 else bodies.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        other = block.select(F.col("id").alias("o"), *(F.col(c).alias(f"o{c}") for c in "xyz"), F.col("m").alias("om"))
        d = {c: F.col(f"o{c}") - F.col(c) for c in "xyz"}
        r2 = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"] + softening
        pairs = bodies.join(F.broadcast(other), F.col("id") != F.col("o"), "left")
        w = F.col("om") / (r2 * F.sqrt(r2))
        own = pairs.groupBy("id").agg(*(F.coalesce(F.sum(w * d[c]), F.lit(0.0)).alias(f"a{c}") for c in "xyz"))
        if parts > 1:  # each block's work is done, and its rows freed, before the next is sent
            own = written(own, "step")
        partial = own if partial is None else partial.unionAll(own)
    return partial if parts == 1 else partial.groupBy("id").agg(*(F.sum(f"a{c}").alias(f"a{c}") for c in "xyz"))


def nbody_step(bodies: DataFrame, dt: float, softening: float = 1e-9) -> DataFrame:
    """One leapfrog step of ``bodies(id, x, y, z, vx, vy, vz, m)``: half a kick, a drift, half a kick."""
    kick = lambda df: df.join(nbody_forces(df, softening), "id").select("id", "x", "y", "z", *((F.col(f"v{c}") + F.col(f"a{c}") * (dt / 2)).alias(f"v{c}") for c in "xyz"), "m")
    half = kick(bodies)
    moved = half.select("id", *((F.col(c) + F.col(f"v{c}") * dt).alias(c) for c in "xyz"), "vx", "vy", "vz", "m")
    return kick(moved)
