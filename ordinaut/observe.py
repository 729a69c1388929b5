"""Counters, gauges and histograms: what a frame's rows come to as they pass, without a pass of their own."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation whose ``get`` has the metrics once an action has run."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in metrics.items())), seen


def histogram(value: Column) -> dict[str, Column]:
    """What a histogram keeps: count, sum, smallest and largest."""
    return {"count": F.count(value), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}


@contextmanager
def timed(into: dict[str, float], name: str) -> Iterator[None]:
    """Seconds of the block, added up by name."""
    began = time.perf_counter()
    try:
        yield
    finally:
        into[name] = into.get(name, 0.0) + time.perf_counter() - began
