"""Count and time windows over streams: the chunk, window and run views of a stream with event times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, length: str, late: str, *keys: str, **aggregates: Column) -> DataFrame:
    """Windows side by side; rows later than ``late`` after the latest time seen are left out, as state must end."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def sliding(stream: DataFrame, time: str, length: str, step: str, late: str, *keys: str, **aggregates: Column) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, length, step), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def sessions(stream: DataFrame, time: str, gap: str, late: str, *keys: str, **aggregates: Column) -> DataFrame:
    """Runs of rows that follow one another within ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def numbered_chunks(stream: DataFrame, number: str, k: int, *keys: str, **aggregates: Column) -> DataFrame:
    """Count windows by a dense number that the rows carry."""
    return stream.groupBy(F.floor(F.col(number) / k).alias("chunk"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def drain(frame: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All of a bounded stream through a memory sink, for tests."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return frame.sparkSession.table(name)
