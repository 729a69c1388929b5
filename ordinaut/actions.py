"""Named functions over frames: registered once, called by name where data is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidArgument

_ACTIONS: dict[str, tuple[Callable, str]] = {}


def action(name: str, schema: str) -> Callable[[Callable], Callable]:
    """Registers a function from an iterator of pandas frames to one."""

    def add(function: Callable) -> Callable:
        if name in _ACTIONS:
            raise InvalidArgument(f"there is an action {name!r} already")
        _ACTIONS[name] = (function, schema)
        return function

    return add


def call(df: DataFrame, name: str) -> DataFrame:
    """The action's frame; each partition's batches go through it."""
    if name not in _ACTIONS:
        raise InvalidArgument(f"no action {name!r}; there are {', '.join(sorted(_ACTIONS)) or 'none'}")
    function, schema = _ACTIONS[name]
    return df.mapInPandas(function, schema)


def register_sql(spark: SparkSession, name: str, function: Callable, returns: str) -> None:
    """A Python function by name in SQL."""
    spark.udf.register(name, function, returns)
