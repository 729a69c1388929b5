"""Reduction operators: aggregate, running and pairwise forms and the identity of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..errors import InvalidArgument


@dataclass(frozen=True)
class Reduction:
    """``agg`` of many values, ``join`` of two partial results; ``over`` is the running form."""

    agg: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]

    def over(self, value: Column, window: WindowSpec) -> Column:
        return self.agg(value).over(window)

    def total(self, value: Column, init: Column | None = None) -> Column:
        """The aggregate with ``init`` taking part once; ``init`` itself over no values."""
        found = self.agg(value)
        return found if init is None else F.coalesce(self.join(init, found), init)


def _xor_all(v: Column) -> Column:
    return F.count_if(v) % 2 == 1


REDUCTIONS: dict[str, Reduction] = {
    "sum": Reduction(F.sum, lambda a, b: a + b),
    "product": Reduction(F.product, lambda a, b: a * b),
    "min": Reduction(F.min, F.least),
    "max": Reduction(F.max, F.greatest),
    "land": Reduction(F.bool_and, lambda a, b: a & b),
    "lor": Reduction(F.bool_or, lambda a, b: a | b),
    "lxor": Reduction(_xor_all, lambda a, b: a != b),
    "band": Reduction(F.bit_and, lambda a, b: a.bitwiseAND(b)),
    "bor": Reduction(F.bit_or, lambda a, b: a.bitwiseOR(b)),
    "bxor": Reduction(F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "count": Reduction(F.count, lambda a, b: a + b),
}


def reduction(op: str | Reduction) -> Reduction:
    if isinstance(op, Reduction):
        return op
    if op not in REDUCTIONS:
        raise InvalidArgument(f"no reduction {op!r}; there are {', '.join(REDUCTIONS)}")
    return REDUCTIONS[op]


def min_location(value: Column, at: Column) -> Column:
    """Smallest value and where it is; the first place of several."""
    return F.min(F.struct(value.alias("value"), at.alias("idx")))


def max_location(value: Column, at: Column) -> Column:
    """Largest value and where it is; the first place of several."""
    best = F.max(F.struct(value.alias("value"), (-at).alias("back")))
    return F.when(best.isNotNull(), F.struct(best["value"].alias("value"), (-best["back"]).alias("idx")))
