"""N-d frames: a row a coordinate, with extents beside them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, OutOfBounds
from ..partition import block_owner, block_to_local, delinear, linear, nd_owner
from ..seq import Seq


@dataclass(frozen=True)
class Tensor:
    """``df`` has ``i0, i1, ..., value``; ``along`` is the dimension that is cut into blocks."""

    df: DataFrame
    extents: tuple[int, ...]
    along: int = 0
    column_major: bool = False

    @property
    def names(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.extents))]

    @property
    def coords(self) -> list[Column]:
        return [F.col(n) for n in self.names]

    @property
    def size(self) -> int:
        return prod(self.extents)

    def strides(self) -> tuple[int, ...]:
        order = self.extents if self.column_major else self.extents[::-1]
        out, step = [], 1
        for n in order:
            out.append(step)
            step *= n
        return tuple(out if self.column_major else out[::-1])

    def at(self, *place: int) -> DataFrame:
        if len(place) != len(self.extents) or any(not 0 <= i < n for i, n in zip(place, self.extents, strict=True)):
            raise OutOfBounds(f"{place} of {self.extents}")
        test = F.lit(True)
        for c, i in zip(self.coords, place, strict=True):
            test = test & (c == i)
        return self.df.where(test).select("value")

    def flat(self, n_blocks: int = 0) -> Seq:
        """The sequence in storage order."""
        return Seq(self.df.select(linear(self.coords, self.extents, self.column_major).alias("idx"), "value"), self.size, n_blocks)

    def owners(self, p: int) -> DataFrame:
        at, n = self.coords[self.along], self.extents[self.along]
        return self.df.withColumn("owner", block_owner(at, n, p)).withColumn("local", block_to_local(at, n, p))

    def grid_owners(self, grid: Sequence[int]) -> DataFrame:
        return self.df.withColumn("owner", nd_owner(self.coords, self.extents, grid))

    def reshape(self, *extents: int) -> Tensor:
        if prod(extents) != self.size:
            raise InvalidArgument(f"{self.extents} has not the size of {extents}")
        return from_flat(self.flat(), extents, self.column_major)


def from_flat(seq: Seq, extents: Sequence[int], column_major: bool = False) -> Tensor:
    if prod(extents) != seq.size:
        raise InvalidArgument(f"{seq.size} values are not {tuple(extents)}")
    coords = delinear(seq.idx, extents, column_major)
    return Tensor(seq.df.select(*(c.alias(f"i{k}") for k, c in enumerate(coords)), seq.v.alias("value")), tuple(extents), 0, column_major)
