"""Ownership rules as Column functions: which block holds an index, and where in it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import BadPartition, InvalidArgument


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def quotient(a: Column, b: int) -> Column:
    """Floor of ``a / b`` for a non-negative long column, without a detour through doubles."""
    return a.cast("long") if b == 1 else F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def block_size(block: Column | int, n: int, p: int) -> Column:
    q, r = divmod(n, p)
    return F.lit(q).cast("long") + F.when(_long(block) < r, F.lit(1)).otherwise(F.lit(0))


def block_offset(block: Column | int, n: int, p: int) -> Column:
    q, r = divmod(n, p)
    return _long(block) * q + F.least(_long(block), F.lit(r).cast("long"))


def block_owner(idx: Column, n: int, p: int) -> Column:
    """The first ``n mod p`` blocks hold one more than the others."""
    if p < 1:
        raise InvalidArgument("a sequence has one block at least")
    q, r = divmod(n, p)
    edge = r * (q + 1)
    idx = idx.cast("long")
    if q == 0:
        return idx
    if r == 0:
        return quotient(idx, q)
    return F.when(idx < edge, quotient(idx, q + 1)).otherwise(quotient(idx - edge, q) + r)


def block_to_local(idx: Column, n: int, p: int) -> Column:
    return idx.cast("long") - block_offset(block_owner(idx, n, p), n, p)


def block_to_global(block: Column, local: Column, n: int, p: int) -> Column:
    return block_offset(block, n, p) + local.cast("long")


def cyclic_owner(idx: Column, p: int, width: int = 1) -> Column:
    return quotient(idx, width) % p


def cyclic_to_local(idx: Column, p: int, width: int = 1) -> Column:
    return quotient(idx, width * p) * width + idx.cast("long") % width


def cyclic_to_global(owner: Column, local: Column, p: int, width: int = 1) -> Column:
    return (quotient(local, width) * p + owner.cast("long")) * width + local.cast("long") % width


def cyclic_size(owner: Column | int, n: int, p: int, width: int = 1) -> Column:
    rounds, rest = divmod(n, width * p)
    left = F.least(F.greatest(F.lit(rest).cast("long") - _long(owner) * width, F.lit(0).cast("long")), F.lit(width).cast("long"))
    return F.lit(rounds * width).cast("long") + left


def hash_owner(key: Column, p: int) -> Column:
    """Owners differ from other systems' but equal keys meet."""
    return F.pmod(F.xxhash64(key), F.lit(p)).cast("int")


def dynamic_owner(idx: Column, sizes: Sequence[int], n: int | None = None) -> Column:
    """Blocks of explicit sizes."""
    if any(s < 0 for s in sizes) or (n is not None and sum(sizes) != n):
        raise BadPartition(f"sizes {list(sizes)} don't cover {n}")
    out, end = F.lit(None).cast("long"), sum(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        out = F.when(idx < end, F.lit(k).cast("long")).otherwise(out)
        end -= sizes[k]
    return out


def custom_owner(idx: Column, rule: Callable[[Column], Column]) -> Column:
    return rule(idx).cast("long")


def nd_owner(coords: Sequence[Column], extents: Sequence[int], grid: Sequence[int]) -> Column:
    """Block rule along every dimension of a process grid, numbered row by row."""
    out = F.lit(0).cast("long")
    for c, n, p in zip(coords, extents, grid, strict=True):
        out = out * p + block_owner(c, n, p)
    return out


def linear(coords: Sequence[Column], extents: Sequence[int], column_major: bool = False) -> Column:
    """Position of a coordinate in the flat order."""
    pairs = list(zip(coords, extents, strict=True))
    out = F.lit(0).cast("long")
    for c, n in reversed(pairs) if column_major else pairs:
        out = out * n + c.cast("long")
    return out


def delinear(idx: Column, extents: Sequence[int], column_major: bool = False) -> list[Column]:
    """Coordinates of a flat position."""
    out, rest = [], idx.cast("long")
    order = extents if column_major else list(reversed(extents))
    for n in order:
        out.append(rest % n)
        rest = quotient(rest, n)
    return out if column_major else list(reversed(out))
