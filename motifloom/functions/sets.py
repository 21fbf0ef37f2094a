"""Vertex-set algebra: expressions over arrays of distinct ids.

Each has a counting form that never builds rows. Arrays need not be sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def bounded(a, upper) -> Column:
    """Members less than ``upper``."""
    upper = _c(upper)
    return F.filter(_c(a), lambda x: x < upper)


def intersect(a, b, upper=None) -> Column:
    both = F.array_intersect(_c(a), _c(b))
    return both if upper is None else bounded(both, upper)


def subtract(a, b, owner=None, upper=None) -> Column:
    """Members of ``a`` that aren't in ``b``, nor ``owner``, the vertex whose neighbours ``b`` are."""
    left = F.array_except(_c(a), _c(b))
    if owner is not None:
        left = F.array_remove(left, _c(owner))
    return left if upper is None else bounded(left, upper)


def remove(a, one) -> Column:
    return F.array_remove(_c(a), _c(one))


def without(a, used: Sequence) -> Column:
    """Members that aren't among the already matched vertices ``used``."""
    return F.array_except(_c(a), F.array(*map(_c, used))) if used else _c(a)


def split3(a, b) -> Column:
    """``left``, ``both`` and ``right``: members of ``a`` only, of both and of ``b`` only."""
    a, b = _c(a), _c(b)
    return F.struct(F.array_except(a, b).alias("left"), F.array_intersect(a, b).alias("both"), F.array_except(b, a).alias("right"))


def intersect_all(arrays: Sequence) -> Column:
    out = _c(arrays[0])
    for other in arrays[1:]:
        out = F.array_intersect(out, _c(other))
    return out


def intersect_count(a, b, upper=None) -> Column:
    return F.size(intersect(a, b, upper)).cast("long")


def subtract_count(a, b, owner=None, upper=None) -> Column:
    return F.size(subtract(a, b, owner, upper)).cast("long")


def bounded_count(a, upper) -> Column:
    return F.size(bounded(a, upper)).cast("long")


def remove_count(a, one) -> Column:
    return F.size(remove(a, one)).cast("long")


def positions(a, b) -> Column:
    """Places, from 0, in ``a`` of the members of ``b`` that it has."""
    a = _c(a)
    return F.transform(F.array_intersect(_c(b), a), lambda x: F.array_position(a, x) - 1)


def canonical_classes(ids: Sequence, div: int) -> Column:
    """The sorted remainders of ids modulo ``div``."""
    return F.array_sort(F.array(*[F.pmod(_c(x), F.lit(div)) for x in ids]))
