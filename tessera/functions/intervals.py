"""Algebra of half-open intervals [start, end), with an optional plane and refinement.

Touching intervals don't overlap; an empty interval overlaps what it lies strictly inside of. A null bound
overlaps nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(start: Column, end: Column) -> Column:
    return end - start


def covers(a: tuple, b: tuple) -> Column:
    """The extents of (start, end[, plane[, ...]]) a and b meet on one plane, whatever the refinement."""
    met = (a[0] < b[1]) & (b[0] < a[1])
    return met & (a[2] == b[2]) if len(a) > 2 else met


def overlaps(a: tuple, b: tuple) -> Column:
    """As ``covers``, with equal refinement (fourth element) too."""
    met = covers(a, b)
    return met & (a[3] == b[3]) if len(a) > 3 else met


def distance(a: tuple, b: tuple) -> Column:
    """Gap between two intervals; 0 if they meet or touch; null across planes."""
    gap = F.greatest(b[0] - a[1], a[0] - b[1], F.lit(0).cast("long"))
    return F.when(a[2] == b[2], gap) if len(a) > 2 else gap


def compare(a: tuple, b: tuple) -> Column:
    """-1, 0 or 1 in the order of plane, start, end."""
    ka = F.struct(*([a[2].alias("p")] if len(a) > 2 else []), a[0].alias("s"), a[1].alias("e"))
    kb = F.struct(*([b[2].alias("p")] if len(b) > 2 else []), b[0].alias("s"), b[1].alias("e"))
    return F.when(ka < kb, -1).when(ka > kb, 1).otherwise(0)
