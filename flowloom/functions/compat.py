"""Compatibility of two edges: the four factors, their product and the predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.geo import distance


#: Columns of with_geometry(): length, direction, midpoint.
GEOMETRY = ("len", "ex", "ey", "mx", "my")


def with_geometry(edges: DataFrame) -> DataFrame:
    """edges(fx, fy, tx, ty, ...) with GEOMETRY, so that a join of pairs computes them once for each edge."""
    ends = ("fx", "fy", "tx", "ty")
    return edges.withColumns({"len": distance(*ends), "ex": F.col("tx") - F.col("fx"), "ey": F.col("ty") - F.col("fy"), "mx": (F.col("fx") + F.col("tx")) / 2, "my": (F.col("fy") + F.col("ty")) / 2})


def _of(p: str):
    return tuple(F.col(f"{p}.{c}") for c in ("fx", "fy", "tx", "ty"))


def _geometry(p: str, known: bool):
    """GEOMETRY of p: its own columns if they are known, else from its ends."""
    if known:
        return tuple(F.col(f"{p}.{c}") for c in GEOMETRY)
    ax, ay, bx, by = _of(p)
    return distance(ax, ay, bx, by), bx - ax, by - ay, (ax + bx) / 2, (ay + by) / 2


def angle(p: str, q: str, known: bool = False) -> Column:
    (a, ax, ay, _, _), (b, bx, by, _, _) = _geometry(p, known), _geometry(q, known)
    return F.abs((ax * bx + ay * by) / (a * b))


def scale(p: str, q: str, known: bool = False) -> Column:
    a, b = _geometry(p, known)[0], _geometry(q, known)[0]
    mean = (a + b) / 2
    return F.lit(2.0) / (mean / F.least(a, b) + F.greatest(a, b) / mean)


def position(p: str, q: str, known: bool = False) -> Column:
    (a, _, _, ax, ay), (b, _, _, bx, by) = _geometry(p, known), _geometry(q, known)
    mean = (a + b) / 2
    return mean / (mean + distance(ax, ay, bx, by))


def visibility(p: str, q: str, known: bool = False) -> Column:
    """The lesser visibility of one edge from the other; 0 at right angles.

    Seen from p, q's ends fall on places r0, r1 of p's line, and 1 - 2 |1/2 - (r0 + r1) / 2| / |r1 - r0| is visible. With the midpoints m
    and directions e, |1/2 - (r0 + r1) / 2| is |(mp - mq) ep| / ep^2 and |r1 - r0| is |ep eq| / ep^2.
    """
    (_, ax, ay, mx, my), (_, bx, by, nx, ny) = _geometry(p, known), _geometry(q, known)
    off = F.greatest(F.abs((mx - nx) * ax + (my - ny) * ay), F.abs((mx - nx) * bx + (my - ny) * by))
    along = F.abs(ax * bx + ay * by)
    return F.when(along == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2.0) * off / along))


def score(p: str, q: str, known: bool = False) -> Column:
    return angle(p, q, known) * scale(p, q, known) * position(p, q, known) * visibility(p, q, known)
