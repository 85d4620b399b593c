"""Column functions on coordinates. Columns are suffixed: _lon/_lat in degrees, _mx/_my in unit Web Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lng_x(lng) -> Column:
    return col(lng) / F.lit(360.0) + F.lit(0.5)


def lat_y(lat) -> Column:
    """Clamped to [0, 1]; the poles are guarded because the formula divides by zero there."""
    s = F.sin(F.radians(col(lat)))
    y = F.lit(0.5) - F.lit(0.25) * F.log((F.lit(1.0) + s) / (F.lit(1.0) - s)) / F.lit(math.pi)
    return F.when(col(lat) >= 90, F.lit(0.0)).when(col(lat) <= -90, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))


def x_lng(x) -> Column:
    return (col(x) - F.lit(0.5)) * F.lit(360.0)


def y_lat(y) -> Column:
    return F.lit(360.0) * F.atan(F.exp((F.lit(180.0) - col(y) * F.lit(360.0)) * F.lit(math.pi / 180))) / F.lit(math.pi) - F.lit(90.0)


def length2(x1, y1, x2, y2) -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return dx * dx + dy * dy


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(length2(x1, y1, x2, y2))


def guarded_length(x1, y1, x2, y2, eps: float = EPS) -> Column:
    tiny = (F.abs(col(x1) - col(x2)) < eps) & (F.abs(col(y1) - col(y2)) < eps)
    return F.when(tiny, F.lit(eps)).otherwise(distance(x1, y1, x2, y2))


def degree(x1, y1, x2, y2) -> Column:
    """Slope in degrees; null for a vertical edge."""
    return F.degrees(F.atan(F.try_divide(col(y2) - col(y1), col(x2) - col(x1))))


def zoom_radius(radius, zoom) -> Column:
    return F.lit(float(radius)) / (F.lit(512.0) * F.pow(F.lit(2.0), col(zoom)))


def wrap_lng(lng: float) -> float:
    """Into [-180, 180)."""
    return (lng + 180.0) % 360.0 - 180.0


def project(px, py, ax, ay, bx, by) -> Column:
    """The point of line a-b next to p, as struct(r, x, y); r is its place on the line, null for a degenerate one."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    r = F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), (bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    return F.struct(r.alias("r"), (ax + r * (bx - ax)).alias("x"), (ay + r * (by - ay)).alias("y"))


def line_width(weight) -> Column:
    return F.greatest(F.least(F.ceil(F.sqrt(col(weight))), F.lit(15)), F.lit(1)).cast("int")


def label_size(size) -> Column:
    return F.greatest(F.least(F.ceil(F.sqrt(col(size))), F.lit(20)), F.lit(1)).cast("int")


def gradient(at, size) -> Column:
    """Colour of segment `at` of `size`: from blue to red."""
    p = (col(at).cast("float") / col(size).cast("float")).cast("float")
    return F.array(F.round(p * F.lit(255).cast("float")).cast("int"), F.lit(0), F.round((F.lit(1).cast("float") - p) * F.lit(255).cast("float")).cast("int"))


def step_size(zoom: int) -> float:
    return max(0.025 - 0.0025 * zoom, 0.001)
