"""Pitch geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project(u: Column, v: Column, h: list[float]) -> tuple[Column, Column]:
    """The projective image of (u, v) under the 3 x 3 matrix h (row by row)."""
    d = h[6] * u + h[7] * v + h[8]
    return (h[0] * u + h[1] * v + h[2]) / d, (h[3] * u + h[4] * v + h[5]) / d


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def play_area(x: Column, y: Column, width: float, length: float, interior: float = 0.35, boundary: float = 1.25) -> Column:
    """inside_play, boundary_transient or outside_play of an unclamped point."""
    inside = F.least(x, width - x, y, length - y)
    out = F.hypot(x - clamp(x, 0.0, width), y - clamp(y, 0.0, length))
    return F.when(inside >= interior, "inside_play").when(out <= boundary, "boundary_transient").otherwise("outside_play")


def box_overlap(a: list[Column], b: list[Column], least: float = 1.0) -> tuple[Column, Column]:
    """IoU and containment (by the smaller area) of boxes x1, y1, x2, y2; sides are `least` long at least (a pixel), also of boxes turned around."""
    zero = F.lit(0.0)
    common = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(F.lit(least), r[2] - r[0]) * F.greatest(F.lit(least), r[3] - r[1])
    return F.coalesce(F.try_divide(common, area(a) + area(b) - common), zero), F.coalesce(F.try_divide(common, F.least(area(a), area(b))), zero)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point is inside (ray casting) or on an edge."""
    crossings, edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        line = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
        edge = edge | (line & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return edge | (crossings % 2 == 1)


def direction(forward: Column, least: float = 1.5) -> Column:
    return F.when(forward.isNull(), "unknown").when(forward >= least, "forward").when(forward <= -least, "backward").otherwise("lateral")


def segment_distance(px: Column, py: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The distance from a point to a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = F.coalesce(F.try_divide((px - a[0]) * dx + (py - a[1]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = clamp(t, 0.0, 1.0)
    return F.hypot(px - a[0] - t * dx, py - a[1] - t * dy)


def forward(x1: Column, y1: Column, x2: Column, y2: Column, attack: Column) -> Column:
    """Signed metres of a move along the attacking direction (x+, x-, y+, y-); null if it is unknown."""
    return F.when(attack == "x+", x2 - x1).when(attack == "x-", x1 - x2).when(attack == "y+", y2 - y1).when(attack == "y-", y1 - y2)


def progress(x: Column, y: Column, attack: Column, width: float, length: float) -> Column:
    """How far along the attacking direction a point is, from 0 to 1."""
    along = F.when(attack == "x+", x / width).when(attack == "x-", 1 - x / width).when(attack == "y+", y / length).when(attack == "y-", 1 - y / length)
    return F.when(along.isNotNull(), clamp(along, 0.0, 1.0))


def restart(x: Column, y: Column, width: float, length: float, near: float = 0.8, corner: float = 5.0) -> Column:
    """The restart at the nearest boundary line: kick_in on a touchline (left, right), corner within 5 m of one on a goal line, else ignored_goal_line_restart; null if no line is near.

    Ties resolve in the order left, right, top, bottom.
    """
    lines = [(F.abs(x), 0), (F.abs(F.lit(width) - x), 1), (F.abs(y), 2), (F.abs(F.lit(length) - y), 3)]
    first = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for d, i in lines]))
    goal = F.when(F.least(F.abs(x), F.abs(F.lit(width) - x)) <= corner, "corner").otherwise("ignored_goal_line_restart")
    return F.when(first["d"] > near, None).when(first["i"] <= 1, "kick_in").otherwise(goal)


def colour_similarity(a: list[Column], b: list[Column]) -> Column:
    """1 - RGB distance / the largest distance."""
    far = sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))
    return 1 - F.sqrt(far.cast("double")) / F.sqrt(F.lit(3.0 * 255 * 255))
