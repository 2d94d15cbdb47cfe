"""Angles, lengths and plane geometry as Column functions; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def azimuth(dx: Column, dy: Column) -> Column:
    """Compass azimuth in degrees, [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def az_diff_undirected(a: Column, b: Column) -> Column:
    """Angle between two lines, [0, 90]."""
    return F.abs(F.pmod(a - b + 90, F.lit(180.0)) - 90)


def az_diff_directed(a: Column, b: Column) -> Column:
    """Angle between two directions, [0, 180]."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def distance_tolerance(want: Column, base: float = 0.30, share: float = 0.0005) -> Column:
    """Absolute tolerance of a printed length."""
    return base + share * want


def bearing_tolerance(length: Column, width: float, low: float = 0.05, high: float = 0.5) -> Column:
    """Angle that a lateral ``width`` makes over a length, within limits."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.degrees(F.atan2(F.lit(width), length))))


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Position of a point's foot on the line through a and b, 0 at a, 1 at b; null for a point segment."""
    l2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    return F.when(l2 > 0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / l2)


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along(px, py, ax, ay, bx, by), F.lit(0.0))))
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(dx * dx + dy * dy)


def perpendicular(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed offset of a point from the line through a and b; left is positive."""
    n = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    return F.when(n > 0, ((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / n)


def similarity(x: Column, y: Column, a: Column, b: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    """x' = a x - b y + tx, y' = b x + a y + ty."""
    return a * x - b * y + tx, b * x + a * y + ty


def walk(x: Column, y: Column, az: Column, d: Column) -> tuple[Column, Column]:
    """The end of a course."""
    return x + d * F.sin(F.radians(az)), y + d * F.cos(F.radians(az))


def arc_length(radius: Column, delta: Column) -> Column:
    return radius * F.radians(delta)


def chord(radius: Column, delta: Column) -> Column:
    return 2 * radius * F.sin(F.radians(delta) / 2)


def circumradius(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Radius of the circle through three points; null if they are collinear."""
    area2 = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    side = lambda ux, uy, vx, vy: F.sqrt((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy))
    return F.when(area2 != 0, side(ax, ay, bx, by) * side(bx, by, cx, cy) * side(cx, cy, ax, ay) / (2 * F.abs(area2)))


def circular_mean_180(angle: Column, weight: Column) -> Column:
    """Aggregate: weighted mean of undirected angles, by doubled angles, in degrees of (-90, 90]."""
    return F.degrees(F.atan2(F.sum(weight * F.sin(F.radians(2 * angle))), F.sum(weight * F.cos(F.radians(2 * angle))))) / 2


def wrong_match(kind: Column, off: Column, printed: Column, line: float = 0.5, arc: float = 0.25) -> Column:
    """Whether a deviation is so large that the match, not the value, is wrong; unknown stays unknown.

    A line's deviation counts against the printed or the drawn length, whichever is smaller.
    """
    drawn = printed + off
    share = F.abs(off) / F.when(kind == "line", F.least(F.abs(printed), F.abs(drawn))).otherwise(F.abs(printed))
    return F.when(share.isNotNull(), share > F.when(kind == "line", line).otherwise(arc))


def gps_seconds(v: Column) -> Column:
    """Adjusted standard GPS time (offset by 10**9) as a timestamp."""
    return F.timestamp_seconds(v + F.lit(1_000_000_000 + 315_964_800))


def in_any_box(px: Column, py: Column, boxes: list[tuple[float, float, float, float]], pad: float = 0.0) -> Column:
    """Whether a point lies in a box (x0, y0, x1, y1) grown by ``pad``, its border included; unknown stays unknown."""
    inside = F.lit(False)
    for x0, y0, x1, y1 in boxes:
        inside = inside | (px.between(x0 - pad, x1 + pad) & py.between(y0 - pad, y1 + pad))
    return F.when(px.isNotNull() & py.isNotNull(), inside)


def nearest_station(px: Column, py: Column, axis: list[tuple[float, float]]) -> Column:
    """struct<distance, station> of a point's nearest place on a fixed polyline; the smaller station on ties."""
    found, at = [], 0.0
    for (ax, ay), (bx, by) in zip(axis, axis[1:], strict=False):
        a, b, c, d = map(F.lit, (ax, ay, bx, by))
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along(px, py, a, b, c, d), F.lit(0.0))))
        found.append(F.struct(point_segment_distance(px, py, a, b, c, d).alias("distance"), (F.lit(at) + t * length).alias("station")))
        at += length
    return F.when(px.isNotNull() & py.isNotNull(), F.array_min(F.array(*found)))


def curve_verdict(radius: Column, delta: Column, length: Column, flat: float = 0.5) -> Column:
    """Whether L = R * delta holds: 'pass', 'fail', 'unproven' for an arc too flat to judge, 'queued' if a value is missing."""
    off = F.abs(length - arc_length(radius, delta))
    sagitta = radius * (1 - F.cos(F.radians(delta) / 2))
    return F.when(off.isNull(), "queued").when(off <= 0.02 + 0.0005 * length, "pass").when(sagitta < flat, "unproven").otherwise("fail")
