"""Distances, boxes and point-in-polygon as native column expressions.

All functions take columns (or numbers) and return columns, so that they stay inside whole-stage
code generation and Catalyst can push the cheap conjuncts down to the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.constants import (
    EARTH_RADIUS_M,
    MAX_ALTITUDE_M,
    MAX_LAT_FOR_LON,
    METERS_PER_DEGREE,
    MIN_ALTITUDE_M,
    WGS84_A,
)

Num = Column | float | int | str


def c(v: Num) -> Column:
    """A column from a column, a column name or a number (always as a double literal)."""
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(float(v))


def usable(x: Num = "x", y: Num = "y", z: Num | None = "z") -> Column:
    """Present, finite and in range.  ``between`` is false for NaN and infinity and null for null."""
    ok = c(x).between(-180.0, 180.0) & c(y).between(-90.0, 90.0)
    if z is not None:
        ok &= c(z).between(MIN_ALTITUDE_M, MAX_ALTITUDE_M)
    return F.coalesce(ok, F.lit(False))


def haversine(x1: Num, y1: Num, x2: Num, y2: Num) -> Column:
    """Great-circle metres on the mean sphere."""
    x1, y1, x2, y2 = c(x1), c(y1), c(x2), c(y2)
    p1, p2 = F.radians(y1), F.radians(y2)
    sp, sl = F.sin((p2 - p1) / 2.0), F.sin(F.radians(x2 - x1) / 2.0)
    a = sp * sp + F.cos(p1) * F.cos(p2) * sl * sl
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_3d(x1: Num, y1: Num, z1: Num, x2: Num, y2: Num, z2: Num) -> Column:
    # hypot evaluates the long expression once, also inside join conditions, where nothing shares subexpressions
    return F.hypot(haversine(x1, y1, x2, y2), c(z2) - c(z1))


def haversine_components(x1: Num, y1: Num, z1: Num, x2: Num, y2: Num, z2: Num) -> Column:
    """struct(horizontal, vertical, total)."""
    return F.struct(
        haversine(x1, y1, x2, y2).alias("horizontal"),
        F.abs(c(z2) - c(z1)).alias("vertical"),
        haversine_3d(x1, y1, z1, x2, y2, z2).alias("total"),
    )


def rhumb(x1: Num, y1: Num, x2: Num, y2: Num) -> Column:
    """Metres along the line of constant bearing, the short way around the globe."""
    p1, p2 = F.radians(c(y1)), F.radians(c(y2))
    dl = F.radians(c(x2) - c(x1))
    dl = F.when(dl > math.pi, dl - 2 * math.pi).when(dl < -math.pi, dl + 2 * math.pi).otherwise(dl)
    dp = p2 - p1
    dpsi = F.log(F.tan(F.lit(math.pi / 4) + p2 / 2.0) / F.tan(F.lit(math.pi / 4) + p1 / 2.0))
    q = F.when(F.abs(dpsi) > 1e-11, dp / dpsi).otherwise(F.cos(p1))
    return F.sqrt(dp * dp + q * q * dl * dl) * F.lit(EARTH_RADIUS_M)


def euclidean(x1: Num, y1: Num, x2: Num, y2: Num) -> Column:
    """Plain distance in degrees."""
    dx, dy = c(x2) - c(x1), c(y2) - c(y1)
    return F.sqrt(dx * dx + dy * dy)


def cartesian_3d(x1: Num, y1: Num, z1: Num, x2: Num, y2: Num, z2: Num) -> Column:
    dx, dy, dz = c(x2) - c(x1), c(y2) - c(y1), c(z2) - c(z1)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def distance(metric: str, x1: Num, y1: Num, x2: Num, y2: Num) -> Column:
    """Distance by metric name: haversine, geodesic, rhumb or euclidean (any case)."""
    from driftline.functions.geodesic import geodesic_distance

    table = {"haversine": haversine, "rhumb": rhumb, "euclidean": euclidean, "geodesic": geodesic_distance}
    try:
        fn = table[metric.lower()]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(table)}") from None
    return fn(x1, y1, x2, y2)


# --- envelopes --------------------------------------------------------------------------------------


def envelope(x: float, y: float, r: float) -> tuple[float, float, float, float]:
    """Degree box around a centre as the parity mode uses it: no wrap, longitude by the centre's latitude."""
    dlat = math.degrees(r / EARTH_RADIUS_M)
    dlon = math.degrees(r / (EARTH_RADIUS_M * math.cos(math.radians(min(abs(y), MAX_LAT_FOR_LON)))))
    return x - dlon, y - dlat, x + dlon, y + dlat


def envelope_filter(x: float, y: float, r: float, mode: str = "reference") -> Column:
    """The envelope as conjuncts that reach the Parquet scan.

    mode ``reference`` keeps the plain box; ``exact`` is a true superset of the ball: true half-width,
    split at the date line, every longitude when the ball reaches a pole.
    """
    if mode == "reference":
        x0, y0, x1, y1 = envelope(x, y, r)
        return F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    if mode != "exact":
        raise ValueError("envelope mode is 'reference' or 'exact'")
    ang = min(r / EARTH_RADIUS_M, math.pi) * (1 + 1e-12) + 1e-12
    d = math.degrees(ang)
    lat = F.col("y").between(y - d, y + d)
    if abs(y) + d >= 90 or ang >= math.pi / 2:
        return lat
    dl = math.degrees(math.asin(min(1.0, math.sin(ang) / math.cos(math.radians(y))))) + 1e-9
    lon = F.col("x").between(x - dl, x + dl)
    if x - dl < -180:
        lon |= F.col("x") >= x - dl + 360
    if x + dl > 180:
        lon |= F.col("x") <= x + dl - 360
    return lat & lon


def expand_bbox(min_x: Num, min_y: Num, max_x: Num, max_y: Num, meters: Num) -> Column:
    """Box grown by metres: latitude clamped, longitude by the larger absolute latitude, no wrap."""
    m = c(meters)
    dlat = m / METERS_PER_DEGREE
    worst = F.least(F.greatest(F.abs(c(min_y)), F.abs(c(max_y))), F.lit(MAX_LAT_FOR_LON))
    dlon = m / (F.lit(METERS_PER_DEGREE) * F.cos(F.radians(worst)))
    return F.struct(
        (c(min_x) - dlon).alias("min_x"),
        F.greatest(c(min_y) - dlat, F.lit(-90.0)).alias("min_y"),
        (c(max_x) + dlon).alias("max_x"),
        F.least(c(max_y) + dlat, F.lit(90.0)).alias("max_y"),
    )


def bbox_contains(x: Num, y: Num, min_x: Num, min_y: Num, max_x: Num, max_y: Num, *, closed: bool = True) -> Column:
    """Point in box; ``closed`` includes the edges (box queries), else they are excluded."""
    x, y = c(x), c(y)
    if closed:
        return x.between(c(min_x), c(max_x)) & y.between(c(min_y), c(max_y))
    return (x > c(min_x)) & (x < c(max_x)) & (y > c(min_y)) & (y < c(max_y))


def bbox3d_contains(x: Num, y: Num, z: Num, lo: Sequence[Num], hi: Sequence[Num]) -> Column:
    """Point in the closed 3-D box from corner ``lo`` to corner ``hi``."""
    return c(x).between(c(lo[0]), c(hi[0])) & c(y).between(c(lo[1]), c(hi[1])) & c(z).between(c(lo[2]), c(hi[2]))


def bboxes_intersect(a: Sequence[Num], b: Sequence[Num]) -> Column:
    """Closed overlap of two boxes given as (mins..., maxs...), in two or three dimensions."""
    n = len(a) // 2
    tests = [(c(a[i]) <= c(b[n + i])) & (c(a[n + i]) >= c(b[i])) for i in range(n)]
    return reduce(lambda p, q: p & q, tests)


def bbox_measures(min_x: Num, min_y: Num, max_x: Num, max_y: Num) -> Column:
    """struct(center_x, center_y, width, height) in degrees."""
    return F.struct(
        ((c(min_x) + c(max_x)) / 2).alias("center_x"),
        ((c(min_y) + c(max_y)) / 2).alias("center_y"),
        (c(max_x) - c(min_x)).alias("width"),
        (c(max_y) - c(min_y)).alias("height"),
    )


def bbox3d_measures(a: Sequence[Num], b: Sequence[Num]) -> Column:
    """Box from any two opposite corners, normalised: centre, width, height, depth and volume."""
    lo = [F.least(c(p), c(q)) for p, q in zip(a, b, strict=True)]
    hi = [F.greatest(c(p), c(q)) for p, q in zip(a, b, strict=True)]
    size = [q - p for p, q in zip(lo, hi, strict=True)]
    return F.struct(
        *[((p + q) / 2).alias(f"center_{n}") for n, p, q in zip("xyz", lo, hi, strict=True)],
        size[0].alias("width"),
        size[1].alias("height"),
        size[2].alias("depth"),
        (size[0] * size[1] * size[2]).alias("volume"),
    )


# --- polygons ---------------------------------------------------------------------------------------

Ring = Sequence[tuple[float, float]]


def close_ring(ring: Ring) -> list[tuple[float, float]]:
    """The ring with its first vertex repeated at the end (empty stays empty)."""
    pts = [(float(x), float(y)) for x, y in ring]
    return pts + pts[:1] if pts and pts[0] != pts[-1] else pts


def ring_bounds(ring: Ring) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return min(xs), min(ys), max(xs), max(ys)


def _edge_tests(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(crosses the ray to the right, the point lies on the edge)."""
    side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    upward = (y1 <= y) & (y2 > y)
    downward = (y2 <= y) & (y1 > y)
    crosses = (upward & (side > 0)) | (downward & (side < 0))
    on = (
        (side == 0)
        & (x >= F.least(x1, x2))
        & (x <= F.greatest(x1, x2))
        & (y >= F.least(y1, y2))
        & (y <= F.greatest(y1, y2))
    )
    return crosses, on


def in_polygon(x: Num, y: Num, exterior: Ring, interiors: Sequence[Ring] = ()) -> Column:
    """Strictly inside a literal polygon and not inside or on a hole.

    The edges are unrolled into one expression (code-generated), with the bounding box in front.
    """
    x, y = c(x), c(y)

    def ring_tests(ring: Ring) -> tuple[Column, Column]:
        pts = close_ring(ring)
        parity, on = F.lit(0), F.lit(False)
        for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
            if (ax, ay) == (bx, by):
                continue
            k, o = _edge_tests(x, y, c(ax), c(ay), c(bx), c(by))
            parity, on = parity + k.cast("int"), on | o
        return (parity % 2) == 1, on

    x0, y0, x1, y1 = ring_bounds(exterior)
    inside, on = ring_tests(exterior)
    res = x.between(x0, x1) & y.between(y0, y1) & inside & ~on
    for hole in interiors:
        h_in, h_on = ring_tests(hole)
        res &= ~(h_in | h_on)
    return res


def ring_edges(ring: Column) -> Column:
    """array<struct<x1,y1,x2,y2>> of a ring column, closed if it wasn't; null vertices and rings are skipped."""
    pts = F.filter(
        F.coalesce(ring, F.array().cast("array<struct<x:double,y:double>>")),
        lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]),
    )
    after = F.concat(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))
    return F.zip_with(
        pts,
        after,
        lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
    )


def ring_position(x: Num, y: Num, edges: Column) -> Column:
    """1 inside, 0 outside, -1 on the boundary, for a column of edges (see ``ring_edges``)."""
    x, y = c(x), c(y)

    def step(acc: Column, e: Column) -> Column:
        crosses, on = _edge_tests(x, y, e["x1"], e["y1"], e["x2"], e["y2"])
        return F.when((acc < 0) | on, F.lit(-1)).when(crosses, 1 - acc).otherwise(acc)

    return F.aggregate(edges, F.lit(0), step)


def ring_area(ring: Column) -> Column:
    """Spherical area of one ring in square metres (unsigned), by the Chamberlain-Duquette formula, summed over its edges in one pass."""
    edges = ring_edges(ring)
    total = F.aggregate(
        edges,
        F.lit(0.0),
        lambda a, e: a + F.radians(e["x2"] - e["x1"]) * (F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"]))),
    )
    return F.when(F.size(edges) < 3, F.lit(0.0)).otherwise(F.abs(total) * F.lit(WGS84_A * WGS84_A / 2.0))


def polygon_area(exterior: Column, interiors: Column) -> Column:
    """Area of the exterior minus the areas of the holes."""
    holes = F.aggregate(
        F.coalesce(interiors, F.array().cast("array<array<struct<x:double,y:double>>>")),
        F.lit(0.0),
        lambda a, h: a + ring_area(h),
    )
    return ring_area(exterior) - holes
