"""Distances and areas on the WGS-84 ellipsoid, vectorised.

The inverse problem is iterated on the auxiliary sphere; for nearly antipodal pairs, where that does not
converge, the starting azimuth is found by bisection of the longitude difference, which is monotone in it once the
points are brought into canonical position.  These are the only measures without a closed form, so they run as
Arrow-batched pandas functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.constants import WGS84_A as A
from driftline.constants import WGS84_F as FL

B = A * (1 - FL)
E2 = FL * (2 - FL)


def _series(cos2_alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u2 = cos2_alpha * (A * A - B * B) / (B * B)
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return big_a, big_b


def _length(cos2_alpha: np.ndarray, sin_s: np.ndarray, cos_s: np.ndarray, cos_2m: np.ndarray) -> np.ndarray:
    big_a, big_b = _series(cos2_alpha)
    ds = big_b * sin_s * (
        cos_2m
        + big_b / 4 * (cos_s * (-1 + 2 * cos_2m**2) - big_b / 6 * cos_2m * (-3 + 4 * sin_s**2) * (-3 + 4 * cos_2m**2))
    )
    return B * big_a * (np.arctan2(sin_s, cos_s) - ds)


def inverse(x1, y1, x2, y2) -> np.ndarray:  # noqa: ANN001
    """Geodesic metres between arrays of points in degrees; NaN where an input is NaN or null."""
    x1, y1, x2, y2 = (np.asarray(v, dtype=float) for v in (x1, y1, x2, y2))
    lon = np.radians((x2 - x1 + 180) % 360 - 180)
    u1, u2 = np.arctan((1 - FL) * np.tan(np.radians(y1))), np.arctan((1 - FL) * np.tan(np.radians(y2)))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = lon.copy()
    done = np.zeros(lon.shape, dtype=bool)
    with np.errstate(all="ignore"):
        for _ in range(60):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cos_s = su1 * su2 + cu1 * cu2 * cl
            sin_a = np.where(sin_s > 0, cu1 * cu2 * sl / sin_s, 0.0)
            c2a = 1 - sin_a**2
            c2m = np.where(c2a > 1e-15, cos_s - 2 * su1 * su2 / c2a, 0.0)
            c = FL / 16 * c2a * (4 + FL * (4 - 3 * c2a))
            s = np.arctan2(sin_s, cos_s)
            new = lon + (1 - c) * FL * sin_a * (s + c * sin_s * (c2m + c * cos_s * (-1 + 2 * c2m**2)))
            done = (np.abs(new - lam) < 1e-13) & (np.abs(new) <= np.pi)
            lam = new
            if done.all():
                break
        out = _length(c2a, sin_s, cos_s, c2m)
        out = np.where((x1 == x2) & (y1 == y2), 0.0, out)
    hard = ~done & ~np.isnan(lon + u1 + u2)
    if hard.any():
        out = np.array(out, copy=True)
        out[hard] = _antipodal(np.abs(lon[hard]), u1[hard], u2[hard])
    return out


def _antipodal(lon: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """Bisection on the azimuth at the first point, the points brought to u1 <= 0 and |u2| <= |u1|."""
    swap = np.abs(u1) < np.abs(u2)
    a, b = np.where(swap, u2, u1), np.where(swap, u1, u2)
    flip = np.where(a > 0, -1.0, 1.0)
    a, b = a * flip, b * flip
    sa, ca, sb, cb = np.sin(a), np.cos(a), np.sin(b), np.cos(b)
    sa = np.where(sa == 0, -1e-300, sa)  # the equator counts as south of itself

    def at(alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sal, cal = np.sin(alpha), np.cos(alpha)
        s0 = sal * ca
        c0 = np.hypot(cal, sal * sa)
        s1, w1 = np.arctan2(sa, cal * ca), np.arctan2(s0 * sa, cal * ca)
        c2 = np.sqrt(np.maximum(0.0, (cal * ca) ** 2 + (cb**2 - ca**2)))
        s2, w2 = np.arctan2(sb, c2), np.arctan2(s0 * sb, c2)
        s = s2 - s1
        c2a = c0**2
        c2m = np.where(c2a > 1e-15, np.cos(s) - 2 * (sa * sb) / np.maximum(c2a, 1e-15), 0.0)
        c = FL / 16 * c2a * (4 + FL * (4 - 3 * c2a))
        lam = w2 - w1 - (1 - c) * FL * s0 * (s + c * np.sin(s) * (c2m + c * np.cos(s) * (-1 + 2 * c2m**2)))
        big_a, big_b = _series(c2a)
        ds = big_b * np.sin(s) * (
            c2m
            + big_b
            / 4
            * (np.cos(s) * (-1 + 2 * c2m**2) - big_b / 6 * c2m * (-3 + 4 * np.sin(s) ** 2) * (-3 + 4 * c2m**2))
        )
        return lam, B * big_a * (s - ds)

    lo, hi = np.full_like(lon, 1e-16), np.full_like(lon, np.pi)
    for _ in range(70):
        mid = (lo + hi) / 2
        lam, _ = at(mid)
        low = lam < lon
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return at((lo + hi) / 2)[1]


@F.pandas_udf(T.DoubleType())
def _inverse_udf(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    return pd.Series(inverse(x1, y1, x2, y2))


def geodesic_distance(x1, y1, x2, y2) -> Column:  # noqa: ANN001
    """Geodesic metres as a column (null where an input is null)."""
    from driftline.functions.geo import c

    return F.nanvl(_inverse_udf(c(x1), c(y1), c(x2), c(y2)), F.lit(None).cast("double"))


def _q(lat: np.ndarray) -> np.ndarray:
    """Area between the equator and a latitude, per radian of longitude, on an ellipsoid with semi-axis 1, times 2."""
    s, e = np.sin(lat), np.sqrt(E2)
    return (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))


def ring_area(xs: np.ndarray, ys: np.ndarray, steps: int = 32) -> float:
    """Unsigned area of a ring of geodesic edges; each edge is followed along its great ellipse by Simpson's rule."""
    n = len(xs)
    if n < 3:
        return 0.0
    total = 0.0
    for i in range(n):
        x1, y1, x2, y2 = xs[i], ys[i], xs[(i + 1) % n], ys[(i + 1) % n]
        d = np.radians((x2 - x1 + 180) % 360 - 180)
        if d == 0:
            continue
        b1, b2 = np.arctan((1 - FL) * np.tan(np.radians([y1, y2])))
        p = np.array([np.cos(b1), 0.0, np.sin(b1)])
        r = np.array([np.cos(b2) * np.cos(d), np.cos(b2) * np.sin(d), np.sin(b2)])
        t = np.linspace(0, d, steps + 1)
        m = np.cross(p, r)
        if abs(m[2]) < 1e-15:  # along a meridian: all change of longitude happens at the pole
            total += float(_q(np.radians(np.copysign(90.0, y1 + y2)))) * d
            continue
        # latitude at longitude t on the great circle of the auxiliary sphere through both ends
        tb = -(m[0] * np.cos(t) + m[1] * np.sin(t)) / m[2]
        q = _q(np.arctan(tb / (1 - FL)))
        w = np.ones(steps + 1)
        w[1:-1:2], w[2:-1:2] = 4, 2
        total += float((w * q).sum()) * d / steps / 3
    return abs(total) * A * A / 2


def polygon_area(exterior, interiors=()) -> float:  # noqa: ANN001
    """Area of a polygon of (x, y) vertices less its holes."""
    one = lambda ring: ring_area(*[np.array(v, dtype=float) for v in zip(*ring, strict=True)]) if len(ring) else 0.0
    return one(exterior) - sum(one(h) for h in interiors)


@F.pandas_udf(T.DoubleType())
def geodesic_polygon_area(exterior: pd.Series, interiors: pd.Series) -> pd.Series:
    """Column function over rings of struct<x, y>; null exterior gives null."""

    def ring(r) -> list:  # noqa: ANN001
        return [(p["x"], p["y"]) for p in r if p is not None]

    return pd.Series(
        [
            None if e is None else polygon_area(ring(e), [ring(h) for h in (i if i is not None else ())])
            for e, i in zip(exterior, interiors, strict=True)
        ],
        dtype=float,
    )
