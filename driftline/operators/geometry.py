"""Geometry aggregates: convex hulls and extents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monotone_chain(xs: np.ndarray, ys: np.ndarray) -> list[tuple[float, float]]:
    """Vertices of the convex hull, counter-clockwise, collinear points left out."""
    pts = sorted(set(zip(xs.tolist(), ys.tolist(), strict=True)))
    if len(pts) < 3:
        return pts

    def half(seq: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
        h: list[tuple[float, float]] = []
        for p in seq:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) <= (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]):
                h.pop()
            h.append(p)
        return h[:-1]

    return half(pts) + half(pts[::-1])


def convex_hull(points: DataFrame, by: Sequence[str] = ("namespace",)) -> DataFrame:
    """Hull of each group as a closed ring: ``by``, ``ring`` (array of struct<x, y>).

    Two phases: each partition first reduces its rows to partial hulls per group, so only hull vertices are shuffled;
    the hull of the partial hulls is the hull.  One or two distinct points give a degenerate closed ring; groups
    without a point have no row.
    """
    by = list(by)
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[tuple[float, float]]] = {}
        for pdf in batches:
            for k, g in pdf.groupby(by, dropna=False, sort=False):
                old = held.get(k, [])
                xs = np.concatenate([g["x"].to_numpy(), [p[0] for p in old]])
                ys = np.concatenate([g["y"].to_numpy(), [p[1] for p in old]])
                held[k] = monotone_chain(xs, ys)
        rows = [(*k, *p) for k, hull in held.items() for p in hull]
        yield pd.DataFrame(rows, columns=[*by, "x", "y"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = monotone_chain(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        ring = [{"x": x, "y": y} for x, y in [*hull, hull[0]]]
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in by], ring]], columns=[*by, "ring"])

    small = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*by, "x", "y")
    hulls = small.mapInPandas(partial, f"{kinds}, x double, y double")
    return hulls.groupBy(*by).applyInPandas(final, f"{kinds}, ring array<struct<x:double,y:double>>")


def extent(points: DataFrame, by: Sequence[str] = ("namespace",)) -> DataFrame:
    """min_x, min_y, max_x, max_y of each group; groups without a point have no row."""
    return points.groupBy(*by).agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y")
    )
