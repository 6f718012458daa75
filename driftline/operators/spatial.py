"""Range, nearest-neighbour and region queries around literals.

Every operator takes ``current`` (one row per object: namespace, object_id, x, y, z, metadata, ts) and returns a
lazy DataFrame.  The cheap conjuncts (namespace, envelope) reach the Parquet scan; bounded results become
``TakeOrderedAndProject``, so no operator sorts everything.  Ties are broken by object_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import validate
from driftline.functions.geo import (
    bbox3d_contains,
    bbox_contains,
    bboxes_intersect,
    distance,
    envelope_filter,
    haversine,
    haversine_3d,
    in_polygon,
)

LOCATION = ["object_id", "x", "y", "z", "metadata"]


def of_namespace(current: DataFrame, namespace: str) -> DataFrame:
    return current.where(F.col("namespace") == namespace)


def _finite(d: Column) -> Column:
    return ~F.isnan(d) & (F.abs(d) < float("inf"))


def _top(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first ``limit`` rows in order; all rows, unordered, without a limit."""
    n = validate.limit(limit)
    return df if n is None else df.orderBy(*order, "object_id").limit(n)


def _ball(
    current: DataFrame, namespace: str, center: Sequence[float], radius: float, *, envelope: str, flat: bool
) -> DataFrame:
    x, y = center[0], center[1]
    d = haversine("x", "y", x, y) if flat else haversine_3d("x", "y", "z", x, y, center[2])
    df = of_namespace(current, namespace).where(envelope_filter(x, y, radius, envelope))
    if not flat:
        df = df.where(F.col("z").between(center[2] - radius, center[2] + radius))
    return df.withColumn("distance", d).where(_finite(F.col("distance")) & (F.col("distance") <= radius))


def radius_3d(
    current: DataFrame,
    namespace: str,
    center: Sequence[float],
    radius: float,
    limit: int | None = 100,
    *,
    envelope: str = "reference",
) -> DataFrame:
    """Objects within ``radius`` metres of (x, y, z), nearest first; an object at the centre is included."""
    validate.point_3d(*center)
    validate.radius(radius)
    return _top(_ball(current, namespace, center, radius, envelope=envelope, flat=False), limit, "distance").select(
        *LOCATION, "distance"
    )


def radius_2d(
    current: DataFrame,
    namespace: str,
    center: Sequence[float],
    radius: float,
    limit: int | None = 100,
    *,
    envelope: str = "reference",
) -> DataFrame:
    """As ``radius_3d`` without regard to altitude."""
    validate.point(*center[:2])
    validate.radius(radius)
    return _top(_ball(current, namespace, center, radius, envelope=envelope, flat=True), limit, "distance").select(
        *LOCATION, "distance"
    )


def radius_count(
    current: DataFrame, namespace: str, center: Sequence[float], radius: float, *, envelope: str = "reference"
) -> DataFrame:
    """One row: ``n``."""
    validate.point(*center[:2])
    validate.radius(radius)
    return _ball(current, namespace, center, radius, envelope=envelope, flat=True).agg(F.count("*").alias("n"))


def radius_exists(
    current: DataFrame, namespace: str, center: Sequence[float], radius: float, *, envelope: str = "reference"
) -> DataFrame:
    """One row: ``found``; stops at the first hit."""
    validate.point(*center[:2])
    validate.radius(radius)
    hit = _ball(current, namespace, center, radius, envelope=envelope, flat=True).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def cylinder(
    current: DataFrame,
    namespace: str,
    center: Sequence[float],
    min_z: float,
    max_z: float,
    radius: float,
    limit: int | None = 100,
    *,
    envelope: str = "reference",
) -> DataFrame:
    """Within ``radius`` horizontally and min_z <= z <= max_z (absolute, not validated); nearest first, horizontally."""
    validate.point(*center[:2])
    validate.radius(radius)
    df = _ball(current, namespace, center, radius, envelope=envelope, flat=True)
    df = df.where(F.col("z").between(float(min_z), float(max_z)))
    return _top(df, limit, "distance").select(*LOCATION, "distance")


def in_altitude_range(
    current: DataFrame, namespace: str, center: Sequence[float], min_z: float, max_z: float, tolerance: float
) -> DataFrame:
    """One row: ``found`` is whether any object is in the cylinder of radius ``tolerance``."""
    return cylinder(current, namespace, center, min_z, max_z, tolerance, 1).agg((F.count("*") > 0).alias("found"))


# --- nearest neighbours -----------------------------------------------------------------------------


def knn(
    current: DataFrame,
    namespace: str,
    center: Sequence[float],
    k: int,
    *,
    metric: str = "index",
    flat: bool = False,
    max_distance: float | None = None,
) -> DataFrame:
    """The ``k`` nearest objects: location, ``distance`` (metres) and ``rank_value``, in order of rank_value.

    ``metric='index'`` ranks by the plain distance over (degrees, degrees, metres), so the returned distances needn't
    ascend; ``'haversine3d'`` ranks by the distance itself.  ``flat``: the centre's altitude counts as 0 in the
    ranking and the distance is horizontal.  ``max_distance`` filters before the k are taken; without it, rows with a
    non-finite distance are dropped after.
    """
    x, y = center[0], center[1]
    z = 0.0 if flat else center[2]
    validate.point(x, y) if flat else validate.point_3d(x, y, z)
    d = haversine("x", "y", x, y) if flat else haversine_3d("x", "y", "z", x, y, z)
    df = of_namespace(current, namespace).withColumn("distance", d)
    if metric == "index":
        dx, dy, dz = F.col("x") - F.lit(float(x)), F.col("y") - F.lit(float(y)), F.col("z") - F.lit(float(z))
        df = df.withColumn("rank_value", dx * dx + dy * dy + dz * dz)
    elif metric == "haversine3d":
        df = df.withColumn("rank_value", F.col("distance"))
    else:
        raise ValueError("metric is 'index' or 'haversine3d'")
    if max_distance is not None:
        df = df.where(F.col("distance") <= float(max_distance))
    top = _top(df, k, "rank_value")
    return top.where(_finite(F.col("distance"))).select(*LOCATION, "distance", "rank_value")


def knn_metric(points: DataFrame, center: Sequence[float], k: int, metric: str = "haversine") -> DataFrame:
    """The k nearest of any points (object_id, x, y) by one of the four metrics, ascending."""
    d = distance(metric, "x", "y", center[0], center[1])
    return _top(points.withColumn("distance", d).where(_finite(F.col("distance"))), k, "distance")


# --- boxes, polygons, zones -------------------------------------------------------------------------


def bbox(
    current: DataFrame, namespace: str, min_x: float, min_y: float, max_x: float, max_y: float, limit: int | None = 100
) -> DataFrame:
    """Objects in the box, edges included, any altitude; in order of object_id."""
    validate.bbox(min_x, min_y, max_x, max_y)
    hit = of_namespace(current, namespace).where(bbox_contains("x", "y", min_x, min_y, max_x, max_y))
    return _top(hit, limit).select(*LOCATION)


def bbox_3d(
    current: DataFrame, namespace: str, lo: Sequence[float], hi: Sequence[float], limit: int | None = 100
) -> DataFrame:
    validate.bbox_3d(*lo, *hi)
    hit = of_namespace(current, namespace).where(bbox3d_contains("x", "y", "z", lo, hi))
    return _top(hit, limit).select(*LOCATION)


def polygon(
    current: DataFrame,
    namespace: str,
    exterior: Sequence[tuple[float, float]],
    interiors: Sequence[Sequence[tuple[float, float]]] = (),
    limit: int | None = 100,
) -> DataFrame:
    """Objects strictly inside the polygon and not inside or on its holes."""
    validate.polygon(exterior, interiors)
    return _top(of_namespace(current, namespace).where(in_polygon("x", "y", exterior, interiors)), limit).select(
        *LOCATION
    )


def zones_intersecting(
    zones: DataFrame, namespace: str, min_x: float, min_y: float, max_x: float, max_y: float
) -> DataFrame:
    """Zones whose box touches the query box."""
    edges = ["min_x", "min_y", "max_x", "max_y"]
    hit = bboxes_intersect(edges, (min_x, min_y, max_x, max_y))
    return of_namespace(zones, namespace).where(hit).select("key", *edges, "data")


# --- relative to an object --------------------------------------------------------------------------


def position_of(current: DataFrame, namespace: str, object_id: str) -> tuple[float, float, float]:
    """Current position of one object (a one-row lookup)."""
    from driftline.errors import ObjectNotFoundError

    row = of_namespace(current, namespace).where(F.col("object_id") == object_id).select("x", "y", "z").first()
    if row is None:
        raise ObjectNotFoundError(f"{namespace}/{object_id}")
    return row.x, row.y, row.z


def near_object(current: DataFrame, namespace: str, object_id: str, radius: float, limit: int | None = 100) -> DataFrame:
    """``radius_3d`` around an object's current position; the object itself is included."""
    return radius_3d(current, namespace, position_of(current, namespace, object_id), radius, limit)


def cylinder_near_object(
    current: DataFrame, namespace: str, object_id: str, min_z: float, max_z: float, radius: float, limit: int | None = 100
) -> DataFrame:
    x, y, _ = position_of(current, namespace, object_id)
    return cylinder(current, namespace, (x, y), min_z, max_z, radius, limit)


def bbox_near_object(
    current: DataFrame, namespace: str, object_id: str, width: float, height: float, limit: int | None = 100
) -> DataFrame:
    """Box of ``width`` x ``height`` degrees around the object; refused when it leaves the globe's coordinates."""
    x, y, _ = position_of(current, namespace, object_id)
    return bbox(current, namespace, x - width / 2, y - height / 2, x + width / 2, y + height / 2, limit)


def bbox_3d_near_object(
    current: DataFrame, namespace: str, object_id: str, width: float, height: float, depth: float, limit: int | None = 100
) -> DataFrame:
    x, y, z = position_of(current, namespace, object_id)
    lo = (x - width / 2, y - height / 2, z - depth / 2)
    return bbox_3d(current, namespace, lo, (x + width / 2, y + height / 2, z + depth / 2), limit)


def knn_near_object(current: DataFrame, namespace: str, object_id: str, k: int) -> DataFrame:
    return knn(current, namespace, position_of(current, namespace, object_id), k)


# --- distances between objects ----------------------------------------------------------------------


def distance_between(current: DataFrame, namespace: str, a: str, b: str, metric: str = "haversine") -> DataFrame:
    """One row ``distance`` (horizontal), or none if either object is missing."""
    df = of_namespace(current, namespace)
    one = df.where(F.col("object_id") == a).select(F.col("x").alias("x1"), F.col("y").alias("y1"))
    two = df.where(F.col("object_id") == b).select(F.col("x").alias("x2"), F.col("y").alias("y2"))
    # one row each: an object has one current position
    return one.limit(1).crossJoin(two.limit(1)).select(distance(metric, "x1", "y1", "x2", "y2").alias("distance"))


def distance_to(
    current: DataFrame, namespace: str, object_id: str, x: float, y: float, metric: str = "haversine"
) -> DataFrame:
    df = of_namespace(current, namespace).where(F.col("object_id") == object_id)
    return df.select(distance(metric, "x", "y", x, y).alias("distance"))
