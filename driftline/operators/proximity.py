"""Points near other points, and the regions that contain them.

Near pairs: every point has one home cell and visits the cells its ball meets; home rows and visiting rows
are joined on (namespace, cell) and the exact distance decides.  Cells are sized by the radius.  Crowded
cells are split: their home rows are spread over sub-cells and only the visitors of those cells are copied,
so one cell never becomes one task.

Regions: boxes and the bounding boxes of polygons are hashed to nested plane cells; the join is an
equi-join on (namespace, level, cell), crowded cells split as well, and the exact test decides.  All work stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import bbox_contains, haversine_3d, ring_edges, ring_position, usable
from driftline.operators.grid import CROWD, SphereGrid, plane_boxes, plane_points, split_join
from driftline.session import cut

KEY = ["namespace", "object_id"]
#: Edges of regions, over all their cells, up to which the regions are broadcast (about 32 MB).
MAX_BROADCAST_EDGES = 1_000_000


def current_locations(points: DataFrame) -> DataFrame:
    """The usable row with the greatest ``ts`` of each object.

    Defined cases: a null ``ts`` is older than any; equal ``ts`` with different positions: the greatest
    (x, y, z, metadata) in that order; rows with null namespace or object_id and objects without a usable
    row have no location; further columns are ignored.
    """
    best = F.max(F.struct("ts", "x", "y", "z", "metadata")).alias("best")
    return (
        points.where(usable() & F.col("namespace").isNotNull() & F.col("object_id").isNotNull())
        .groupBy(*KEY)
        .agg(best)
        .select(*KEY, "best.x", "best.y", "best.z", "best.metadata", "best.ts")
    )


def near_pairs(points: DataFrame, radius: float, *, crowd: int = CROWD) -> DataFrame:
    """Pairs of one namespace with sqrt(great-circle^2 + dz^2) <= radius: namespace, key_a < key_b, distance.

    ``points`` has one usable row per (namespace, object_id) with x, y, z.  The result is complete
    everywhere on the globe, date line and poles included.  ``crowd``: home rows of one cell handled
    together; fuller cells are split (all pairs are still found).
    """
    grid = SphereGrid(radius)
    pts = points.select(*KEY, "x", "y", "z")
    home = grid.home(pts)
    cell = ["namespace", "g_row", "g_col"]
    a = home.select(*cell, F.col("object_id").alias("key_a"), *[F.col(k).alias(f"a_{k}") for k in "xyz"])
    b = grid.reach(pts).select(*cell, F.col("object_id").alias("key_b"), *[F.col(k).alias(f"b_{k}") for k in "xyz"])
    return (
        split_join(a, b, cell, "key_a", crowd)
        .where(F.col("key_a") < F.col("key_b"))
        .where((F.abs(F.col("a_y") - F.col("b_y")) <= grid.dlat) & (F.abs(F.col("a_z") - F.col("b_z")) <= radius))
        .withColumn("distance", haversine_3d("a_x", "a_y", "a_z", "b_x", "b_y", "b_z"))
        .where(F.col("distance") <= radius)
        .select("namespace", "key_a", "key_b", "distance")
    )


def _levels(boxes: DataFrame) -> list[int]:
    """The levels that occur: at most 25 small integers."""
    return [r[0] for r in boxes.select("g_level").distinct().collect()]


def _in_cells(points: DataFrame, cells: DataFrame, size: Column, most: int, crowd: int) -> DataFrame:
    """Points with the regions of their cells, on every level.

    Regions with no more than ``most`` edges in all (``size`` per row) are broadcast, so that no point is moved; more
    are joined by cell, with crowded cells split.
    """
    cells = cut(cells)
    p = plane_points(points.select(*KEY, "x", "y"), _levels(cells))
    cell = ["namespace", "g_level", "g_x", "g_y"]
    edges = cells.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if edges <= most:
        return p.join(F.broadcast(cells), cell)
    return split_join(p, cells, cell, "object_id", crowd)


def points_in_boxes(points: DataFrame, zones: DataFrame, *, most: int = MAX_BROADCAST_EDGES, crowd: int = CROWD) -> DataFrame:
    """namespace, object_id, key of each box of the same namespace that contains the point, edges included.

    Repeated boxes count once; inverted boxes and boxes with null or non-finite edges contain nothing;
    boxes with null key or namespace are left out; ``data`` is not looked at.
    """
    edges = ["min_x", "min_y", "max_x", "max_y"]
    z = zones.where(F.col("key").isNotNull()).select("namespace", "key", *edges).distinct()
    return (
        _in_cells(points, plane_boxes(z, *edges), F.lit(4), most, crowd)
        .where(bbox_contains("x", "y", *edges))
        .select(*KEY, "key")
        .distinct()
    )


def points_in_polygons(points: DataFrame, polygons: DataFrame, *, most: int = MAX_BROADCAST_EDGES, crowd: int = CROWD) -> DataFrame:
    """namespace, object_id, fence_id of each polygon of the namespace with the point strictly inside.

    Outside are: points on the exterior's boundary and points inside or on a hole.  Rings may be open or
    closed, in either direction, with repeated vertices; null vertices are skipped, null or empty
    ``interiors`` mean no hole, exteriors of less than three vertices contain nothing, repeated rows count once.
    """
    ring = ring_edges(F.col("exterior"))
    f = (
        polygons.where(F.col("fence_id").isNotNull())
        .select("namespace", "fence_id", ring.alias("outer"), "interiors")
        .where(F.size("outer") >= 3)
        .select(
            "namespace",
            "fence_id",
            "outer",
            F.transform(
                F.coalesce("interiors", F.array().cast("array<array<struct<x:double,y:double>>>")), ring_edges
            ).alias("holes"),
            *[
                fn(F.col("outer").getField(k)).alias(to)
                for fn, k, to in (
                    (F.array_min, "x1", "min_x"),
                    (F.array_min, "y1", "min_y"),
                    (F.array_max, "x1", "max_x"),
                    (F.array_max, "y1", "max_y"),
                )
            ],
        )
    )
    edges = ["min_x", "min_y", "max_x", "max_y"]
    size = F.size("outer") + F.aggregate("holes", F.lit(0), lambda a, h: a + F.size(h))
    return (
        _in_cells(points, plane_boxes(f, *edges), size, most, crowd)
        .where(bbox_contains("x", "y", *edges, closed=False))
        .where(ring_position("x", "y", F.col("outer")) == 1)
        .where(~F.exists("holes", lambda h: ring_position("x", "y", h) != 0))
        .select(*KEY, "fence_id")
        .distinct()
    )


def relations(points: DataFrame, zones: DataFrame, fences: DataFrame, radius: float = 50.0) -> DataFrame:
    """Near pairs, boxes and fences of all current locations: rel, namespace, key_a, key_b."""
    here = cut(current_locations(points).select(*KEY, "x", "y", "z"))  # used five times
    near = near_pairs(here, radius).select(F.lit("near").alias("rel"), "namespace", "key_a", "key_b")
    zone = points_in_boxes(here, zones).select(
        F.lit("zone").alias("rel"), "namespace", F.col("object_id").alias("key_a"), F.col("key").alias("key_b")
    )
    fence = points_in_polygons(here, fences).select(
        F.lit("fence").alias("rel"), "namespace", F.col("object_id").alias("key_a"), F.col("fence_id").alias("key_b")
    )
    return near.unionByName(zone).unionByName(fence)
