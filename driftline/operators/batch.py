"""Batch forms: many probes answered by one join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geo import haversine_3d
from driftline.operators.grid import SphereGrid, split_join
from driftline.session import cut

KEY = ["namespace", "object_id"]


def radius_join(
    current: DataFrame, probes: DataFrame, radius: float, limit: int | None = None
) -> DataFrame:
    """Objects within ``radius`` metres (3-D) of each probe of the same namespace.

    ``probes``: probe_id, namespace, x, y, z.  Result: probe_id, namespace, object_id, distance, at most ``limit`` per
    probe (nearest first, ties by object_id).  Probes visit the cells their ball meets, objects stay at home.
    """
    grid = SphereGrid(radius)
    a = grid.home(current.select(*KEY, "x", "y", "z"))
    b = grid.reach(probes.select("probe_id", "namespace", *[F.col(k).alias(f"p_{k}") for k in "xyz"]), "p_x", "p_y")
    hit = split_join(a, b, ["namespace", "g_row", "g_col"], "object_id").where(F.abs(F.col("y") - F.col("p_y")) <= grid.dlat).withColumn(
        "distance", haversine_3d("x", "y", "z", "p_x", "p_y", "p_z")
    )
    hit = hit.where(F.col("distance") <= radius).select("probe_id", *KEY, "distance")
    if limit is None:
        return hit
    w = Window.partitionBy("probe_id").orderBy("distance", "object_id")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")


def knn_join(
    current: DataFrame,
    probes: DataFrame,
    k: int,
    *,
    exclude: str | None = None,
    start_radius: float = 2_000.0,
    growth: float = 4.0,
) -> DataFrame:
    """The ``k`` nearest objects of its namespace for each probe: probe_id, namespace, neighbor_id, distance, rank.

    ``probes``: probe_id, namespace, x, y, z; ``exclude`` names a column of object_ids that are no neighbour of their
    probe.  Rings of growing radius: a probe is settled once ``k`` neighbours lie within the ring's radius, so only
    unsettled probes go on to the next, larger ring; the last ring spans the globe.  Distances are 3-D great-circle
    metres, ties by neighbour id; a namespace with fewer objects gives fewer rows; probes in unknown namespaces none.
    """
    pts = cut(current.select("namespace", F.col("object_id").alias("neighbor_id"), "x", "y", "z"))
    own = F.col(exclude) if exclude else F.lit(None).cast("string")
    sizes = pts.groupBy("namespace").agg((F.count("*") - (1 if exclude else 0)).alias("others"))
    cols = ["probe_id", "namespace", "p_x", "p_y", "p_z", "own_id", "others"]
    todo = probes.select("probe_id", "namespace", *[F.col(c).alias(f"p_{c}") for c in "xyz"], own.alias("own_id"))
    todo = todo.join(sizes, "namespace").where(F.col("others") > 0).select(*cols)
    out, radius, left = None, float(start_radius), todo.count()
    by = Window.partitionBy("probe_id")
    w = by.orderBy("distance", "neighbor_id")
    d = haversine_3d("p_x", "p_y", "p_z", "x", "y", "z")
    while left:
        last = radius > 2.1e7
        if last:
            pair = todo.join(pts, "namespace")
        else:
            grid = SphereGrid(radius)
            pair = split_join(grid.home(pts), grid.reach(todo, "p_x", "p_y"), ["namespace", "g_row", "g_col"], "neighbor_id")
            pair = pair.where(F.abs(F.col("y") - F.col("p_y")) <= grid.dlat)
        near = pair.where(F.col("own_id").isNull() | (F.col("neighbor_id") != F.col("own_id"))).withColumn("distance", d)
        if not last:
            near = near.where(F.col("distance") <= radius)
        top = near.select("probe_id", "namespace", "neighbor_id", "distance", "others").withColumn("rank", F.row_number().over(w))
        top = top.where(F.col("rank") <= k)
        full = F.max("rank").over(by) >= F.least(F.lit(k), F.col("others"))
        top = cut(top.withColumn("full", F.lit(last) | full))
        settled = top.where("full").select("probe_id", "namespace", "neighbor_id", "distance", "rank")
        out = settled if out is None else out.unionByName(settled)
        found = settled.where(F.col("rank") == 1).select("probe_id")
        left = 0 if last else left - found.count()
        if left:
            todo = cut(todo.join(found, "probe_id", "left_anti"))
            radius *= growth
    none = pts.select(*[F.lit(None).cast(t).alias(c) for c, t in _knn_types(probes)]).limit(0)
    return none if out is None else out


def _knn_types(probes: DataFrame) -> list[tuple[str, str]]:
    kind = probes.schema["probe_id"].dataType.simpleString()
    return [("probe_id", kind), ("namespace", "string"), ("neighbor_id", "string"), ("distance", "double"), ("rank", "int")]


def all_knn(current: DataFrame, k: int, **options: float) -> DataFrame:
    """The ``k`` nearest other objects for every object: namespace, object_id, neighbor_id, distance, rank."""
    probes = current.select(F.struct(*KEY).alias("probe_id"), *KEY, "x", "y", "z")
    got = knn_join(current, probes, k, exclude="object_id", **options)
    return got.select("namespace", "probe_id.object_id", "neighbor_id", "distance", "rank")


def lookup(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Current rows of many objects at once: ``keys`` has namespace and object_id; unknown ones have no row."""
    return current.join(keys.select(*KEY).distinct(), KEY, "left_semi")
