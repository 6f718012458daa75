"""Points and zones as an index that is a table: inserts are unions, removals anti-joins, statistics aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = ["namespace", "object_id", "x", "y", "z"]
ZONE = ["namespace", "key", "min_x", "min_y", "max_x", "max_y", "data"]


def insert_points(points: DataFrame, more: DataFrame) -> DataFrame:
    """Adds rows (without ``z`` they get 0); a key may occur more than once, as two entries."""
    more = more if "z" in more.columns else more.withColumn("z", F.lit(0.0))
    return points.select(*POINT).unionByName(more.select(*POINT))


def insert_zones(zones: DataFrame, more: DataFrame) -> DataFrame:
    """Adds boxes with a key and opaque bytes; corners may come in any order."""
    low, high = F.least, F.greatest
    norm = more.withColumns(
        {
            "min_x": low("min_x", "max_x"), "max_x": high("min_x", "max_x"),
            "min_y": low("min_y", "max_y"), "max_y": high("min_y", "max_y"),
        }
    )
    return zones.select(*ZONE).unionByName(norm.select(*ZONE))


def remove(entries: DataFrame, keys: DataFrame, on: str = "object_id") -> DataFrame:
    """Entries without those whose (namespace, key) is in ``keys``; also for zones (``on='key'``)."""
    return entries.join(keys.select("namespace", on).distinct(), ["namespace", on], "left_anti")


def namespace_points(points: DataFrame, namespace: str) -> DataFrame:
    return points.where(F.col("namespace") == namespace).select("x", "y")


def index_stats(points: DataFrame) -> DataFrame:
    """One row: namespaces, points."""
    return points.agg(F.countDistinct("namespace").alias("namespaces"), F.count("*").alias("points"))


def clear(entries: DataFrame, namespace: str | None = None) -> DataFrame:
    """Nothing, or everything but one namespace."""
    return entries.limit(0) if namespace is None else entries.where(F.col("namespace") != namespace)
