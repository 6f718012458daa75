"""Small frames for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

LOG = "namespace string, object_id string, op string, seq bigint, us bigint, x double, y double, z double, metadata string"
LOC = "namespace string, object_id string, x double, y double, z double, metadata string, us bigint"


def log_frame(spark, rows):
    """(namespace, object_id, op, seq, us, x, y, z[, metadata]) rows as an update feed with columns that may clash."""
    full = [(*r, None) if len(r) == 8 else r for r in rows]
    df = spark.createDataFrame(full, LOG).withColumn("ts", F.timestamp_micros("us")).drop("us")
    return df.withColumns({"count": F.lit(1), "shard": F.lit("s"), "batch": F.lit("b"), "own": F.lit("o")})


def loc_frame(spark, rows):
    """(namespace, object_id, x, y, z[, us]) rows as locations."""
    full = [(*r[:5], "{}", r[5] if len(r) > 5 else 0) for r in rows]
    df = spark.createDataFrame(full, LOC).withColumn("ts", F.timestamp_micros("us")).drop("us")
    return df.withColumns({"g_row": F.lit("a"), "distance": F.lit("b"), "key": F.lit("c"), "count": F.lit(0)})


def tuples(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]
