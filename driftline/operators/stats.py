"""Counters of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.constants import BUFFERED_ROW_BYTES, HOT_ROW_BYTES


def stats(applied: DataFrame, current: DataFrame, buffer_capacity: int = 100) -> DataFrame:
    """One row: expired, operations (upserts), objects, trajectories, hot_bytes, cold_bytes, total_bytes."""
    per = applied.where(F.col("op") == "U").groupBy("namespace", "object_id").agg(F.count("*").alias("n"))
    cold = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("operations"),
        F.count("*").alias("trajectories"),
        F.coalesce(F.sum(F.least(F.col("n"), F.lit(buffer_capacity))), F.lit(0)).cast("bigint").alias("rows"),
    )
    hot = current.agg(F.count("*").alias("objects"))
    hot_bytes, cold_bytes = F.col("objects") * HOT_ROW_BYTES, F.col("rows") * BUFFERED_ROW_BYTES
    return cold.crossJoin(hot).select(  # one row each
        F.lit(0).cast("bigint").alias("expired"),
        "operations",
        "objects",
        "trajectories",
        hot_bytes.alias("hot_bytes"),
        cold_bytes.alias("cold_bytes"),
        (hot_bytes + cold_bytes).alias("total_bytes"),
    )
