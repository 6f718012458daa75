"""Trajectories: the updates of an object within a time range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import validate
from driftline.functions.geo import usable


def trajectory(
    updates: DataFrame,
    namespace: str,
    object_id: str,
    start: float | None = None,
    end: float | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """U records with start <= ts <= end (epoch seconds), newest first: x, y, z, metadata, ts, seq.

    Deletes do not hide history; an unknown object or start > end gives no rows; equal times: later seq first;
    redelivered copies (same seq) count once.
    """
    df = updates.where((F.col("op") == "U") & (F.col("namespace") == namespace) & (F.col("object_id") == object_id))
    df = df.where(usable() & F.col("ts").isNotNull())
    if start is not None:
        df = df.where(F.col("ts") >= F.timestamp_micros(F.lit(validate.seconds(start))))
    if end is not None:
        df = df.where(F.col("ts") <= F.timestamp_micros(F.lit(validate.seconds(end))))
    df = df.select("x", "y", "z", "metadata", "ts", "seq").distinct()
    n = validate.limit(limit)
    return df if n is None else df.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n)


def uploads_to_updates(batches: DataFrame, first_seq: int = 0) -> DataFrame:
    """Uploaded trajectories (points array of x, y, ts) as update rows with z = 0 and empty metadata.

    Unusable elements are refused (left out); ``seq`` is assigned without a global sort: by partition and position.
    """
    p = batches.select("namespace", "object_id", F.explode("points").alias("p"))
    p = p.where(usable("p.x", "p.y", None) & F.coalesce(F.col("p.ts").between(0.0, 253402300799.0), F.lit(False)))
    return p.select(
        "namespace", "object_id", F.lit("U").alias("op"),
        (F.monotonically_increasing_id() + F.lit(first_seq)).alias("seq"),
        F.timestamp_micros(F.round(F.col("p.ts") * 1_000_000).cast("bigint")).alias("ts"),
        F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(0.0).alias("z"), F.lit("{}").alias("metadata"),
    )
