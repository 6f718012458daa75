"""SQL functions: temporary functions that Catalyst inlines, so they stay in code generation."""

from __future__ import annotations

from pyspark.sql import SparkSession

from driftline.constants import EARTH_RADIUS_M

R2 = 2 * EARTH_RADIUS_M

FUNCTIONS = {
    "haversine_m": (
        "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE",
        f"CAST({R2!r}D AS DOUBLE) * asin(sqrt(least(1D, pow(sin(radians(y2 - y1) / 2), 2)"
        " + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))",
    ),
    "euclidean_deg": (
        "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE",
        "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))",
    ),
    "usable_position": (
        "x DOUBLE, y DOUBLE, z DOUBLE",
        "coalesce(x BETWEEN -180D AND 180D AND y BETWEEN -90D AND 90D AND z BETWEEN -11000D AND 100000D, false)",
    ),
    "in_box": (
        "x DOUBLE, y DOUBLE, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE",
        "x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and gives their names."""
    for name, (args, body) in FUNCTIONS.items():
        kind = "BOOLEAN" if name in ("usable_position", "in_box") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
