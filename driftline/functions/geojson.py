"""GeoJSON text from and to columns and plain values."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.errors import InvalidInputError
from driftline.functions.geo import Num, c, close_ring

POINT_SCHEMA = "type string, coordinates array<double>"
POLYGON_SCHEMA = "type string, coordinates array<array<array<double>>>"


# --- columns ----------------------------------------------------------------------------------------


def point(x: Num, y: Num, z: Num | None = None) -> Column:
    return F.to_json(_geometry(x, y, z))


def _geometry(x: Num, y: Num, z: Num | None = None) -> Column:
    at = [c(x), c(y)] + ([] if z is None else [c(z)])
    return F.struct(F.lit("Point").alias("type"), F.array(*at).alias("coordinates"))


def feature(x: Num, y: Num, properties: Column) -> Column:
    """A feature; ``properties`` is a map of strings."""
    return F.to_json(_feature(x, y, properties))


def _feature(x: Num, y: Num, properties: Column) -> Column:
    return F.struct(
        F.lit("Feature").alias("type"), _geometry(x, y).alias("geometry"), properties.alias("properties")
    )


def feature_collections(points: DataFrame, by: Sequence[str], properties: Column, per_part: int | None = None) -> DataFrame:
    """Feature collections of the groups ``by``: by, part, features, geojson.

    One collection per group by default, which is one value and so has to fit into one task; with ``per_part`` a group is
    cut into parts of about so many features (by a hash of its coordinates).
    """
    if per_part is None:
        p = points.withColumn("part", F.lit(0).cast("bigint"))
    else:
        w = points.groupBy(*by).count().select(*by, F.ceil(F.col("count") / per_part).alias("parts"))
        p = points.join(w, list(by)).withColumn("part", F.pmod(F.xxhash64("x", "y", *by, *_ids(points)), F.col("parts")))
    rows = p.groupBy(*by, "part").agg(F.sort_array(F.collect_list(feature("x", "y", properties))).alias("f"))
    out = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("f", ","), F.lit("]}"))
    return rows.select(*by, "part", F.size("f").alias("features"), out.alias("geojson"))


def _ids(df: DataFrame) -> list[str]:
    return ["object_id"] if "object_id" in df.columns else []


def parse_point(text: Num, *, default_z: bool = False) -> Column:
    """struct(x, y[, z]) of a Point's text; null for bad JSON, another type or fewer than two finite coordinates."""
    g = F.from_json(c(text), POINT_SCHEMA)
    at = g["coordinates"]
    ok = (g["type"] == "Point") & (F.size(at) >= 2) & ~F.exists(at, lambda v: v.isNull() | F.isnan(v))
    cols = [F.get(at, F.lit(0)).alias("x"), F.get(at, F.lit(1)).alias("y")]
    if default_z:
        cols.append(F.coalesce(F.get(at, F.lit(2)), F.lit(0.0)).alias("z"))
    return F.when(ok, F.struct(*cols))


def polygon(exterior: Column, interiors: Column) -> Column:
    """Exterior first, then the holes, of ring columns of struct<x, y>."""
    pair = lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    holes = F.coalesce(interiors, F.array().cast("array<array<struct<x:double,y:double>>>"))
    rings = F.concat(F.array(pair(exterior)), F.transform(holes, pair))
    return F.when(
        exterior.isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))
    )


def parse_polygon(text: Num) -> Column:
    """struct(exterior, interiors); further ordinates are dropped; null unless there is at least one ring."""
    g = F.from_json(c(text), POLYGON_SCHEMA)
    rings = F.transform(
        g["coordinates"],
        lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))),
    )
    ok = (g["type"] == "Polygon") & (F.size(rings) >= 1)
    return F.when(
        ok,
        F.struct(F.get(rings, F.lit(0)).alias("exterior"), F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))).alias("interiors")),
    )


# --- plain values -----------------------------------------------------------------------------------


def _load(text: str, kind: str) -> list:
    try:
        g = json.loads(text)
    except ValueError as e:
        raise InvalidInputError(f"no JSON: {e}") from None
    if not isinstance(g, dict) or g.get("type") != kind or not isinstance(g.get("coordinates"), list):
        raise InvalidInputError(f"no {kind}")
    return g["coordinates"]


def _numbers(v: object) -> list[float]:
    if not isinstance(v, list) or len(v) < 2 or not all(isinstance(k, int | float) and math.isfinite(k) for k in v):
        raise InvalidInputError("a position needs two finite coordinates")
    return [float(k) for k in v]


def read_point(text: str) -> tuple[float, float]:
    at = _numbers(_load(text, "Point"))
    return at[0], at[1]


def read_point_3d(text: str) -> tuple[float, float, float]:
    at = _numbers(_load(text, "Point"))
    return at[0], at[1], at[2] if len(at) > 2 else 0.0


def read_polygon(text: str) -> tuple[list, list]:
    rings = _load(text, "Polygon")
    if not rings:
        raise InvalidInputError("a polygon needs a ring")
    if not all(isinstance(r, list) for r in rings):
        raise InvalidInputError("a ring is a list of positions")
    parsed = [close_ring([tuple(_numbers(p)[:2]) for p in r]) for r in rings]
    return parsed[0], parsed[1:]


def write_point(x: float, y: float, z: float | None = None) -> str:
    at = [x, y] if z is None else [x, y, z]
    return json.dumps({"type": "Point", "coordinates": [float(v) for v in at]}, separators=(",", ":"))


def write_polygon(exterior: Sequence, interiors: Sequence = ()) -> str:
    rings = [[list(p) for p in close_ring(r)] for r in (exterior, *interiors)]
    return json.dumps({"type": "Polygon", "coordinates": rings}, separators=(",", ":"))
