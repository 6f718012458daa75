"""Rules for arguments (raising) and for columns of a batch (quarantine)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.constants import MAX_ALTITUDE_M, MAX_RADIUS_M, MIN_ALTITUDE_M
from driftline.errors import InvalidInputError, InvalidTimestampError
from driftline.functions.geo import usable

# What an identifier may not contain.
FORBIDDEN = ("|", "\n", "\r", "::")
FORBIDDEN_PATTERN = r"[|\n\r]|::"
MAX_SECONDS = 253_402_300_799


def identifier(value: str, what: str = "identifier") -> str:
    if not value:
        raise InvalidInputError(f"{what} must not be empty")
    for bad in FORBIDDEN:
        if bad in value:
            raise InvalidInputError(f"{what} must not contain {bad!r}")
    return value


def point(x: float, y: float) -> tuple[float, float]:
    for name, v, limit in (("longitude", x, 180.0), ("latitude", y, 90.0)):
        if not math.isfinite(v) or abs(v) > limit:
            raise InvalidInputError(f"{name} {v} is not within [-{limit:g}, {limit:g}]")
    return float(x), float(y)


def point_3d(x: float, y: float, z: float) -> tuple[float, float, float]:
    point(x, y)
    if not math.isfinite(z) or not MIN_ALTITUDE_M <= z <= MAX_ALTITUDE_M:
        raise InvalidInputError(f"altitude {z} is not within [{MIN_ALTITUDE_M:g}, {MAX_ALTITUDE_M:g}]")
    return float(x), float(y), float(z)


def points(values: Sequence[Sequence[float]]) -> None:
    """All points of a sequence; the message names the first bad index."""
    for i, p in enumerate(values):
        try:
            (point if len(p) == 2 else point_3d)(*p)
        except InvalidInputError as e:
            raise InvalidInputError(f"point {i}: {e}") from None


def polygon(exterior: Sequence[Sequence[float]], interiors: Sequence[Sequence[Sequence[float]]] = ()) -> None:
    for ring in (exterior, *interiors):
        points(ring)


def radius(r: float) -> float:
    if not math.isfinite(r) or r <= 0 or r > MAX_RADIUS_M:
        raise InvalidInputError(f"radius {r} is not within (0, {MAX_RADIUS_M:g}]")
    return float(r)


def bbox(min_x: float, min_y: float, max_x: float, max_y: float) -> None:
    point(min_x, min_y)
    point(max_x, max_y)
    if min_x >= max_x or min_y >= max_y:
        raise InvalidInputError("a box needs min < max on both axes")


def bbox_3d(min_x: float, min_y: float, min_z: float, max_x: float, max_y: float, max_z: float) -> None:
    point_3d(min_x, min_y, min_z)
    point_3d(max_x, max_y, max_z)
    if min_x >= max_x or min_y >= max_y or min_z >= max_z:
        raise InvalidInputError("a box needs min < max on all axes")


def limit(n: int | None) -> int | None:
    """A limit as it is given; None is none."""
    if n is not None and n < 0:
        raise InvalidInputError("limit must not be negative")
    return n


def seconds(s: float) -> int:
    """Epoch seconds to microseconds."""
    if not math.isfinite(s) or s < 0 or s > MAX_SECONDS:
        raise InvalidTimestampError(f"{s} is no time after the epoch")
    return round(s * 1_000_000)


# --- batches --------------------------------------------------------------------------------------


def identifier_ok(col: str) -> Column:
    return F.coalesce((F.col(col) != "") & ~F.col(col).rlike(FORBIDDEN_PATTERN), F.lit(False))


def problem() -> Column:
    """Why an update row would be refused: namespace, object_id, position or timestamp; null if it is fine."""
    return (
        F.when(~identifier_ok("namespace"), "namespace")
        .when(~identifier_ok("object_id"), "object_id")
        .when((F.col("op") == "U") & ~usable(), "position")
        .when((F.col("op") == "U") & F.col("ts").isNull(), "timestamp")
        .when(~F.coalesce(F.col("op").isin("U", "T"), F.lit(False)), "op")
    )


def quarantine(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be applied, refused rows with a column ``problem``)."""
    tagged = updates.withColumn("problem", problem())
    return tagged.where(F.col("problem").isNull()).drop("problem"), tagged.where(F.col("problem").isNotNull())
