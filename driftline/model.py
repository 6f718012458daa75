"""Plain values for the driver side: points, boxes, polygons."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from driftline.constants import EARTH_RADIUS_M
from driftline.errors import InvalidInputError
from driftline.functions import geojson, validate
from driftline.functions.geo import close_ring, ring_bounds


class DistanceMetric(Enum):
    HAVERSINE = "haversine"
    GEODESIC = "geodesic"
    RHUMB = "rhumb"
    EUCLIDEAN = "euclidean"

    @classmethod
    def of(cls, name: str) -> DistanceMetric:
        try:
            return cls(name.lower())
        except ValueError:
            raise InvalidInputError(f"unknown metric {name!r}") from None


@dataclass(frozen=True)
class Point:
    """Longitude, latitude and optionally altitude."""

    x: float
    y: float
    z: float | None = None

    def __post_init__(self) -> None:
        validate.point(self.x, self.y) if self.z is None else validate.point_3d(self.x, self.y, self.z)

    def distance_to(self, other: Point) -> float:
        """Great-circle metres, without regard to altitude."""
        p1, p2 = math.radians(self.y), math.radians(other.y)
        a = math.sin((p2 - p1) / 2) ** 2
        a += math.cos(p1) * math.cos(p2) * math.sin(math.radians(other.x - self.x) / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, a)))

    def distance_3d(self, other: Point) -> float:
        return math.hypot(self.distance_to(other), (other.z or 0.0) - (self.z or 0.0))

    def to_geojson(self) -> str:
        return geojson.write_point(self.x, self.y, self.z)

    @classmethod
    def from_geojson(cls, text: str) -> Point:
        return cls(*geojson.read_point(text))


@dataclass(frozen=True)
class TemporalPoint:
    """A point at a time in epoch seconds."""

    point: Point
    timestamp: float

    def __post_init__(self) -> None:
        validate.seconds(self.timestamp)

    def distance_to(self, other: TemporalPoint) -> float:
        """Metres with altitude, whatever the times."""
        return self.point.distance_3d(other.point)


@dataclass(frozen=True)
class Box:
    """Box between two opposite corners in two or three dimensions, normalised on every axis."""

    lo: tuple[float, ...]
    hi: tuple[float, ...]

    @classmethod
    def of(cls, a: Sequence[float], b: Sequence[float]) -> Box:
        return cls(tuple(map(min, a, b)), tuple(map(max, a, b)))

    @property
    def center(self) -> tuple[float, ...]:
        return tuple((p + q) / 2 for p, q in zip(self.lo, self.hi, strict=True))

    @property
    def size(self) -> tuple[float, ...]:
        return tuple(q - p for p, q in zip(self.lo, self.hi, strict=True))

    @property
    def volume(self) -> float:
        return math.prod(self.size)

    def contains(self, at: Sequence[float]) -> bool:
        """Edges included."""
        return all(p <= v <= q for p, v, q in zip(self.lo, at, self.hi, strict=True))

    def intersects(self, other: Box) -> bool:
        return all(a <= d and c <= b for a, b, c, d in zip(self.lo, self.hi, other.lo, other.hi, strict=True))

    def expand(self, *by: float) -> Box:
        return Box.of([p - d for p, d in zip(self.lo, by, strict=True)], [q + d for q, d in zip(self.hi, by, strict=True)])

    def to_2d(self) -> Box:
        return Box(self.lo[:2], self.hi[:2])


@dataclass(frozen=True)
class Polygon:
    """Exterior and holes; rings are closed if they weren't."""

    exterior: tuple
    interiors: tuple = ()

    @classmethod
    def of(cls, exterior: Sequence, interiors: Sequence = ()) -> Polygon:
        validate.polygon(exterior, interiors)
        return cls(tuple(close_ring(exterior)), tuple(tuple(close_ring(h)) for h in interiors))

    @property
    def bounds(self) -> Box:
        x0, y0, x1, y1 = ring_bounds(self.exterior)
        return Box((x0, y0), (x1, y1))

    def to_geojson(self) -> str:
        return geojson.write_polygon(self.exterior, self.interiors)

    @classmethod
    def from_geojson(cls, text: str) -> Polygon:
        return cls.of(*geojson.read_polygon(text))
