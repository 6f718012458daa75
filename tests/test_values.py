"""Plain values and index tables."""

import pytest
from helpers import loc_frame, tuples

from driftline.errors import InvalidInputError, InvalidTimestampError
from driftline.model import Box, DistanceMetric, Point, Polygon, TemporalPoint
from driftline.operators import batch, index

ZONE = "namespace string, key string, min_x double, min_y double, max_x double, max_y double, data binary"


def test_points():
    nyc, brooklyn = Point(-74.0060, 40.7128), Point(-73.9442, 40.6782, 100.0)
    assert nyc.distance_to(brooklyn) == pytest.approx(6476.7, abs=1)
    assert nyc.distance_3d(brooklyn) > nyc.distance_to(brooklyn)
    assert Point.from_geojson(nyc.to_geojson()) == nyc
    assert TemporalPoint(nyc, 5.0).timestamp == 5.0
    for bad in (lambda: Point(200, 0), lambda: Point(0, 0, 1e9), lambda: Point(float("nan"), 0)):
        with pytest.raises(InvalidInputError):
            bad()
    with pytest.raises(InvalidTimestampError):
        TemporalPoint(nyc, -1.0)
    assert DistanceMetric.of("Rhumb") is DistanceMetric.RHUMB
    with pytest.raises(InvalidInputError):
        DistanceMetric.of("taxi")


def test_boxes_and_polygons():
    b = Box.of((3, 2, 1), (1, 1, 5))
    assert (b.lo, b.hi, b.size, b.volume, b.center) == ((1, 1, 1), (3, 2, 5), (2, 1, 4), 8, (2, 1.5, 3))
    assert b.contains((3, 2, 5)) and not b.contains((3.1, 2, 5))
    assert b.intersects(Box((3, 2, 5), (4, 4, 9))) and not b.intersects(Box((3.1, 2, 5), (4, 4, 9)))
    assert b.to_2d().expand(1, -2) == Box((0, 0), (4, 3))
    p = Polygon.of([(0, 0), (1, 0), (1, 1)], [[(0.5, 0.1), (0.6, 0.1), (0.6, 0.2)]])
    assert p.exterior[0] == p.exterior[-1]
    assert Polygon.from_geojson(p.to_geojson()) == p
    assert p.bounds == Box((0, 0), (1, 1))
    with pytest.raises(InvalidInputError):
        Polygon.of([(0, 0), (1, 0), (1, 100)])


def test_index_tables(spark):
    pts = loc_frame(spark, [("n", "a", 1.0, 1.0, 5.0), ("m", "a", 2.0, 2.0, 5.0)])
    more = spark.createDataFrame([("n", "a", 3.0, 3.0)], "namespace string, object_id string, x double, y double")
    both = index.insert_points(pts, more)
    assert sorted(tuples(both, "namespace", "x", "z")) == [("m", 2.0, 5.0), ("n", 1.0, 5.0), ("n", 3.0, 0.0)]
    assert tuples(index.index_stats(both), "namespaces", "points") == [(2, 3)]
    keys = spark.createDataFrame([("n", "a")], "namespace string, object_id string")
    assert tuples(index.remove(both, keys), "namespace") == [("m",)]
    assert tuples(index.namespace_points(both, "m"), "x", "y") == [(2.0, 2.0)]
    assert index.clear(both).collect() == [] and len(index.clear(both, "n").collect()) == 1
    zones = spark.createDataFrame([("n", "z", 0.0, 0.0, 1.0, 1.0, b"1")], ZONE)
    got = index.insert_zones(zones, spark.createDataFrame([("n", "y", 5.0, 6.0, 4.0, 3.0, None)], ZONE))
    assert sorted(tuples(got, "key", "min_x", "min_y", "max_x", "max_y")) == [("y", 4.0, 3.0, 5.0, 6.0), ("z", 0.0, 0.0, 1.0, 1.0)]
    assert tuples(index.remove(got, zones.limit(1), on="key"), "key") == [("y",)]
    assert tuples(batch.lookup(pts, keys), "namespace", "x") == [("n", 1.0)]


def test_knn_join_with_few_objects(spark):
    pts = loc_frame(spark, [("n", "a", 0.0, 0.0, 0.0), ("n", "b", 170.0, 80.0, 0.0)])
    probes = spark.createDataFrame([(1, "n", 1.0, 0.0, 0.0), (2, "unknown", 0.0, 0.0, 0.0)], "probe_id int, namespace string, x double, y double, z double")
    assert sorted(tuples(batch.knn_join(pts, probes, 5, growth=100.0), "probe_id", "neighbor_id", "rank")) == [(1, "a", 1), (1, "b", 2)]
    assert batch.all_knn(pts.limit(1), 3).collect() == []
    assert batch.all_knn(pts.limit(0), 3).collect() == []
