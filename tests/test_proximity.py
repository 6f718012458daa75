import math
import random

import brute
import pytest
from helpers import loc_frame, tuples
from pyspark.sql import functions as F

from driftline.operators import batch, proximity, grid

ZONE = "namespace string, key string, min_x double, min_y double, max_x double, max_y double, data binary"
FENCE = "namespace string, fence_id string, exterior array<struct<x:double,y:double>>, interiors array<array<struct<x:double,y:double>>>"


def cloud(seed, n=120, spread=60.0):
    """Points around places everywhere: the date line, both poles, high latitudes."""
    rnd = random.Random(seed)
    places = [(0, 0), (180, 10), (-180, 10), (179.9999, -75), (12, 90), (40, -90), (100, 89.9995), (-80, 89.9995), (5, 60)]
    out = []
    for i in range(n):
        x, y = rnd.choice(places)
        dx, dy = rnd.uniform(-spread, spread) / 111195, rnd.uniform(-spread, spread) / 111195
        y = max(-90.0, min(90.0, y + dy))
        x = (x + dx / max(0.01, math.cos(math.radians(y))) + 180) % 360 - 180
        out.append((rnd.choice(["a", "b"]), f"p{i:03d}", x, y, rnd.choice([0.0, 0.0, 30.0])))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("radius", "crowd"), [(50.0, 4096), (50.0, 3), (2_000.0, 10)])
def test_near_pairs_equal_brute_force(spark, seed, radius, crowd):
    rows = cloud(seed)
    loc = {(r[0], r[1]): {"x": r[2], "y": r[3], "z": r[4]} for r in rows}
    got = tuples(proximity.near_pairs(loc_frame(spark, rows), radius, crowd=crowd), "namespace", "key_a", "key_b")
    assert len(got) == len(set(got))
    assert set(got) == brute.near(loc, radius)


def test_large_radius(spark):
    rows = cloud(9, 60)
    loc = {(r[0], r[1]): {"x": r[2], "y": r[3], "z": r[4]} for r in rows}
    got = tuples(proximity.near_pairs(loc_frame(spark, rows), 9_000_000.0), "namespace", "key_a", "key_b")
    assert set(got) == brute.near(loc, 9_000_000.0)


def test_current_location(spark):
    rows = [
        ("n", "a", 1.0, 1.0, 0.0, None), ("n", "a", 2.0, 1.0, 0.0, 5), ("n", "a", 3.0, 1.0, 0.0, 4),
        ("n", "a", 500.0, 1.0, 0.0, 9), ("n", "b", float("nan"), 1.0, 0.0, 1), ("n", "c", 1.0, None, 0.0, 1),
        ("n", "d", 7.0, 1.0, 0.0, None), (None, "e", 1.0, 1.0, 0.0, 1), ("n", None, 1.0, 1.0, 0.0, 1),
        ("n", "f", 4.0, 1.0, 0.0, 3), ("n", "f", 5.0, 1.0, 0.0, 3),
    ]
    got = sorted(tuples(proximity.current_locations(loc_frame(spark, rows)), "object_id", "x"))
    assert got == [("a", 2.0), ("d", 7.0), ("f", 5.0)]


def test_boxes(spark):
    pts = loc_frame(spark, [("n", "edge", 1.0, 1.0, 0.0), ("n", "in", 0.5, 0.5, 0.0), ("n", "out", 1.1, 0.5, 0.0), ("m", "in", 0.5, 0.5, 0.0)])
    zones = spark.createDataFrame(
        [
            ("n", "z", 0.0, 0.0, 1.0, 1.0, b"x"), ("n", "z", 0.0, 0.0, 1.0, 1.0, None), ("n", "inverted", 1.0, 0.0, 0.0, 1.0, None),
            ("n", "world", -180.0, -90.0, 180.0, 90.0, None), ("n", "dot", 0.5, 0.5, 0.5, 0.5, None), ("n", "beyond", -1e300, -1e9, 0.2, 1e9, None), ("n", "off", 200.0, 0.0, 300.0, 1.0, None),
            ("n", "wide", -1e12, 0.9, 1e12, float("inf"), None),
            ("n", "nan", float("nan"), 0.0, 1.0, 1.0, None), ("n", None, 0.0, 0.0, 1.0, 1.0, None), ("n", "null", None, 0.0, 1.0, 1.0, None),
        ],
        ZONE,
    )
    got = sorted(tuples(proximity.points_in_boxes(pts, zones), "object_id", "key"))
    assert got == [("edge", "world"), ("edge", "z"), ("in", "dot"), ("in", "world"), ("in", "z"), ("out", "world")]


def test_random_boxes(spark):
    rnd = random.Random(4)
    pts = [("n", f"p{i}", rnd.uniform(-180, 180), rnd.uniform(-90, 90), 0.0) for i in range(300)]
    boxes = []
    for i in range(60):
        x, y, w = rnd.uniform(-180, 180), rnd.uniform(-90, 90), 10 ** rnd.uniform(-3, 2.2)
        boxes.append(("n", f"z{i}", x, y, x + w, y + w / 2, None))
    zones = spark.createDataFrame(boxes, ZONE)
    want = {(p[1], b[1]) for p in pts for b in boxes if b[2] <= p[2] <= b[4] and b[3] <= p[3] <= b[5]}
    for split in ({}, {"most": 0, "crowd": 7}):
        assert set(tuples(proximity.points_in_boxes(loc_frame(spark, pts), zones, **split), "object_id", "key")) == want


def test_a_crowded_cell_is_spread(spark):
    """A box around the globe and a crowd in one spot: no sub-cell holds more than its share of the crowd."""
    pts = loc_frame(spark, [("n", f"p{i}", 1.0, 1.0, 0.0) for i in range(2000)])
    box = spark.createDataFrame([("n", "world", -180.0, -90.0, 180.0, 90.0, None)], ZONE)
    edges = ["min_x", "min_y", "max_x", "max_y"]
    cell = ["namespace", "g_level", "g_x", "g_y"]
    joined = grid.split_join(grid.plane_points(pts, [0]), grid.plane_boxes(box, *edges), cell, "object_id", 100)
    sub = F.pmod(F.xxhash64("object_id"), F.lit(20))
    assert joined.count() == 2000
    assert max(r["count"] for r in joined.drop("count").groupBy(sub.alias("s")).count().collect()) < 200
    got = proximity.points_in_boxes(pts, box, most=0, crowd=100)
    assert got.count() == 2000


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def test_fences(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1)]
    fences = spark.createDataFrame(
        [
            ("n", "open", ring(*square), None),
            ("n", "closed", ring(*square[::-1], square[-1]), []),
            ("n", "repeated", ring(*[p for p in square for _ in (0, 1)]), [ring(*hole)]),
            ("n", "line", ring((0, 0), (4, 4)), None),
            ("n", "empty", [], None),
            ("n", "none", None, None),
            ("n", None, ring(*square), None),
        ],
        FENCE,
    )
    at = {"inside": (3, 3), "corner": (4, 4), "edge": (2, 0), "hole": (1.5, 1.5), "rim": (1, 1.5), "away": (5, 5)}
    pts = loc_frame(spark, [("n", k, float(x), float(y), 0.0) for k, (x, y) in at.items()])
    got = sorted(tuples(proximity.points_in_polygons(pts, fences), "object_id", "fence_id"))
    assert got == sorted([("inside", f) for f in ("open", "closed", "repeated")] + [(p, f) for p in ("hole", "rim") for f in ("open", "closed")])


@pytest.mark.parametrize("seed", range(2))
def test_random_fences(spark, seed):
    rnd = random.Random(seed)
    fences, pts = [], [(f"p{i}", rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for i in range(300)]
    for i in range(12):
        cx, cy = rnd.uniform(-2, 2), rnd.uniform(-2, 2)
        angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(rnd.randrange(3, 14)))
        outer = [(cx + math.cos(a) * rnd.uniform(0.4, 1.5), cy + math.sin(a) * rnd.uniform(0.4, 1.5)) for a in angles]
        inner = [(cx + math.cos(a) * 0.2, cy + math.sin(a) * 0.2) for a in (0, 2, 4)]
        fences.append((f"f{i}", outer, [inner]))
    got = set(
        tuples(
            proximity.points_in_polygons(
                loc_frame(spark, [("n", p, x, y, 0.0) for p, x, y in pts]),
                spark.createDataFrame([("n", f, ring(*o), [ring(*h) for h in hs]) for f, o, hs in fences], FENCE),
            ),
            "object_id",
            "fence_id",
        )
    )
    assert got == {(p, f) for p, x, y in pts for f, o, hs in fences if brute.in_polygon(x, y, o, hs)}


def test_empty_tables(spark):
    none = loc_frame(spark, [])
    zones, fences = spark.createDataFrame([], ZONE), spark.createDataFrame([], FENCE)
    assert proximity.relations(none, zones, fences).collect() == []
    assert proximity.relations(loc_frame(spark, [("n", "a", 1.0, 1.0, 0.0)]), zones, fences).collect() == []


def test_all_knn_equals_brute_force(spark):
    rows = [r for r in cloud(3, 70) if r[0] == "a"]
    got = tuples(batch.all_knn(loc_frame(spark, rows), 3), "object_id", "neighbor_id", "rank")
    want = []
    for _, a, x, y, z in rows:
        near = sorted((math.hypot(brute.meters(x, y, x2, y2), z - z2), b) for _, b, x2, y2, z2 in rows if b != a)[:3]
        want += [(a, b, i + 1) for i, (_, b) in enumerate(near)]
    assert sorted(got) == sorted(want)


def test_radius_join_limits_per_probe(spark):
    rows = [("n", f"p{i}", 0.0001 * i, 0.0, 0.0) for i in range(20)]
    probes = spark.createDataFrame([(1, "n", 0.0, 0.0, 0.0), (2, "n", 50.0, 0.0, 0.0)], "probe_id int, namespace string, x double, y double, z double")
    got = batch.radius_join(loc_frame(spark, rows), probes, 100.0, 3).orderBy("distance")
    assert tuples(got, "probe_id", "object_id") == [(1, "p0"), (1, "p1"), (1, "p2")]
    assert batch.radius_join(loc_frame(spark, rows), probes, 100.0).agg(F.count("*")).first()[0] == 9
