"""Queries over whole tables for every operator of the store, with the SQL that states the same.

``point_in`` gives current positions (``LOC``), ``update_log`` the change feed.  Distances are rounded to millimetres on
both sides, since the last bits of trigonometric functions differ between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import geo, geodesic, geojson, namespaces, validate
from driftline.operators import batch, geometry, history, index, proximity, spatial
from driftline.operators import stats as counters
from driftline.operators.change_feed import replay
from driftline.operators.runs import trajectory_events
from driftline.session import shared_folder
from driftline.sources import logio
from driftline.sources.tables import table
from driftline.streaming import latest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NS = "vans"
CENTER = (-107.75, -31.68, 15.0)
RADIUS = 60_000.0
R = "6371008.8"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


# --- SQL building blocks ----------------------------------------------------------------------------


def hav(x1: object, y1: object, x2: object, y2: object) -> str:
    return (
        f"(2 * {R} * asin(sqrt(least(1.0, pow(sin(radians({y2} - ({y1})) / 2), 2) + cos(radians({y1}))"
        f" * cos(radians({y2})) * pow(sin(radians({x2} - ({x1})) / 2), 2)))))"
    )


def hav3(x1: object, y1: object, z1: object, x2: object, y2: object, z2: object) -> str:
    return f"sqrt(pow({hav(x1, y1, x2, y2)}, 2) + pow({z2} - ({z1}), 2))"


# NaN is tested by itself: statistics of a Parquet file leave it out, so a range filter may be dropped as always true.
OK = (
    "(isfinite(x) AND isfinite(y) AND isfinite(z) AND x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90"
    " AND z BETWEEN -11000 AND 100000)"
)
LOC = f"""loc AS (SELECT namespace, object_id, x, y, z, metadata, ts FROM point_in
  WHERE {OK} AND namespace IS NOT NULL AND object_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY namespace, object_id
    ORDER BY ts DESC NULLS LAST, x DESC, y DESC, z DESC, metadata DESC NULLS LAST) = 1)"""
GOOD_ID = "(object_id <> '' AND NOT regexp_matches(object_id, '[|\\n\\r]|::') AND namespace IS NOT NULL)"
APPLIED = f"""applied AS (SELECT DISTINCT namespace, object_id, op, seq, ts, x, y, z, metadata FROM update_log
  WHERE seq IS NOT NULL AND {GOOD_ID} AND (op = 'T' OR (op = 'U' AND ts IS NOT NULL AND {OK})))"""


def state(tie: str = "DESC") -> str:
    return f"""{APPLIED}, gone AS (SELECT namespace, object_id, max(seq) AS g FROM applied WHERE op = 'T' GROUP BY ALL),
state AS (SELECT a.* FROM applied a LEFT JOIN gone USING (namespace, object_id)
  WHERE op = 'U' AND seq > coalesce(g, -1)
  QUALIFY row_number() OVER (PARTITION BY namespace, object_id ORDER BY ts DESC, seq {tie}) = 1)"""


X, Y, Z = CENTER
BOX = (-108.2, -31.9, -107.2, -31.3)
FENCE = [(-108.0, -31.9), (-107.4, -31.95), (-107.3, -31.4), (-107.75, -31.6), (-108.1, -31.35)]
HOLE = [(-107.769, -31.6925), (-107.7675, -31.6925), (-107.7675, -31.6895), (-107.769, -31.6895)]


def envelope_sql(x: object = X, y: object = Y, r: float = RADIUS) -> str:
    """The degree box of the radius queries; the centre may be columns."""
    dlat, dlon = f"degrees({r} / {R})", f"degrees({r} / ({R} * cos(radians(least(abs({y}), 89.9)))))"
    return f"x BETWEEN {x} - {dlon} AND {x} + {dlon} AND y BETWEEN {y} - {dlat} AND {y} + {dlat}"


def ball_sql(flat: bool = False, x: object = X, y: object = Y, z: object = Z, r: float = RADIUS) -> str:
    d = hav("x", "y", x, y) if flat else hav3("x", "y", "z", x, y, z)
    return f"""ball AS (SELECT *, {d} AS d FROM loc WHERE namespace = '{NS}' AND {envelope_sql(x, y, r)} AND {d} <= {r})"""


NEIGHBOR = "object_id, x, y, z, metadata, round(d, 3) AS distance"
TOP = "ORDER BY d, object_id LIMIT 50"


def ring_sql(ring: list[tuple[float, float]]) -> tuple[str, str]:
    """(inside, on the boundary) of a literal ring."""
    crossings, on = [], []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        side = f"(({x2}::DOUBLE - {x1}::DOUBLE) * (y - {y1}) - ({y2}::DOUBLE - {y1}::DOUBLE) * (x - {x1}))"
        crossings.append(
            f"((({y1} <= y AND {y2} > y AND {side} > 0) OR ({y2} <= y AND {y1} > y AND {side} < 0))::INT)"
        )
        on.append(
            f"({side} = 0 AND x BETWEEN least({x1}, {x2}) AND greatest({x1}, {x2})"
            f" AND y BETWEEN least({y1}, {y2}) AND greatest({y1}, {y2}))"
        )
    return f"(({' + '.join(crossings)}) % 2 = 1)", f"({' OR '.join(on)})"


def polygon_sql(holes: list[list[tuple[float, float]]]) -> str:
    inside, on = ring_sql(FENCE)
    rest = "".join(f" AND NOT ({a} OR {b})" for a, b in map(ring_sql, holes))
    return f"WITH {LOC} SELECT object_id, x, y, z, metadata FROM loc WHERE namespace = '{NS}' AND {inside} AND NOT {on}{rest} ORDER BY object_id LIMIT 1000"


def locations(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.current_locations(table(spark, sf, "point_in"))


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "update_log")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 3) for c in cols or ("distance",)})


def one_id(df: DataFrame, last: bool = False) -> str:
    """An object to ask about: the one nearest to (or furthest from) the middle of the map, by id among equals."""
    far = F.struct(F.greatest(F.abs("x") / 2, F.abs("y")).alias("far"), "object_id")
    ids = spatial.of_namespace(df, NS).agg((F.max if last else F.min)(far).alias("o"))
    return ids.first().o.object_id


ONE = f"one AS (SELECT x AS ox, y AS oy, z AS oz, object_id AS oid FROM loc WHERE namespace = '{NS}' ORDER BY greatest(abs(x) / 2, abs(y)), object_id LIMIT 1)"
TWO = f"two AS (SELECT x AS tx, y AS ty FROM loc WHERE namespace = '{NS}' ORDER BY greatest(abs(x) / 2, abs(y)) DESC, object_id DESC LIMIT 1)"

# --- state ------------------------------------------------------------------------------------------


def _state(spark: SparkSession, sf: str, tie: str) -> DataFrame:
    s = replay(feed(spark, sf), tie=tie)
    return s.select("namespace", "object_id", "seq", F.unix_micros("ts").alias("ts_us"), "x", "y", "z", "metadata")


STATE_COLS = "namespace, object_id, seq, epoch_us(ts) AS ts_us, x, y, z, metadata"


@query(f"WITH {state()} SELECT {STATE_COLS} FROM state")
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf, "last")


@query(f"WITH {state('ASC')} SELECT {STATE_COLS} FROM state")
def current_state_first_tie(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf, "first")


@query(f"WITH {state()} SELECT {STATE_COLS} FROM state")
def state_onto_base(spark: SparkSession, sf: str) -> DataFrame:
    """The newer half of the feed applied to the state after the older half."""
    f = feed(spark, sf)
    middle = f.agg(F.percentile_approx("seq", 0.5)).first()[0]
    s = replay(f.where(F.col("seq") > middle), replay(f.where(F.col("seq") <= middle)))
    return s.select("namespace", "object_id", "seq", F.unix_micros("ts").alias("ts_us"), "x", "y", "z", "metadata")


@query(f"WITH {LOC} SELECT object_id, x, y, z, metadata FROM loc WHERE namespace = '{NS}' ORDER BY greatest(abs(x) / 2, abs(y)), object_id LIMIT 1")
def get(spark: SparkSession, sf: str) -> DataFrame:
    loc = locations(spark, sf)
    oid = one_id(loc)
    return spatial.of_namespace(loc, NS).where(F.col("object_id") == oid).select(*spatial.LOCATION)


@query(
    f"WITH {state()} SELECT DISTINCT namespace, object_id FROM applied WHERE op = 'T'"
    " AND (namespace, object_id) NOT IN (SELECT (namespace, object_id) FROM state)"
)
def delete_hides_object(spark: SparkSession, sf: str) -> DataFrame:
    """Objects that were deleted and not written again: absent from the state."""
    key = ["namespace", "object_id"]
    f = feed(spark, sf)
    gone = f.where((F.col("op") == "T") & validate.identifier_ok("object_id") & F.col("namespace").isNotNull())
    return gone.where(F.col("seq").isNotNull()).select(*key).distinct().join(replay(f, payload=()), key, "left_anti")


@query(
    f"WITH {state()} SELECT namespace, object_id, count(*) AS n FROM applied WHERE op = 'U'"
    " AND (namespace, object_id) NOT IN (SELECT (namespace, object_id) FROM state) GROUP BY ALL"
)
def deleted_history_visible(spark: SparkSession, sf: str) -> DataFrame:
    """History rows of objects that are absent from the state: deletes do not hide it."""
    key = ["namespace", "object_id"]
    f = feed(spark, sf)
    ok = validate.identifier_ok("object_id") & F.col("namespace").isNotNull() & F.col("seq").isNotNull()
    past = f.where((F.col("op") == "U") & F.col("ts").isNotNull() & geo.usable() & ok)
    rows = past.select(*key, "op", "seq", "ts", "x", "y", "z", "metadata").distinct()
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return counts.join(replay(f, payload=()), key, "left_anti")


# --- radius and cylinder ----------------------------------------------------------------------------


@query(f"WITH {LOC}, {ball_sql()} SELECT {NEIGHBOR} FROM ball {TOP}")
def radius_3d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.radius_3d(locations(spark, sf), NS, CENTER, RADIUS, 50))


@query(f"WITH {LOC}, {ball_sql(True)} SELECT {NEIGHBOR} FROM ball {TOP}")
def radius_2d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.radius_2d(locations(spark, sf), NS, CENTER, RADIUS, 50))


@query(f"WITH {LOC}, {ball_sql(True)} SELECT count(*) AS n FROM ball")
def radius_count(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.radius_count(locations(spark, sf), NS, CENTER, RADIUS)


@query(f"WITH {LOC}, {ball_sql(True)} SELECT count(*) > 0 AS found FROM ball")
def radius_exists(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.radius_exists(locations(spark, sf), NS, CENTER, RADIUS)


@query(
    f"WITH {LOC} SELECT object_id, x, y, z, metadata, round({hav('x', 'y', 179.99, -16.0)}, 3) AS distance FROM loc"
    f" WHERE namespace = '{NS}' AND {hav('x', 'y', 179.99, -16.0)} <= 3000000 ORDER BY {hav('x', 'y', 179.99, -16.0)}, object_id LIMIT 50"
)
def radius_2d_exact_dateline(spark: SparkSession, sf: str) -> DataFrame:
    """Exact envelope: complete across the date line."""
    loc = locations(spark, sf)
    return rounded(spatial.radius_2d(loc, NS, (179.99, -16.0), 3_000_000.0, 50, envelope="exact"))


@query(f"WITH {LOC}, {ball_sql(True)} SELECT {NEIGHBOR} FROM ball WHERE z BETWEEN 5 AND 40 {TOP}")
def cylinder(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.cylinder(locations(spark, sf), NS, CENTER[:2], 5.0, 40.0, RADIUS, 50))


@query(f"WITH {LOC}, {ball_sql(True)} SELECT count(*) > 0 AS found FROM ball WHERE z BETWEEN 5 AND 40")
def contains_point_in_altitude_range(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.in_altitude_range(locations(spark, sf), NS, CENTER[:2], 5.0, 40.0, RADIUS)


def near_sql(flat: bool, where: str = "") -> str:
    d = hav("x", "y", "ox", "oy") if flat else hav3("x", "y", "z", "ox", "oy", "oz")
    r = 5_000_000.0
    return (
        f"WITH {LOC}, {ONE}, ball AS (SELECT *, {d} AS d FROM loc, one WHERE namespace = '{NS}'"
        f" AND {envelope_sql('ox', 'oy', r)} AND {d} <= {r} {where}) SELECT {NEIGHBOR} FROM ball {TOP}"
    )


@query(near_sql(False))
def near_object(spark: SparkSession, sf: str) -> DataFrame:
    loc = locations(spark, sf)
    return rounded(spatial.near_object(loc, NS, one_id(loc), 5_000_000.0, 50))


@query(near_sql(True, "AND z BETWEEN 0 AND 100"))
def cylinder_near_object(spark: SparkSession, sf: str) -> DataFrame:
    loc = locations(spark, sf)
    return rounded(spatial.cylinder_near_object(loc, NS, one_id(loc), 0.0, 100.0, 5_000_000.0, 50))


# --- nearest neighbours -----------------------------------------------------------------------------


def knn_sql(rank: str, d: str, where: str = "", extra: str = "") -> str:
    return (
        f"WITH {LOC}{extra} SELECT object_id, x, y, z, metadata, round({d}, 3) AS distance FROM loc{', one' if extra else ''}"
        f" WHERE namespace = '{NS}' {where} ORDER BY {rank}, object_id LIMIT 20"
    )


RANK = f"(x - ({X})) * (x - ({X})) + (y - ({Y})) * (y - ({Y})) + (z - {Z}) * (z - {Z})"
RANK0 = f"(x - ({X})) * (x - ({X})) + (y - ({Y})) * (y - ({Y})) + z * z"


@query(knn_sql(RANK, hav3("x", "y", "z", X, Y, Z)))
def knn_index(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.knn(locations(spark, sf), NS, CENTER, 20).drop("rank_value"))


@query(knn_sql(hav3("x", "y", "z", X, Y, Z), hav3("x", "y", "z", X, Y, Z)))
def knn_haversine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.knn(locations(spark, sf), NS, CENTER, 20, metric="haversine3d").drop("rank_value"))


@query(knn_sql(RANK0, hav("x", "y", X, Y)))
def knn_2d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.knn(locations(spark, sf), NS, CENTER, 20, flat=True).drop("rank_value"))


@query(knn_sql(RANK0, hav("x", "y", X, Y), f"AND {hav('x', 'y', X, Y)} <= 30000"))
def knn_2d_maxdist(spark: SparkSession, sf: str) -> DataFrame:
    got = spatial.knn(locations(spark, sf), NS, CENTER, 20, flat=True, max_distance=30_000.0)
    return rounded(got.drop("rank_value"))


@query(
    knn_sql(
        "(x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz)",
        hav3("x", "y", "z", "ox", "oy", "oz"),
        extra=f", {ONE}",
    )
)
def knn_near_object(spark: SparkSession, sf: str) -> DataFrame:
    loc = locations(spark, sf)
    return rounded(spatial.knn_near_object(loc, NS, one_id(loc), 20).drop("rank_value"))


@query(
    f"WITH {LOC} SELECT a.namespace, a.object_id, b.object_id AS neighbor_id,"
    f" round({hav3('a.x', 'a.y', 'a.z', 'b.x', 'b.y', 'b.z')}, 3) AS distance, row_number() OVER w AS rank"
    " FROM loc a JOIN loc b ON a.namespace = b.namespace AND a.object_id <> b.object_id"
    " WINDOW w AS (PARTITION BY a.namespace, a.object_id"
    f" ORDER BY {hav3('a.x', 'a.y', 'a.z', 'b.x', 'b.y', 'b.z')}, b.object_id) QUALIFY row_number() OVER w <= 3"
)
def all_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest neighbours of every object, by growing grid rings."""
    return rounded(batch.all_knn(locations(spark, sf), 3)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"WITH {LOC} SELECT a.namespace, a.object_id AS key_a, b.object_id AS key_b,"
    f" round({hav3('a.x', 'a.y', 'a.z', 'b.x', 'b.y', 'b.z')}, 3) AS distance"
    " FROM loc a JOIN loc b ON a.namespace = b.namespace AND a.object_id < b.object_id"
    f" WHERE {hav3('a.x', 'a.y', 'a.z', 'b.x', 'b.y', 'b.z')} <= 500"
)
def near_pairs_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(proximity.near_pairs(locations(spark, sf), 500.0))


ZONE_CENTERS = """SELECT DISTINCT namespace, key, (min_x + max_x) / 2 AS px, (min_y + max_y) / 2 AS py FROM zone_in
  WHERE key IS NOT NULL AND min_x <= max_x AND min_y <= max_y"""


@query(
    f"WITH {LOC}, probe AS ({ZONE_CENTERS}), hit AS (SELECT p.namespace, p.key, px, py, l.object_id,"
    f" {hav3('l.x', 'l.y', 'l.z', 'p.px', 'p.py', '0.0')} AS d FROM loc l JOIN probe p ON l.namespace = p.namespace)"
    " SELECT namespace, key, object_id, round(d, 3) AS distance FROM hit WHERE d <= 20000"
    " QUALIFY row_number() OVER (PARTITION BY namespace, key, px, py ORDER BY d, object_id) <= 10"
)
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest objects within 20 km of the centre of every zone: many probes, one join."""
    z = table(spark, sf, "zone_in").where(F.col("key").isNotNull())
    z = z.where((F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")))
    mid = lambda k: ((F.col(f"min_{k}") + F.col(f"max_{k}")) / 2).alias(k)
    probes = z.select("namespace", "key", mid("x"), mid("y"), F.lit(0.0).alias("z")).distinct()
    probes = probes.withColumn("probe_id", F.struct("namespace", "key", "x", "y"))
    hit = batch.radius_join(locations(spark, sf), probes, 20_000.0, 10)
    return rounded(hit.select("namespace", "probe_id.key", "object_id", "distance"))


# --- boxes, polygons, zones -------------------------------------------------------------------------

IN_BOX = "x BETWEEN {} AND {} AND y BETWEEN {} AND {}".format(BOX[0], BOX[2], BOX[1], BOX[3])


@query(
    f"WITH {LOC} SELECT object_id, x, y, z, metadata FROM loc WHERE namespace = '{NS}' AND {IN_BOX}"
    " ORDER BY object_id LIMIT 1000"
)
def bbox_2d(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.bbox(locations(spark, sf), NS, *BOX, limit=1000)


@query(
    f"WITH {LOC} SELECT object_id, x, y, z, metadata FROM loc WHERE namespace = '{NS}' AND {IN_BOX}"
    " AND z BETWEEN 5 AND 40 ORDER BY object_id LIMIT 1000"
)
def bbox_3d(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.bbox_3d(locations(spark, sf), NS, (BOX[0], BOX[1], 5.0), (BOX[2], BOX[3], 40.0), 1000)


def around_sql(extra: str = "") -> str:
    return (
        f"WITH {LOC}, {ONE} SELECT object_id, x, y, z, metadata FROM loc, one WHERE namespace = '{NS}'"
        f" AND x BETWEEN ox - 10.0::DOUBLE / 2 AND ox + 10.0::DOUBLE / 2 AND y BETWEEN oy - 8.0::DOUBLE / 2 AND oy + 8.0::DOUBLE / 2"
        f"{extra} ORDER BY object_id LIMIT 1000"
    )


@query(around_sql())
def bbox_near_object(spark: SparkSession, sf: str) -> DataFrame:
    loc = locations(spark, sf)
    return spatial.bbox_near_object(loc, NS, one_id(loc), 10.0, 8.0, 1000)


@query(around_sql(" AND z BETWEEN oz - 100.0::DOUBLE / 2 AND oz + 100.0::DOUBLE / 2"))
def bbox_3d_near_object(spark: SparkSession, sf: str) -> DataFrame:
    loc = locations(spark, sf)
    return spatial.bbox_3d_near_object(loc, NS, one_id(loc), 10.0, 8.0, 100.0, 1000)


@query(polygon_sql([]))
def polygon(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.polygon(locations(spark, sf), NS, FENCE, limit=1000)


@query(polygon_sql([HOLE]))
def polygon_with_hole(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.polygon(locations(spark, sf), NS, FENCE, [HOLE], limit=1000)


@query(
    f"SELECT key, min_x, min_y, max_x, max_y FROM zone_in WHERE namespace = '{NS}' AND min_x <= {BOX[2]}"
    f" AND max_x >= {BOX[0]} AND min_y <= {BOX[3]} AND max_y >= {BOX[1]}"
)
def zones_intersecting(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.zones_intersecting(table(spark, sf, "zone_in"), NS, *BOX).drop("data")


@query(
    f"WITH {LOC} SELECT DISTINCT l.namespace, l.object_id, z.key FROM loc l JOIN zone_in z ON l.namespace = z.namespace"
    " WHERE z.key IS NOT NULL AND l.x BETWEEN z.min_x AND z.max_x AND l.y BETWEEN z.min_y AND z.max_y"
)
def points_in_zones_join(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.points_in_boxes(locations(spark, sf), table(spark, sf, "zone_in"))


EDGES = """vertices AS (SELECT fence_id, namespace, ring, list_filter(pts, lambda p: p.x IS NOT NULL AND p.y IS NOT NULL) AS pts FROM (
  SELECT fence_id, namespace, 0 AS ring, exterior AS pts FROM polygon_in UNION ALL
  SELECT fence_id, namespace, generate_subscripts(interiors, 1) AS ring, unnest(interiors) AS pts FROM polygon_in)),
edges AS (SELECT fence_id, namespace, ring, unnest(list_transform(range(1, len(pts) + 1), lambda i:
  struct_pack(x1 := pts[i].x, y1 := pts[i].y, x2 := pts[i % len(pts) + 1].x, y2 := pts[i % len(pts) + 1].y)), recursive := true) FROM vertices),
sides AS (SELECT l.namespace, l.object_id, e.fence_id, e.ring,
    sum(CASE WHEN (y1 <= y AND y2 > y AND (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) > 0)
      OR (y2 <= y AND y1 > y AND (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) < 0) THEN 1 ELSE 0 END) % 2 = 1 AS inside,
    bool_or((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2)
      AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge
  FROM loc l JOIN edges e ON l.namespace = e.namespace GROUP BY ALL)"""
FENCED = """SELECT namespace, object_id, fence_id FROM sides GROUP BY ALL
  HAVING bool_or(ring = 0 AND inside AND NOT on_edge) AND NOT bool_or(ring > 0 AND (inside OR on_edge))"""


@query(f"WITH {LOC}, {EDGES} {FENCED}")
def points_in_fences_join(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.points_in_polygons(locations(spark, sf), table(spark, sf, "polygon_in"))


P1 = (
    f"WITH {LOC}, {EDGES} SELECT 'near' AS rel, a.namespace, a.object_id AS key_a, b.object_id AS key_b FROM loc a"
    " JOIN loc b ON a.namespace = b.namespace AND a.object_id < b.object_id"
    f" WHERE {hav3('a.x', 'a.y', 'a.z', 'b.x', 'b.y', 'b.z')} <= 50"
    " UNION ALL SELECT DISTINCT 'zone', l.namespace, l.object_id, z.key FROM loc l JOIN zone_in z ON l.namespace = z.namespace"
    " WHERE l.x BETWEEN z.min_x AND z.max_x AND l.y BETWEEN z.min_y AND z.max_y"
    f" UNION ALL SELECT 'fence', namespace, object_id, fence_id FROM ({FENCED})"
)

# --- history ----------------------------------------------------------------------------------------

GAUGE = ("gauges", "gauge:main-outfall")
START, END = 1_456_790_400.0, 1_457_395_200.0


def track_sql(extra: str, limit: int) -> str:
    return (
        "SELECT x, y, z, metadata, epoch_us(ts) AS ts_us, seq FROM (SELECT DISTINCT x, y, z, metadata, ts, seq FROM update_log"
        f" WHERE op = 'U' AND namespace = '{GAUGE[0]}' AND object_id = '{GAUGE[1]}' AND ts IS NOT NULL AND {OK} {extra})"
        f" ORDER BY ts DESC, seq DESC LIMIT {limit}"
    )


def _track(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query(track_sql(f"AND epoch_us(ts) BETWEEN {int(START * 1e6)} AND {int(END * 1e6)}", 100_000))
def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return _track(history.trajectory(feed(spark, sf), *GAUGE, START, END, 100_000))


@query(track_sql("", 10))
def trajectory_limit(spark: SparkSession, sf: str) -> DataFrame:
    return _track(history.trajectory(feed(spark, sf), *GAUGE, limit=10))


UPLOADED = """uploaded AS (SELECT namespace, object_id, p.x AS x, p.y AS y, p.ts AS ts FROM
  (SELECT namespace, object_id, unnest(points) AS p FROM trajectory_in)
  WHERE isfinite(p.x) AND isfinite(p.y) AND isfinite(p.ts) AND p.x BETWEEN -180 AND 180 AND p.y BETWEEN -90 AND 90 AND p.ts BETWEEN 0 AND 253402300799)"""


@query(
    f"WITH {UPLOADED} SELECT namespace, object_id, x, y, 0.0::DOUBLE AS z, '{{}}' AS metadata,"
    " round(ts * 1000000)::BIGINT AS ts_us FROM uploaded"
)
def insert_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """Uploaded batches as update rows."""
    up = history.uploads_to_updates(table(spark, sf, "trajectory_in"))
    return up.select("namespace", "object_id", "x", "y", "z", "metadata", F.unix_micros("ts").alias("ts_us"))


@query(
    f"WITH {UPLOADED} SELECT namespace, object_id, count(*) AS events FROM"
    " (SELECT DISTINCT namespace, object_id, x + 0.0 AS x, y + 0.0 AS y, ts FROM uploaded) GROUP BY ALL"
)
def trajectory_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = trajectory_events(table(spark, sf, "trajectory_in")).distinct()
    return events.groupBy("namespace", "object_id").agg(F.count("*").alias("events"))


# --- distances and measures -------------------------------------------------------------------------


def pair_sql(d: str, digits: int = 3) -> str:
    return f"WITH {LOC}, {ONE}, {TWO} SELECT round({d}, {digits}) AS distance FROM one, two"


def _between(metric: str, digits: int = 3) -> Query:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        loc = locations(spark, sf)
        d = spatial.distance_between(loc, NS, one_id(loc), one_id(loc, last=True), metric)
        return d.select(F.round("distance", digits).alias("distance"))

    return f


RHUMB = (
    "(WITH q AS (SELECT radians(oy) AS p1, radians(ty) AS p2, CASE WHEN radians(tx - ox) > pi() THEN radians(tx - ox) - 2 * pi()"
    " WHEN radians(tx - ox) < -pi() THEN radians(tx - ox) + 2 * pi() ELSE radians(tx - ox) END AS dl), s AS (SELECT *,"
    " ln(tan(pi() / 4 + p2 / 2) / tan(pi() / 4 + p1 / 2)) AS ds FROM q) SELECT sqrt(pow(p2 - p1, 2) + pow(CASE WHEN abs(ds) > 1e-11"
    f" THEN (p2 - p1) / ds ELSE cos(p1) END, 2) * dl * dl) * {R} FROM s)"
)
query(pair_sql(hav("ox", "oy", "tx", "ty")), "distance_between_haversine")(_between("haversine"))
query(pair_sql(RHUMB), "distance_between_rhumb")(_between("rhumb"))
query(pair_sql("sqrt(pow(tx - ox, 2) + pow(ty - oy, 2))", 9), "distance_between_euclidean")(_between("euclidean", 9))
FLAT, MAJOR = "(1 / 298.257223563)", "6378137.0"
#: One step of the inverse problem on the auxiliary sphere, and the length of the geodesic from its values.
GEODESIC_STEP = f"""sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
    sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs, atan2(ss, cs) AS s,
    CASE WHEN ss = 0 THEN 0.0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa, 1 - sa * sa AS c2a,
    CASE WHEN c2a < 1e-15 THEN 0.0 ELSE cs - 2 * sin(u1) * sin(u2) / c2a END AS c2m, {FLAT} / 16 * c2a * (4 + {FLAT} * (4 - 3 * c2a)) AS c"""
GEODESIC = f"""WITH RECURSIVE {LOC}, start AS (SELECT namespace, object_id, radians(x - ({X}) - 360 * floor((x - ({X}) + 180) / 360)) AS l,
    atan((1 - {FLAT}) * tan(radians({Y}))) AS u1, atan((1 - {FLAT}) * tan(radians(y))) AS u2 FROM loc),
  steps AS (SELECT *, l AS lam, 0 AS n FROM start UNION ALL
    SELECT namespace, object_id, l, u1, u2, l + (1 - c) * {FLAT} * sa * (s + c * ss * (c2m + c * cs * (-1 + 2 * c2m * c2m))) AS lam, n + 1 AS n
    FROM (SELECT *, {GEODESIC_STEP} FROM steps) WHERE n < 60),
  found AS (SELECT *, {GEODESIC_STEP}, c2a * (1 / pow(1 - {FLAT}, 2) - 1) AS k, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS ba,
    k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS bb FROM steps WHERE n = 60)
  SELECT namespace, object_id, round({MAJOR} * (1 - {FLAT}) * ba * (s - bb * ss * (c2m + bb / 4 * (cs * (-1 + 2 * c2m * c2m)
    - bb / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))), 2) AS distance FROM found"""


@query(GEODESIC)
def distance_geodesic(spark: SparkSession, sf: str) -> DataFrame:
    """Geodesics from one place to all locations (antipodes are tested by themselves)."""
    d = geodesic.geodesic_distance(X, Y, "x", "y")
    return locations(spark, sf).select("namespace", "object_id", F.round(d, 2).alias("distance"))


query(None, "distance_between_geodesic")(_between("geodesic"))


@query(f"WITH {LOC}, {ONE} SELECT round({hav('ox', 'oy', X, Y)}, 3) AS distance FROM one")
def distance_to(spark: SparkSession, sf: str) -> DataFrame:
    loc = locations(spark, sf)
    return rounded(spatial.distance_to(loc, NS, one_id(loc), X, Y))


@query(
    f"WITH {LOC} SELECT namespace, object_id, round({hav('x', 'y', X, Y)}, 3) AS horizontal, round(abs({Z} - z), 3) AS vertical,"
    f" round({hav3('x', 'y', 'z', X, Y, Z)}, 3) AS total, round(sqrt(pow({X} - x, 2) + pow({Y} - y, 2) + pow({Z} - z, 2)), 3) AS cartesian FROM loc"
)
def distance_components(spark: SparkSession, sf: str) -> DataFrame:
    c = geo.haversine_components("x", "y", "z", *CENTER)
    df = locations(spark, sf).select("namespace", "object_id", c.alias("c"), geo.cartesian_3d("x", "y", "z", *CENTER).alias("cartesian"))
    return rounded(df.select("namespace", "object_id", "c.*", "cartesian"), "horizontal", "vertical", "total", "cartesian")


@query(
    f"WITH {LOC} SELECT namespace, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM loc GROUP BY ALL"
)
def namespace_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.extent(locations(spark, sf))


@query(
    f"""WITH {LOC}, p AS (SELECT DISTINCT namespace, x, y FROM loc),
    e AS (SELECT a.namespace, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.namespace = b.namespace AND (a.x <> b.x OR a.y <> b.y))
    SELECT namespace, x1 AS x, y1 AS y FROM e JOIN p USING (namespace) GROUP BY namespace, x1, y1, x2, y2
    HAVING bool_and((x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) > 0 OR ((x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) = 0
      AND p.x BETWEEN least(x1, x2) AND greatest(x1, x2) AND p.y BETWEEN least(y1, y2) AND greatest(y1, y2)))"""
)
def convex_hull(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices of the hulls."""
    ring = geometry.convex_hull(locations(spark, sf)).select("namespace", F.explode("ring").alias("p"))
    return ring.select("namespace", "p.x", "p.y").distinct()


AREA = """WITH rings AS (SELECT namespace, fence_id, 0 AS ring, exterior AS pts FROM polygon_in UNION ALL
  SELECT namespace, fence_id, generate_subscripts(interiors, 1), unnest(interiors) FROM polygon_in),
areas AS (SELECT namespace, fence_id, ring, CASE WHEN len(pts) < 3 THEN 0 ELSE abs(list_sum(list_transform(range(1, len(pts) + 1), lambda i:
  radians(pts[i % len(pts) + 1].x - pts[(i + len(pts) - 2) % len(pts) + 1].x) * sin(radians(pts[i].y))))) * 6378137.0 * 6378137.0 / 2 END AS a FROM rings)
SELECT namespace, fence_id, round(sum(CASE WHEN ring = 0 THEN a ELSE -a END) / 100) AS area FROM areas GROUP BY ALL"""


@query(AREA)
def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    a = geo.polygon_area(F.col("exterior"), F.col("interiors"))
    return table(spark, sf, "polygon_in").groupBy("namespace", "fence_id").agg(F.round(F.sum(a) / 100).alias("area"))


@query()
def geodesic_area(spark: SparkSession, sf: str) -> DataFrame:
    a = geodesic.geodesic_polygon_area("exterior", "interiors")
    return table(spark, sf, "polygon_in").select("namespace", "fence_id", a.alias("area"))


@query(
    "SELECT key, round(min_x - dlon, 9) AS min_x, round(greatest(min_y - dlat, -90), 9) AS min_y, round(max_x + dlon, 9) AS max_x,"
    " round(least(max_y + dlat, 90), 9) AS max_y FROM (SELECT *, 2500.0 / 111000 AS dlat, 2500.0 / (111000 * cos(radians(least("
    "greatest(abs(min_y), abs(max_y)), 89.9)))) AS dlon FROM zone_in)"
)
def expand_bbox(spark: SparkSession, sf: str) -> DataFrame:
    grown = geo.expand_bbox("min_x", "min_y", "max_x", "max_y", 2500.0)
    out = table(spark, sf, "zone_in").select("key", grown.alias("b")).select("key", "b.*")
    return out.withColumns({k: F.round(k, 9) for k in ("min_x", "min_y", "max_x", "max_y")})


@query(
    "SELECT key, round((min_x + max_x) / 2, 9) AS center_x, round((min_y + max_y) / 2, 9) AS center_y,"
    " round(max_x - min_x, 9) AS width, round(max_y - min_y, 9) AS height FROM zone_in"
)
def bbox_measures(spark: SparkSession, sf: str) -> DataFrame:
    m = geo.bbox_measures("min_x", "min_y", "max_x", "max_y")
    out = table(spark, sf, "zone_in").select("key", m.alias("m")).select("key", "m.*")
    return out.withColumns({k: F.round(k, 9) for k in ("center_x", "center_y", "width", "height")})


# --- GeoJSON, namespaces, statistics, validation ----------------------------------------------------


@query(
    f"WITH {LOC} SELECT namespace, object_id, x, y, z, 'Point' AS kind FROM loc"
)
def geojson_point(spark: SparkSession, sf: str) -> DataFrame:
    """Positions written as GeoJSON and read back."""
    df = locations(spark, sf).select("namespace", "object_id", geojson.point("x", "y", "z").alias("text"))
    at = geojson.parse_point("text", default_z=True)
    kind = F.get_json_object("text", "$.type").alias("kind")
    return df.select("namespace", "object_id", *[at[k].alias(k) for k in "xyz"], kind)


@query(
    f"WITH {LOC} SELECT namespace, count(*) OVER (PARTITION BY namespace) AS features, object_id, x, y, 'Feature' AS kind FROM loc"
)
def feature_collection(spark: SparkSession, sf: str) -> DataFrame:
    """One collection per namespace, read back feature by feature."""
    props = F.create_map(F.lit("id"), F.col("object_id"))
    got = geojson.feature_collections(locations(spark, sf), ["namespace"], props)
    schema = "type string, features array<struct<type:string,geometry:struct<coordinates:array<double>>,properties:map<string,string>>>"
    f = got.select("namespace", F.col("features").cast("bigint").alias("features"), F.explode(F.from_json("geojson", schema)["features"]).alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.select("namespace", "features", F.col("f.properties")["id"].alias("object_id"), at[0].alias("x"), at[1].alias("y"), F.col("f.type").alias("kind"))


@query(
    """SELECT fence_id, len(exterior) AS exterior_points, coalesce(len(interiors), 0) AS holes,
    round(list_sum(list_transform(exterior, lambda p: p.x + 2 * p.y)), 6) AS outer_sum,
    round(coalesce(list_sum(list_transform(interiors, lambda r: list_sum(list_transform(r, lambda p: p.x + 2 * p.y)))), 0.0), 6) AS inner_sum
    FROM polygon_in"""
)
def geojson_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons written as GeoJSON and read back."""
    df = table(spark, sf, "polygon_in").select(
        "fence_id", geojson.parse_polygon(geojson.polygon(F.col("exterior"), F.col("interiors"))).alias("p")
    )
    size = lambda c: F.size(c).cast("bigint")
    total = lambda ring: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["x"] + 2 * p["y"])
    holes = F.aggregate("p.interiors", F.lit(0.0), lambda a, r: a + total(r))
    return df.select(
        "fence_id", size("p.exterior").alias("exterior_points"), size("p.interiors").alias("holes"),
        F.round(total(F.col("p.exterior")), 6).alias("outer_sum"), F.round(holes, 6).alias("inner_sum"),
    )


@query(f"WITH {LOC} SELECT DISTINCT namespace FROM loc")
def namespace_list(spark: SparkSession, sf: str) -> DataFrame:
    keyed = locations(spark, sf).select(namespaces.key(F.col("namespace"), F.col("object_id")).alias("k"))
    return namespaces.extract_namespaces(keyed, "k")


@query(f"WITH {LOC} SELECT namespace, count(*) AS objects FROM loc GROUP BY ALL")
def namespace_counts(spark: SparkSession, sf: str) -> DataFrame:
    return namespaces.counts(locations(spark, sf))


@query(
    "SELECT namespace || '::' || object_id AS k, namespace, substr(namespace || '::' || object_id, length(namespace) + 3) AS object_id,"
    f" namespace = '{NS}' AS owned FROM update_log WHERE namespace IS NOT NULL AND object_id IS NOT NULL AND NOT contains(namespace, '::')"
)
def parse_key(spark: SparkSession, sf: str) -> DataFrame:
    f = feed(spark, sf).where(F.col("namespace").isNotNull() & F.col("object_id").isNotNull())
    keyed = f.where(~F.col("namespace").contains("::")).select(namespaces.key(F.col("namespace"), F.col("object_id")).alias("k"))
    parts = namespaces.parse_key("k")
    return keyed.select("k", parts["namespace"].alias("namespace"), parts["object_id"].alias("object_id"), namespaces.owns_key(NS, "k").alias("owned"))


@query(
    f"WITH {state()}, per AS (SELECT count(*) AS n FROM applied WHERE op = 'U' GROUP BY namespace, object_id) SELECT 0::BIGINT AS expired,"
    " (SELECT sum(n) FROM per)::BIGINT AS operations, (SELECT count(*) FROM state) AS objects, (SELECT count(*) FROM per) AS trajectories,"
    " (SELECT count(*) FROM state) * 200 AS hot_bytes, (SELECT sum(least(n, 100)) FROM per)::BIGINT * 100 AS cold_bytes,"
    " (SELECT count(*) FROM state) * 200 + (SELECT sum(least(n, 100)) FROM per)::BIGINT * 100 AS total_bytes"
)
def stats(spark: SparkSession, sf: str) -> DataFrame:
    f = feed(spark, sf)
    good, _ = validate.quarantine(f.where(F.col("seq").isNotNull()))
    rows = good.select("namespace", "object_id", "op", "seq").distinct()  # redelivered records
    return counters.stats(rows, replay(f, payload=()))


@query(
    "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(namespace <> '' AND NOT regexp_matches(namespace, '[|\\n\\r]|::'), false)"
    " THEN 'namespace' WHEN NOT coalesce(object_id <> '' AND NOT regexp_matches(object_id, '[|\\n\\r]|::'), false) THEN 'object_id'"
    f" WHEN op = 'U' AND NOT coalesce({OK}, false) THEN 'position' WHEN op = 'U' AND ts IS NULL THEN 'timestamp'"
    " WHEN NOT coalesce(op IN ('U', 'T'), false) THEN 'op' END AS problem FROM update_log) WHERE problem IS NOT NULL GROUP BY ALL"
)
def validation_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = validate.quarantine(feed(spark, sf))
    return bad.groupBy("problem").agg(F.count("*").alias("n"))


# --- index tables, files, streams -------------------------------------------------------------------


@query(f"WITH {LOC} SELECT count(DISTINCT namespace) AS namespaces, count(*) AS points FROM loc")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return index.index_stats(locations(spark, sf))


@query(f"WITH {LOC} SELECT x, y FROM loc WHERE namespace = '{NS}'")
def namespace_points(spark: SparkSession, sf: str) -> DataFrame:
    return index.namespace_points(locations(spark, sf), NS)


@query(
    f"WITH {LOC} SELECT namespace, object_id, x, y FROM loc WHERE (namespace, object_id) NOT IN"
    " (SELECT (namespace, object_id) FROM update_log WHERE namespace IS NOT NULL AND object_id IS NOT NULL)"
)
def remove_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Index entries without the objects of the change feed."""
    return index.remove(locations(spark, sf), feed(spark, sf)).select("namespace", "object_id", "x", "y")


@query(
    f"WITH {LOC} SELECT object_id, round({hav('x', 'y', X, Y)}, 3) AS distance FROM loc WHERE namespace = '{NS}'"
    f" ORDER BY {hav('x', 'y', X, Y)}, object_id LIMIT 20"
)
def knn_by_metric(spark: SparkSession, sf: str) -> DataFrame:
    got = spatial.knn_metric(spatial.of_namespace(locations(spark, sf), NS), CENTER[:2], 20)
    return rounded(got.select("object_id", "distance"))


@query(
    f"WITH {LOC}, probe AS ({ZONE_CENTERS}), near AS (SELECT p.namespace, p.key, px, py, l.object_id AS neighbor_id,"
    f" {hav3('p.px', 'p.py', '0.0', 'l.x', 'l.y', 'l.z')} AS d FROM probe p JOIN loc l ON p.namespace = l.namespace)"
    " SELECT namespace, key, neighbor_id, round(d, 3) AS distance FROM near"
    " QUALIFY row_number() OVER (PARTITION BY namespace, key, px, py ORDER BY d, neighbor_id) <= 5"
)
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest objects of the centre of every zone."""
    z = table(spark, sf, "zone_in").where(F.col("key").isNotNull())
    z = z.where((F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")))
    mid = lambda k: ((F.col(f"min_{k}") + F.col(f"max_{k}")) / 2).alias(k)
    probes = z.select("namespace", "key", mid("x"), mid("y"), F.lit(0.0).alias("z")).distinct()
    probes = probes.withColumn("probe_id", F.struct("namespace", "key", "x", "y"))
    got = batch.knn_join(locations(spark, sf), probes, 5, start_radius=20_000.0, growth=16.0)
    return rounded(got.select("namespace", "probe_id.key", "neighbor_id", "distance"))


@query(
    f"WITH {APPLIED} SELECT namespace, object_id, op, count(*) AS n, sum(coalesce(epoch_us(ts), 0) % 1000003)::BIGINT AS checksum,"
    " round(sum(x), 1) AS sum_x, round(sum(y), 1) AS sum_y, round(sum(z), 1) AS sum_z,"
    " sum(CASE WHEN op = 'U' AND json_valid(metadata) AND metadata <> 'null' THEN 1 ELSE 0 END)::BIGINT AS with_json"
    " FROM applied WHERE NOT regexp_matches(namespace, '[|\\n\\r]|::') GROUP BY ALL"
)
def log_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The applicable records written as a text log and read back."""
    key = ["namespace", "object_id"]
    good, _ = validate.quarantine(feed(spark, sf).where(F.col("seq").isNotNull()))
    folder = shared_folder(spark)
    logio.write_log(good.select(*key, "op", "seq", "ts", "x", "y", "z", "metadata").distinct(), folder)
    back = logio.read_log(spark, folder)
    json = F.coalesce((F.col("metadata") != "null").cast("bigint"), F.lit(0))
    sums = [F.round(F.sum(k), 1).alias(f"sum_{k}") for k in "xyz"]
    return back.groupBy(*key, "op").agg(
        F.count("*").alias("n"), F.sum(F.unix_micros("ts") % 1000003).alias("checksum"), *sums, F.sum(json).alias("with_json")
    )


@query(
    f"WITH {APPLIED} SELECT namespace, object_id, seq, x, y FROM applied WHERE op = 'U'"
    " QUALIFY row_number() OVER (PARTITION BY namespace, object_id ORDER BY ts DESC, seq DESC) = 1"
)
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream: latest U record per object, kept by a stateful aggregation."""
    schema = feed(spark, sf).schema
    folder = shared_folder(spark)
    # a pattern, since a stream's path may otherwise not be a single file
    stream = spark.readStream.schema(schema).parquet(f"{sf}/update_log.parque[t]")

    def keep(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/state")

    writer = latest.latest_state(stream).writeStream.outputMode("complete").foreachBatch(keep)
    writer.trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").start().awaitTermination()
    return spark.read.parquet(f"{folder}/state").select("namespace", "object_id", "seq", "x", "y")
