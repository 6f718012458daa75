"""The queries of the data-processing problems 1 to 6, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.plans import reference
from driftline.operators import change_feed, proximity, resample, runs, spikes, stops
from driftline.sources.tables import table

KEY = ["namespace", "object_id"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.relations(
        table(spark, sf, "point_in"), table(spark, sf, "zone_in"), table(spark, sf, "polygon_in"), radius=50.0
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return change_feed.replay(table(spark, sf, "update_log"), payload=()).select(*KEY, "seq")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    feed = table(spark, sf, "update_log").where(F.col("namespace").isin("drones", "buoys"))
    return spikes.flag_readings(feed).select(*KEY, "seq")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return resample.unfilled_slots(table(spark, sf, "update_log"), table(spark, sf, "grid_spec"))


def p4_series(spark: SparkSession, sf: str) -> DataFrame:
    s = resample.regular_series(table(spark, sf, "update_log"), table(spark, sf, "grid_spec"))
    return s.withColumns({k: F.round(k, 6) for k in "xyz"})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    got = runs.collapse_runs(runs.trajectory_events(table(spark, sf, "trajectory_in")))
    ms = lambda k: F.round(F.col(k) * 1000).cast("bigint")
    return got.where(F.col("n") >= 2).select(*KEY, ms("start_ts").alias("start_ms"), ms("end_ts").alias("end_ms"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    feed = table(spark, sf, "update_log").where(F.col("namespace") == "couriers")
    return stops.stops_and_trips(stops.pings(feed)).select(*KEY, "kind", "start_seq", "end_seq")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_series": p4_series,
    "p5_found": p5_found,
    "p6_found": p6_found,
}

HAV = reference.hav("a.x", "a.y", "b.x", "b.y")
#: Events of p5 numbered per object, and for each the event that begins the next run if it begins one itself.
P5 = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY namespace, object_id ORDER BY ts, x, y) AS i,
      ts - lag(ts) OVER (PARTITION BY namespace, object_id ORDER BY ts, x, y) > 1800 AS late FROM
      (SELECT DISTINCT namespace, object_id, p.x + 0.0 AS x, p.y + 0.0 AS y, p.ts AS ts FROM (SELECT namespace, object_id, unnest(points) AS p FROM trajectory_in)
       WHERE namespace IS NOT NULL AND object_id IS NOT NULL AND isfinite(p.x) AND isfinite(p.y) AND isfinite(p.ts)
         AND p.x BETWEEN -180 AND 180 AND p.y BETWEEN -90 AND 90 AND p.ts >= 0)),
    ends AS (SELECT namespace, object_id, max(i) + 1 AS stop FROM e GROUP BY ALL),
    nxt AS (SELECT a.namespace, a.object_id, a.i, min(b.i) AS j FROM e a JOIN e b ON a.namespace = b.namespace AND a.object_id = b.object_id AND b.i > a.i
      WHERE b.late OR {HAV} > 10 GROUP BY ALL),
    steps AS (SELECT e.namespace, e.object_id, e.i, coalesce(nxt.j, stop) AS j FROM e JOIN ends USING (namespace, object_id) LEFT JOIN nxt USING (namespace, object_id, i)),
    runs AS (SELECT * FROM steps WHERE i = 1 UNION ALL SELECT s.* FROM runs r JOIN steps s ON r.namespace = s.namespace AND r.object_id = s.object_id AND s.i = r.j)
    SELECT r.namespace, r.object_id, round(a.ts * 1000)::BIGINT AS start_ms, round(b.ts * 1000)::BIGINT AS end_ms FROM runs r
    JOIN e a ON r.namespace = a.namespace AND r.object_id = a.object_id AND r.i = a.i
    JOIN e b ON r.namespace = b.namespace AND r.object_id = b.object_id AND r.j - 1 = b.i WHERE r.j - r.i >= 2"""
#: Pings of p6 numbered per object; for each the first of three in a row that are elsewhere, and whether a stop begins there.
P6 = f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY us, seq) AS i FROM
      (SELECT object_id, epoch_us(ts) AS us, seq, any_value(x) AS x, any_value(y) AS y FROM update_log WHERE namespace = 'couriers' AND op = 'U' AND ts IS NOT NULL
       AND seq IS NOT NULL AND object_id IS NOT NULL AND {reference.OK} GROUP BY ALL)),
    far AS (SELECT a.object_id, a.i, b.i AS j, a.us AS us0, b.us, {HAV} > 100 AS away FROM p a JOIN p b ON a.object_id = b.object_id AND b.i > a.i),
    three AS (SELECT *, away AND coalesce(lead(away, 1) OVER w, false) AND coalesce(lead(away, 2) OVER w, false) AS gone FROM far
      WINDOW w AS (PARTITION BY object_id, i ORDER BY j)),
    left_at AS (SELECT object_id, i, min(j) AS k FROM three WHERE gone GROUP BY ALL),
    stay AS (SELECT object_id, i, max(j) AS e, max(us) - any_value(us0) AS lasted FROM far LEFT JOIN left_at USING (object_id, i)
      WHERE NOT away AND j < coalesce(k, 9223372036854775807) GROUP BY ALL),
    begins AS (SELECT object_id, i, e FROM stay WHERE lasted >= 300000000),
    nxt AS (SELECT p.object_id, p.i AS from_i, min(b.i) AS i FROM p JOIN begins b ON p.object_id = b.object_id AND b.i >= p.i GROUP BY ALL),
    stops AS (SELECT b.* FROM nxt n JOIN begins b USING (object_id, i) WHERE n.from_i = 1
      UNION ALL SELECT b.* FROM stops s JOIN nxt n ON n.object_id = s.object_id AND n.from_i = s.e + 1 JOIN begins b ON b.object_id = n.object_id AND b.i = n.i),
    named AS (SELECT s.object_id, s.i, a.seq AS start_seq, b.seq AS end_seq, lead(a.seq) OVER (PARTITION BY s.object_id ORDER BY s.i) AS next_seq FROM stops s
      JOIN p a ON a.object_id = s.object_id AND a.i = s.i JOIN p b ON b.object_id = s.object_id AND b.i = s.e)
    SELECT 'couriers' AS namespace, object_id, 'stop' AS kind, start_seq, end_seq FROM named
    UNION ALL SELECT 'couriers', object_id, 'trip', end_seq, next_seq FROM named WHERE next_seq IS NOT NULL"""


def _series_sql() -> str:
    """Slots, their neighbours, the slopes of the monotone cubic and its values in the gaps."""
    slope = lambda hp, hn, dp, dn: (
        f"CASE WHEN ({dp}) * ({dn}) <= 0 THEN 0.0 ELSE ((2 * {hn} + {hp}) + ({hn} + 2 * {hp})) / ((2 * {hn} + {hp}) / ({dp}) + ({hn} + 2 * {hp}) / ({dn})) END"
    )

    def end(h0: str, h1: str, d0: str, d1: str) -> str:
        m = f"(((2 * {h0} + {h1}) * ({d0}) - {h0} * ({d1})) / ({h0} + {h1}))"
        return f"CASE WHEN {m} * ({d0}) <= 0 THEN 0.0 WHEN ({d0}) * ({d1}) <= 0 AND abs({m}) > 3 * abs({d0}) THEN 3 * ({d0}) ELSE {m} END"

    cols, values = [], []
    for k in "xyz":
        d, dp, dn = f"(n_{k} - {k}) / hc", f"({k} - p_{k}) / hp", f"(m_{k} - n_{k}) / hn"
        cols.append(f"CASE WHEN hp IS NULL AND hn IS NULL THEN {d} WHEN hp IS NULL THEN {end('hc', 'hn', d, dn)} ELSE {slope('hp', 'hc', dp, d)} END AS s0_{k}")
        cols.append(f"CASE WHEN hp IS NULL AND hn IS NULL THEN {d} WHEN hn IS NULL THEN {end('hc', 'hp', d, dp)} ELSE {slope('hc', 'hn', d, dn)} END AS s1_{k}")
        values.append(
            f"CASE WHEN short THEN round((1 + 2 * s) * (1 - s) * (1 - s) * {k} + s * (1 - s) * (1 - s) * hc * s0_{k}"
            f" + s * s * (3 - 2 * s) * n_{k} + s * s * (s - 1) * hc * s1_{k}, 6) END AS {k}"
        )
    near = ", ".join(f"lag({k}) OVER w AS p_{k}, lead({k}) OVER w AS n_{k}, lead({k}, 2) OVER w AS m_{k}" for k in ("t", "x", "y", "z"))
    return f"""WITH filled AS (SELECT u.namespace, u.object_id, g.period_s::BIGINT AS p, (epoch_us(u.ts) // (g.period_s * 1000000)) * g.period_s AS slot,
        epoch_us(u.ts) / 1e6 AS t, x, y, z FROM update_log u JOIN grid_spec g ON u.namespace = g.namespace WHERE op = 'U' AND ts IS NOT NULL AND object_id IS NOT NULL
        AND {reference.OK} QUALIFY row_number() OVER (PARTITION BY u.namespace, u.object_id, (epoch_us(u.ts) // (g.period_s * 1000000)) ORDER BY u.ts DESC, seq DESC NULLS LAST) = 1),
      near AS (SELECT *, lead(slot) OVER w AS n_slot, {near} FROM filled WINDOW w AS (PARTITION BY namespace, object_id ORDER BY slot)),
      steps AS (SELECT *, n_t - t AS hc, t - p_t AS hp, m_t - n_t AS hn FROM near WHERE n_slot IS NOT NULL),
      gaps AS (SELECT *, {", ".join(cols)} FROM steps WHERE n_slot > slot + p),
      empty AS (SELECT *, unnest(range(slot + p, n_slot, p)) AS slot_start FROM gaps),
      placed AS (SELECT *, (slot_start - t) / hc AS s, (n_slot - slot) / p - 1 <= 6 AND abs(n_x - x) <= 180 AS short FROM empty)
      SELECT namespace, object_id, slot::BIGINT AS slot_start, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, 'reading' AS status FROM filled
      UNION ALL SELECT namespace, object_id, slot_start::BIGINT, {", ".join(values)}, CASE WHEN short THEN 'filled' ELSE 'missing' END FROM placed"""


#: p3 rests on medians and least squares per source: tested against planted cases instead.
ORACLE = {
    "p1_found": reference.P1,
    "p4_series": _series_sql(),
    "p5_found": P5,
    "p6_found": P6,
    "p2_found": f"WITH {reference.state()} SELECT namespace, object_id, seq FROM state",
    "p4_found": f"""WITH slots AS (SELECT DISTINCT u.namespace, u.object_id, g.period_s::BIGINT AS p,
        (epoch_us(u.ts) // (g.period_s * 1000000)) * g.period_s AS slot FROM update_log u JOIN grid_spec g ON u.namespace = g.namespace
        WHERE op = 'U' AND ts IS NOT NULL AND object_id IS NOT NULL AND {reference.OK}),
      gaps AS (SELECT *, lead(slot) OVER (PARTITION BY namespace, object_id ORDER BY slot) AS nxt FROM slots)
      SELECT namespace, object_id, unnest(range(slot + p, nxt, p))::BIGINT AS slot_start FROM gaps WHERE nxt > slot + p""",
}
