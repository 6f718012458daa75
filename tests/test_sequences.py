"""Runs, stops, spikes and regular grids against plain versions, with shards small enough to cut objects apart."""

import random
import time

import brute
import numpy as np
import pytest
from helpers import log_frame, tuples
from pyspark.sql import functions as F

from driftline.operators import ordered, resample, runs, spikes, stops

BATCHES = "namespace string, object_id string, points array<struct<x:double,y:double,ts:double>>"


def events_frame(spark, rows):
    """(object, x, y, ts) -> uploaded batches of a few elements each."""
    by = {}
    for o, x, y, t in rows:
        by.setdefault(o, []).append({"x": x, "y": y, "ts": t})
    data = [("n", o, v[i : i + 7]) for o, v in by.items() for i in range(0, len(v), 7)]
    return spark.createDataFrame([*data, ("n", "none", None), ("n", "empty", []), (None, "x", [{"x": 1.0, "y": 1.0, "ts": 1.0}])], BATCHES)


def walk(seed, n=600, parked=0.7):
    """Mostly parked objects with jitter around the run distance, some moves, silences and repeats."""
    rnd, out = random.Random(seed), []
    for o in ("hot", "b", "c"):
        x, y, t = 10.0, 50.0, 1000.0
        for _ in range(n if o == "hot" else 40):
            t += rnd.choice([1, 30, 60, 1800, 1801, 4000]) if rnd.random() < 0.1 else rnd.uniform(1, 60)
            if rnd.random() > parked:
                x += rnd.uniform(-1, 1) * rnd.choice([1e-4, 1e-3])
            jitter = rnd.choice([0.0, 4e-5, 8e-5])
            out.append((o, x + rnd.uniform(-jitter, jitter), y + rnd.uniform(-jitter, jitter), round(t, 3)))
    return out + rnd.sample(out, 50)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("rows", "parked"), [(17, 0.7), (60, 1.0), (100_000, 0.7)])
def test_runs_equal_brute_force(spark, seed, rows, parked):
    ev = walk(seed, parked=parked)
    got = runs.collapse_runs(runs.trajectory_events(events_frame(spark, ev)), rows_per_shard=rows, bin_s=60.0)
    want = brute.runs([(("n", o), x, y, t) for o, x, y, t in ev])
    assert sorted(tuples(got, "object_id", "start_ts", "end_ts", "n")) == sorted((k[1], a, b, n) for k, a, b, n in want)


def test_runs_of_one_endless_stay(spark):
    ev = [("p", 1.0, 1.0, float(i)) for i in range(500)]
    got = runs.collapse_runs(runs.trajectory_events(events_frame(spark, ev)), rows_per_shard=40, bin_s=20.0)
    assert tuples(got, "start_ts", "end_ts", "n", "duration_s") == [(0.0, 499.0, 500, 499.0)]


def test_unusable_elements_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    ev = [("a", 1.0, 1.0, 5.0), ("a", 1.0, 1.0, -1.0), ("a", nan, 1.0, 6.0), ("a", 1.0, inf, 6.0), ("a", 181.0, 1.0, 6.0), ("a", None, 1.0, 6.0), ("a", 1.0, 1.0, None), ("a", 1.0, 1.0, nan)]
    assert tuples(runs.trajectory_events(events_frame(spark, ev)), "x", "y", "ts") == [(1.0, 1.0, 5.0)]
    assert runs.collapse_runs(runs.trajectory_events(spark.createDataFrame([], BATCHES))).collect() == []


def courier(seed, n=500):
    rnd, out, seq = random.Random(seed), [], 0
    for o in ("hot", "b", "c"):
        x, y, t = 10.0, 50.0, 0
        for _ in range(n if o == "hot" else 60):
            mode = rnd.random()
            for _ in range(rnd.randrange(1, 12)):
                t += rnd.choice([20, 30, 60, 90, 4000 if rnd.random() < 0.05 else 45]) * 1_000_000
                if mode < 0.5:
                    x += rnd.uniform(0.001, 0.005)
                away = rnd.uniform(0.01, 0.02) if rnd.random() < 0.08 else 0.0
                seq += 1
                out.append(("couriers", o, "U", seq, t, x + rnd.uniform(-6e-4, 6e-4) + away, y, 0.0))
            if len(out) > 4 * n:
                break
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rows", [13, 150, 100_000])
def test_stops_equal_brute_force(spark, seed, rows):
    feed = courier(seed)
    got = stops.stops_and_trips(stops.pings(log_frame(spark, feed + feed[:40])), rows_per_shard=rows, bin_s=rows * 10.0)
    want = []
    for o in ("hot", "b", "c"):
        st = brute.stops(sorted((r[4], r[3], r[5], r[6]) for r in feed if r[1] == o))
        want += [(o, "stop", a, b) for a, b in st] + [(o, "trip", p[1], q[0]) for p, q in zip(st, st[1:])]
    assert len(want) > 10
    assert sorted(tuples(got, "object_id", "kind", "start_seq", "end_seq")) == sorted(want)


def test_trip_distance_and_duration_do_not_depend_on_the_shards(spark):
    feed = courier(5, 120)
    cols = ["object_id", "kind", "start_seq", F.round("distance_m", 3), "duration_s", "pings"]
    one, many = (sorted(stops.stops_and_trips(stops.pings(log_frame(spark, feed)), rows_per_shard=n, bin_s=120.0).select(*cols).collect(), key=str) for n in (100_000, 11))
    assert one == many
    by = {r[3]: r for r in feed}
    trip = next(r for r in one if r.kind == "trip")
    got = stops.stops_and_trips(stops.pings(log_frame(spark, feed))).where((F.col("kind") == "trip") & (F.col("start_seq") == trip.start_seq) & (F.col("object_id") == trip.object_id)).first()
    path = sorted((r for r in feed if r[1] == got.object_id and by[got.start_seq][4] <= r[4] <= by[got.end_seq][4]), key=lambda r: r[4])
    assert got.distance_m == pytest.approx(sum(brute.meters(a[5], a[6], b[5], b[6]) for a, b in zip(path, path[1:])), abs=0.01)


def test_no_pings(spark):
    assert stops.stops_and_trips(stops.pings(log_frame(spark, []))).collect() == []
    nulls = [("n", None, "U", 1, 1, 1.0, 1.0, 0.0), ("n", "a", "U", 2, None, 1.0, 1.0, 0.0), ("n", "a", "T", 3, 1, None, None, None)]
    assert stops.stops_and_trips(stops.pings(log_frame(spark, nulls))).collect() == []


def track(seed, n, o="d"):
    """A noisy moving source with planted spikes and a stuck run; gives the rows and the wrong seqs."""
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(2, 6, n))
    x, y, z = 10 + np.cumsum(rng.normal(2e-5, 1e-5, n)), 50 + np.cumsum(rng.normal(1e-5, 1e-5, n)), 300 + np.cumsum(rng.normal(0, 0.5, n))
    x[n // 2 + 25 :] += 0.01  # a lasting move
    wrong = set()
    for at in range(40, n - 40, 60):
        size = 1 + at % 3
        if at % 2:
            z[at : at + size] += 90
        else:
            y[at : at + size] += 0.01
        wrong |= set(range(at, at + size))
    s = n // 3 + 7
    s += next(k for k in range(60) if not wrong & set(range(s + k - 3, s + k + 15)))
    x[s : s + 9], y[s : s + 9], z[s : s + 9] = x[s], y[s], z[s]
    wrong |= set(range(s, s + 9))
    x[5], y[5], z[5] = 0, 0, 0
    x[9] = np.nan
    wrong |= {5, 9}
    rows = [("drones", o, "U", i, int(t[i] * 1e6), float(x[i]), float(y[i]), float(z[i])) for i in range(n)]
    return rows, wrong


@pytest.mark.parametrize("shard_rows", [300, 50_000])
def test_planted_wrong_readings(spark, shard_rows):
    rows, wrong = track(1, 2000)
    feed = log_frame(spark, rows + rows[:100])
    got = tuples(spikes.flag_readings(feed, shard_rows=shard_rows), "seq")
    assert len(got) == len(set(got))
    assert {s for (s,) in got} == wrong


def test_a_busy_source_is_judged_as_a_whole(spark):
    """Stuck runs longer than a shard, calm stretches and stretches of repeats among lively ones, equal times and copies."""
    feed, n = [], 2400
    for o, seed in (("a", 1), ("b", 2), ("c", 3)):
        rng = np.random.default_rng(seed)
        rows = [list(r) for r in track(seed, n, o)[0]]
        for i, noise in enumerate(rng.normal(0, 3e-5, n)):
            rows[i][3] += seed * 10_000
            rows[i][5] += float(noise) if not 300 <= i < 700 else 0.0  # a calm stretch
        rows[450][6] += 4e-4  # far for the calm stretch only
        a, b = {"a": (900, 1900), "b": (1195, 1206), "c": (2100, n)}[o]
        for r in rows[a + 1 : b]:
            r[5:8] = rows[a][5:8]
        if o != "a":  # repeats now and then, in one stretch most of the time: below the habit over all readings for b only
            for i in range(720, 1100 if o == "b" else 2050):
                if i % 3:
                    rows[i][5:8] = rows[i - 1][5:8]
        rows[1901][4], rows[600][4] = rows[1900][4], rows[599][4]
        feed += [tuple(r) for r in rows]
    got = {}
    for shard_rows in (50_000, 200, 61):
        res = spikes.flag_readings(log_frame(spark, feed + feed[1000:1100]), shard_rows=shard_rows)
        got[shard_rows] = sorted(tuples(res, "object_id", "seq", "ts", "reason"), key=str)
    stuck = {o: sum(r[0] == o and r[3] == "stuck" for r in got[50_000]) for o in "abc"}
    assert stuck["a"] >= 1000
    assert stuck["b"] >= 11
    assert stuck["c"] == 0
    assert got[200] == got[50_000]
    assert got[61] == got[50_000]


def test_sources_that_repeat_themselves_and_edge_cases(spark):
    still = [("buoys", "still", "U", i, i * 10**6, 1.0, 2.0, float(i // 9 % 2)) for i in range(100)]
    few = [("buoys", "few", "U", 1000 + i, i * 10**6, 1.0, 2.0, 3.0) for i in range(3)]
    odd = [
        ("buoys", "odd", "U", 2000, None, 1.5, 2.0, 3.0), ("buoys", "odd", "U", 2001, None, None, 2.0, 3.0),
        ("buoys", None, "U", 2002, 1, None, 2.0, 3.0), ("buoys", "odd", "T", 2003, 1, None, None, None), ("buoys", "odd", "U", 2004, 1, 0.0, 0.0, 9.0),
    ]
    got = sorted(tuples(spikes.flag_readings(log_frame(spark, still + few + odd)), "seq", "reason"))
    assert got == [(2001, "limit"), (2004, "placeholder")]
    assert spikes.flag_readings(log_frame(spark, [])).collect() == []


def _group_size(*_):
    def f(pdf):
        return pdf.head(1).assign(seq=len(pdf), reason="size")[["namespace", "object_id", "seq", "us", "reason"]]

    return f


def test_copies_and_readings_without_time_stay_out_of_the_groups(spark, monkeypatch):
    """One record delivered very often, or very many without a time, must not swell a shard or a group."""
    given = []
    for module in (runs, stops):
        real = module.time_shards
        monkeypatch.setattr(module, "time_shards", lambda df, *a, real=real, **k: given.append(df.count()) or real(df, *a, **k))
    ev = [("a", 1.0, 1.0, float(t)) for t in range(20)] + [("a", 1.0, 1.0, 7.0)] * 500
    assert tuples(runs.collapse_runs(runs.trajectory_events(events_frame(spark, ev))), "n") == [(20,)]
    pings = [("couriers", "a", "U", i, i * 60 * 10**6, 1.0, 1.0, 0.0) for i in range(20)]
    feed = log_frame(spark, pings + pings[7:8] * 500)
    assert tuples(stops.stops_and_trips(stops.pings(feed)), "start_seq", "end_seq", "pings") == [(0, 19, 20)]
    assert given == [20, 20]

    timeless = [("couriers", "a", "U", 100 + i, None, 1.0, 2.0 if i else 95.0, 0.0) for i in range(300)]
    pings = [(*p[:6], 2.0, 0.0) for p in pings]
    monkeypatch.setattr(spikes, "_judge_group", _group_size)
    got = tuples(spikes.flag_readings(log_frame(spark, pings + pings[7:8] * 500 + timeless)), "seq", "reason")
    assert sorted(got) == [(20, "size"), (100, "limit")]


def spec(spark):
    return spark.createDataFrame([("gauges", 60), ("collars", 900), ("gauges", 60), ("off", 0), (None, 5)], "namespace string, period_s int")


@pytest.mark.parametrize("shard_slots", [3, 4096])
@pytest.mark.parametrize("seed", range(2))
def test_unfilled_slots_equal_brute_force(spark, seed, shard_slots):
    rnd, rows = random.Random(seed), []
    for i in range(500):
        ns, o = rnd.choice([("gauges", "hot"), ("gauges", "b"), ("collars", "hot"), ("off", "x"), ("other", "y"), ("gauges", None)])
        us = rnd.choice([None, rnd.randrange(-(10**9), 40 * 10**9)]) if rnd.random() < 0.1 else rnd.randrange(0, 20 * 10**9)
        rows.append((ns, o, "T" if rnd.random() < 0.05 else "U", i, us, rnd.choice([1.0, 2.0, None, 999.0]), 1.0, 1.0))
    got = tuples(resample.unfilled_slots(log_frame(spark, rows), spec(spark), shard_slots), "namespace", "object_id", "slot_start")
    names = ["namespace", "object_id", "op", "seq", "ts_us", "x", "y", "z"]
    assert len(got) == len(set(got))
    assert set(got) == brute.unfilled([dict(zip(names, r, strict=True)) for r in rows], {"gauges": 60, "collars": 900})


def test_unfilled_slots_run_the_interpolation(spark, monkeypatch):
    """The periods come from the series itself: a fill that gives no number must not pass unnoticed."""
    rows = [("gauges", "g", "U", i, s * 60 * 10**6, 1.0, 2.0, float(s)) for i, s in enumerate((0, 1, 4, 5))]
    assert sorted(tuples(resample.unfilled_slots(log_frame(spark, rows), spec(spark)), "slot_start")) == [(120,), (180,)]
    monkeypatch.setattr(resample, "_slope", lambda *_: F.lit(float("nan")))
    with pytest.raises(Exception, match="filled slot without a value"):
        resample.unfilled_slots(log_frame(spark, rows), spec(spark)).collect()


def pchip(ts, vs, at):
    """Monotone cubic at ``at`` by the textbook formulas."""
    h, d = np.diff(ts), np.diff(vs) / np.diff(ts)
    m = np.zeros(len(ts))
    for i in range(1, len(ts) - 1):
        if d[i - 1] * d[i] > 0:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])

    def end(h0, h1, d0, d1):
        v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if v * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(v) > 3 * abs(d0) else v

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = int(np.searchsorted(ts, at, side="right")) - 1
    s = (at - ts[i]) / h[i]
    return (1 + 2 * s) * (1 - s) ** 2 * vs[i] + s * (1 - s) ** 2 * h[i] * m[i] + s * s * (3 - 2 * s) * vs[i + 1] + s * s * (s - 1) * h[i] * m[i + 1]


@pytest.mark.parametrize("shard_slots", [2, 3, 4096])
def test_series_is_complete_and_shape_preserving(spark, shard_slots):
    rnd = random.Random(8)
    slots = sorted(rnd.sample(range(60), 25)) + [80]
    rows = [("gauges", "g", "U", i, (s * 60 + rnd.randrange(60)) * 10**6, s / 10, 0.0, rnd.uniform(0, 9)) for i, s in enumerate(slots)]
    got = {r.slot_start: r for r in resample.regular_series(log_frame(spark, rows), spec(spark), max_gap_slots=6, shard_slots=shard_slots).collect()}
    assert sorted(got) == list(range(slots[0] * 60, 80 * 60 + 1, 60))
    ts, zs = np.array([r[4] / 1e6 for r in rows]), np.array([r[7] for r in rows])
    for a, b in zip(slots, slots[1:]):
        for s in range(a + 1, b):
            r = got[s * 60]
            if b - a - 1 > 6:
                assert (r.status, r.x, r.z) == ("missing", None, None)
            else:
                assert r.status == "filled"
                assert r.z == pytest.approx(pchip(ts, zs, s * 60), abs=1e-9)
    assert all(got[s * 60].status == "reading" for s in slots)


def test_one_slot_and_no_readings(spark):
    one = [("gauges", "g", "U", 1, 61 * 10**6, 1.0, 2.0, 3.0)]
    assert tuples(resample.regular_series(log_frame(spark, one), spec(spark)), "slot_start", "status") == [(60, "reading")]
    assert resample.regular_series(log_frame(spark, []), spec(spark)).collect() == []


def walking(n, step=1.5):
    """One courier that walks straight on, one ping a second."""
    return [("couriers", "w", "U", i, i * 10**6, 10 + step * i / 111_000, 0.0, 0.0) for i in range(n)]


def test_number_of_passes_does_not_grow_with_the_shards(spark):
    taken = {}
    for n in (2_000, 4_000):
        feed = log_frame(spark, walking(n))
        ready = stops.legs(stops.pings(feed), 100.0, 200, halo_s=300.0, halo_rows=3, bin_s=100.0)
        got = ordered.compose(ready.sortWithinPartitions("namespace", "object_id", "shard", "us", "seq"), stops.StopScan(100.0, 300.0, 2))
        ev = events_frame(spark, [("w", r[5], r[6], r[4] / 1e6) for r in walking(n)])
        of_runs = ordered.compose(runs.prepared_events(runs.trajectory_events(ev), 200, 100.0), runs.RunScan(10.0, 1800.0))
        taken[n] = got[2], of_runs[2]
        assert min(len(got[0]), len(of_runs[0])) >= n // 300
    assert taken[2_000] == taken[4_000] == (1, 1)


def test_states_are_small_and_scans_linear():
    """Pings within four minutes on a slow way: no ping is looked at again and again, and none are kept in the state."""
    op, cost = stops.StopScan(100.0, 300.0, 2), {}
    for n in (4_000, 8_000):
        us = np.arange(n) * (240_000_000 // n)
        x = 10 + 120 * np.arange(n) / n / 111_000
        cols = {"x": x, "y": np.zeros(n), "us": us, "seq": np.arange(n), "path_m": np.zeros(n), "halo": np.zeros(n, dtype=bool)}
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            left = op.run(op.load(("n", "o"), 0, cols), None, False, None)
            best = min(best, time.perf_counter() - start)
        cost[n] = best
        assert left[0] == "free" and len(left) == 3
    assert cost[8_000] < 3 * cost[4_000] + 0.05


@pytest.mark.parametrize("phi", [(0.5, 0.2), (-0.5, 0.0)])
def test_coefficients_of_a_source_are_found_despite_outliers(phi):
    rng, n = np.random.default_rng(4), 20_000
    u = np.zeros(n)
    for i in range(2, n):
        u[i] = phi[0] * u[i - 1] + phi[1] * u[i - 2] + rng.normal()
    x = np.cumsum(u)
    x[rng.integers(0, n, n // 50)] += 80
    got = spikes.fit(np.arange(n, dtype=float), x)
    assert got[:2] == pytest.approx(phi, abs=0.12)
    assert got[2] == 1.0
