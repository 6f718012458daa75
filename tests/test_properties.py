"""Properties of the pure parts: state carried over any cut and told by summaries, hulls of hulls, spikes."""

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.operators.geometry import monotone_chain
from driftline.operators.runs import RunScan
from driftline.operators.spikes import judge
from driftline.operators.stops import StopScan

STEP = st.tuples(st.sampled_from([0.0, 4e-5, 9e-5, 5e-4, 2e-3, 6e-3, -9e-5, -2e-3, -8e-3]), st.sampled_from([1, 20, 200, 1800, 1801, 9000]))
TRACK = st.lists(STEP, min_size=1, max_size=60)
CUTS = st.lists(st.integers(0, 60), max_size=4)


def path(steps):
    x, t, out = 10.0, 0, []
    for dx, dt in steps:
        x, t = x + dx, t + dt
        out.append((round(x, 7), 50.0, t))
    return out


def pieces(rows, cuts):
    at = sorted({0, len(rows), *[c for c in cuts if c < len(rows)]})
    return [rows[a:b] for a, b in zip(at, at[1:]) if a < b]


def settled(op, rows, state, first):
    """Summary of a shard, checked: what it tells of the state left behind is what running the shard gives."""
    left = op.run(rows, state, False, None)
    summary = op.summary(rows, first)
    told = op.settle(state, summary)
    assert told is None or told == left
    cases = op.cases(summary)
    assert told is not None or not cases or left in cases or left == state or state[0] == "free" or isinstance(op, RunScan)
    return left


@given(TRACK, CUTS)
@settings(max_examples=150, deadline=None)
def test_runs_do_not_depend_on_the_shards(steps, cuts):
    rows, op, out, state = path(steps), RunScan(10.0, 1800.0), [], None
    parts = pieces(rows, cuts)
    for i, part in enumerate(parts):
        x, y, t = (np.array([float(r[k]) for r in part]) for k in range(3))
        ready = op.load(("k",), i, {"x": x, "y": y, "ts": t})
        left = settled(op, ready, state, i == 0)
        op.run(ready, state, i == len(parts) - 1, lambda *v: out.append(v))
        state = left
    runs, by = [], {}
    for _, shard, pos, ts, prev in out:
        by.setdefault(shard, []).append((pos, ts, prev))
    for ends in by.values():
        ends.sort()
        runs += [(("k",), a[1], b[2], b[0] - a[0]) for a, b in zip(ends, ends[1:]) if a[1] is not None]
    assert sorted(runs) == sorted(brute.runs([(("k",), x, y, float(t)) for x, y, t in rows]))


@given(TRACK, CUTS)
@settings(max_examples=150, deadline=None)
def test_stops_do_not_depend_on_the_shards(steps, cuts):
    rows, op, ends, state = path(steps), StopScan(100.0, 300.0, 2), {}, None
    at = sorted({0, len(rows), *[c for c in cuts if c < len(rows)]})
    for i, (a, b) in enumerate(zip(at, at[1:])):
        back = max(0, a - 3)
        while a and back and rows[back - 1][2] >= rows[max(0, a - 3)][2] - 300:
            back -= 1
        part = rows[back:b]
        x, y, t = (np.array([r[k] for r in part]) for k in range(3))
        cols = {"x": x, "y": y, "us": t * 1_000_000, "seq": t, "path_m": np.zeros(len(t)), "halo": np.arange(len(t)) < a - back}
        ready = op.load(("n", "o"), i, cols)
        left = settled(op, ready, state, i == 0)
        op.run(ready, state, b == len(rows), lambda *v: ends.update({v[3]: max(ends.get(v[3], 0), v[6])}))
        state = left
    assert sorted(ends.items()) == brute.stops([(t * 1_000_000, t, x, y) for x, y, t in rows])


POINTS = st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=1, max_size=40)


@given(POINTS, st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_hull_of_hulls(points, parts):
    hull = lambda ps: monotone_chain(np.array([float(p[0]) for p in ps]), np.array([float(p[1]) for p in ps]))
    partial = [q for i in range(parts) if points[i::parts] for q in hull(points[i::parts])]
    assert set(hull(partial)) == set(hull(points))


@given(st.integers(0, 10_000), st.floats(0.1, 30), st.booleans())
@settings(max_examples=60, deadline=None)
def test_plain_noise_and_motion_are_no_spikes(seed, noise, moving):
    rng = np.random.default_rng(seed)
    n = 120
    us = np.cumsum(rng.uniform(1e6, 9e6, n))
    drift = np.cumsum(rng.uniform(0, 2e-4, n)) if moving else np.zeros(n)
    x, y = 10 + drift + rng.normal(0, noise, n) / 111195, 50 + rng.normal(0, noise, n) / 111195
    z = 100 + rng.normal(0, 1, n)
    x[60:] += 0.05  # a lasting move
    assert not (judge(us, x, y, z) == "spike").any()
