"""Wrong readings: spikes, stuck values and impossible positions, judged against the source itself.

Per source an autoregression of order two is fitted to the paces of its track (local metres east and north, and altitude),
robustly: the correlations come from medians.  Blocks of one to three readings are tested as additive outliers: their
effect is the least-squares estimate from the innovations of all readings they touch, and it must be far out of the usual effect (medians
of the source and in a moving window, so neither outliers nor calm and lively phases distort it), explain more than a level
shift at either end of the block would, and leave no more than an ordinary step between the readings around it.  Of
outliers near each other the strongest is flagged first, and the tests are iterated without the flagged readings until
nothing more is found.  Stuck runs and physical limits are separate tests.

A busy source is cut into shards, yet judged as a whole: runs of equal positions are summarised per sorted shard and
merged across borders, which gives every run's full length and the source's share of equal steps; the readings that are
left for the spike test are numbered, cut into shards of ``shard_rows`` with a halo of ``HALO`` readings on both sides,
and the model and each round's usual effects and paces come from medians of the whole source.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from driftline.constants import EARTH_RADIUS_M, MAX_ALTITUDE_M, MIN_ALTITUDE_M
from driftline.functions.geo import usable
from driftline.operators.ordered import shards, without_copies
from driftline.session import cut as cut_

KEY = ["namespace", "object_id"]
LIMIT, PLACEHOLDER, STUCK, SPIKE = "limit", "placeholder", "stuck", "spike"
#: Readings lent on either side of a shard; a round of tests looks about 20 readings far.
HALO = 256
#: Busy sources up to which their keys are broadcast.
MAX_BROADCAST_SOURCES = 50_000
#: Digits after the point up to which a coordinate's recording step is looked for.
DIGITS = 7
#: Share of equal successive positions from which a source normally repeats itself.
HABIT = 0.15
#: Readings to both sides whose tests an outlier disturbs.
REACH = 3
#: Bound of the correlations of paces, so that the fitted autoregression is steady.
STEADY = 0.8
#: Longest time step relative to the one before over which a pace is carried on.
MAX_RATIO = 2.0


def _moving_median(v: np.ndarray, width: int) -> np.ndarray:
    return pd.Series(v).rolling(width, center=True, min_periods=min(5, width)).median().bfill().ffill().to_numpy()


def _quantum(shares: list[float]) -> float:
    """Step in which a coordinate is recorded: the power of ten of which nearly all values are multiples."""
    return next((10.0**-digits for digits, share in enumerate(shares) if share >= 0.95), 0.0)


def _multiples(v: np.ndarray) -> list[float]:
    """Share of multiples of 1, 0.1, 0.01 and so on among the values."""
    return [float(np.mean(np.abs(v * 10.0**d - np.round(v * 10.0**d)) < 1e-6)) for d in range(DIGITS)]


def _scale(r: np.ndarray, floor: float, whole: float | None, width: int = 31) -> np.ndarray:
    """Robust scale of residual sizes: the larger of the source's and the moving median, at least ``floor``."""
    if whole is None:
        whole = float(np.median(r)) if len(r) else 0.0
    return np.maximum(np.maximum(_moving_median(r, width), whole), floor)


def _ratios(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the time step into each reading relative to the one and the two before it, held within [0, MAX_RATIO]."""
    dt = np.concatenate([[np.nan], np.diff(t)])
    out = []
    for lag in (1, 2):
        before = np.concatenate([np.full(lag, np.nan), dt[:-lag]])[: len(dt)]
        with np.errstate(all="ignore"):
            out.append(np.nan_to_num(np.clip(dt / np.maximum(before, 1e-9), 0.0, MAX_RATIO)))
    return out[0], out[1]


def _pace_sums(t: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Sizes of the sums and differences of paces one and two steps apart (rows: steps, columns: coordinates); NaN where there are none."""
    dt = np.diff(t)
    u = np.diff(pos, axis=0) / np.where(dt > 1e-3, dt, np.nan)[:, None]
    out = []
    for lag in (1, 2):
        before = np.concatenate([np.full((min(lag, len(u)), u.shape[1]), np.nan), u[: max(0, len(u) - lag)]])
        out += [np.abs(u + before), np.abs(u - before)]
    return out


def coefficients(medians: list[float]) -> tuple[float, float]:
    """Coefficients of an AR(2) of the paces from four medians, those of ``_pace_sums``.

    Correlations of lag one and two from the squared medians of sums and differences (outliers hardly move a median),
    then the Yule-Walker equations.
    """
    rho = []
    for plus, minus in (medians[:2], medians[2:]):
        whole = plus * plus + minus * minus
        rho.append(float(np.clip((plus * plus - minus * minus) / whole, -STEADY, STEADY)) if whole > 0 else 0.0)
    r1, r2 = rho
    partial = float(np.clip((r2 - r1 * r1) / (1 - r1 * r1), -STEADY, STEADY))
    return r1 * (1 - partial), partial


def fit(t: np.ndarray, pos: np.ndarray) -> tuple[float, float, float]:
    """Model of one track: robust AR(2) coefficients of its paces and its usual time step."""
    sums = [v[~np.isnan(v)] for v in _pace_sums(t, pos.reshape(len(t), -1))]
    step = float(np.median(np.diff(t))) if len(t) > 1 else 1.0
    return *coefficients([float(np.median(v)) if len(v) else 0.0 for v in sums]), step


def _weights(t: np.ndarray, model: tuple[float, float, float]) -> np.ndarray:
    """Per reading k the weights of readings k, k-1, k-2, k-3 in the innovation of k; zero where it has no step.

    An innovation over a longer step counts for less, as its variance grows with the time.
    """
    f1, f2 = (p * r for p, r in zip(model[:2], _ratios(t), strict=True))
    f1[:2], f2[:3] = 0.0, 0.0
    w = np.column_stack([np.ones(len(t)), -1.0 - f1, f1 - f2, f2])
    w[:1] = 0.0
    w[1:] /= np.sqrt(np.maximum(np.diff(t) / max(model[2], 1e-9), 0.25))[:, None]
    return w


def _innovations(pos: np.ndarray, w: np.ndarray) -> np.ndarray:
    e = w[:, :1] * pos
    for lag in (1, 2, 3):
        e[lag:] += w[lag:, lag : lag + 1] * pos[:-lag]
    return e


def _outlier_effects(e: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares effects of additive outliers in the ``size`` readings from each inner reading on.

    Effects (blocks, size, coordinates) and the sum of squares that they explain.
    """
    m = len(e)
    n = m - size - 1
    i = np.arange(1, 1 + n)
    lhs, rhs = np.zeros((n, size, size)), np.zeros((n, size, e.shape[1]))
    for row in range(size + 3):
        k = i + row
        ok = k < m
        kk = np.minimum(k, m - 1)
        a = np.zeros((n, size))
        for j in range(size):
            if 0 <= row - j <= 3:
                a[:, j] = np.where(ok, w[kk, row - j], 0.0)
        lhs += a[:, :, None] * a[:, None, :]
        rhs += a[:, :, None] * e[kk][:, None, :]
    effects = rhs / (lhs + 1e-12) if size == 1 else np.linalg.solve(lhs + 1e-12 * np.eye(size), rhs)
    return effects, (effects * rhs).sum(axis=(1, 2))


def _shift_effects(e: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of squares explained by a level shift beginning at each reading."""
    start = np.arange(len(e))
    m, top, norm = len(e), np.zeros((len(start), e.shape[1])), np.zeros(len(start))
    for row in range(3):
        k = np.minimum(start + row, m - 1)
        a = np.where(start + row < m, w[k, : row + 1].sum(axis=1), 0.0)
        top += a[:, None] * e[k]
        norm += a * a
    return (top * top).sum(axis=1) / np.maximum(norm, 1e-12)


def _usual(t: np.ndarray, pos: np.ndarray, model: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Outlier effects of each inner reading alone and ordinary paces."""
    w = _weights(t, model)
    r = np.linalg.norm(_outlier_effects(_innovations(pos, w), w, 1)[0][:, 0], axis=1)
    step = np.linalg.norm(np.diff(pos, axis=0), axis=1)
    return r, step / np.maximum(np.diff(t), 1e-3)


def _block_tests(
    t: np.ndarray, tracks: list[np.ndarray], floors: list[float], cut: float, models: list[tuple], whole: list[tuple] | None = None
) -> np.ndarray:
    """Flags readings in blocks of one to three that are additive outliers in one of the tracks.

    ``whole``: the source's median outlier effect and pace per track, where the readings are only a part of it.
    """
    m = len(t)
    flag = np.zeros(m, dtype=bool)
    if m < 8:
        return flag
    for track, floor, model, (usual_r, usual_pace) in zip(tracks, floors, models, whole or [(None, None)] * len(tracks), strict=True):
        pos = track.reshape(m, -1)
        r1, speed = _usual(t, pos, model)
        s = _scale(r1, floor, usual_r)
        s = np.concatenate([s[:1], s, s[-1:]])
        pace = _scale(speed, 0.0, usual_pace)
        pace = np.concatenate([pace, pace[-1:]])
        w = _weights(t, model)
        e = _innovations(pos, w)
        of_shift = _shift_effects(e, w)
        found: list[tuple[float, int, int]] = []
        for size in (1, 2, 3):
            n = m - size - 1
            if n <= 0:
                continue
            i = np.arange(1, 1 + n)
            a, b = i - 1, i + size
            effects, explained = _outlier_effects(e, w, size)
            least = np.linalg.norm(effects, axis=2).min(axis=1)
            # a level shift shows in the innovations of the readings behind it too, and those behind the block count for the block
            outlier = explained > np.max([of_shift[np.clip(i + lag, 0, m - 1)] for lag in range(-REACH, size + REACH)], axis=0)
            # the level shift that is left between the readings before and behind, without the block
            shift = np.linalg.norm(pos[b] - pos[a], axis=1)
            sc = np.maximum(s[a], s[b])
            usual = 4 * sc + 3 * pace[a] * np.maximum(t[b] - t[a], 1e-9)
            hit = outlier & (least > cut * sc) & ((shift <= 0.35 * least) | ((shift <= usual) & (shift <= least)))
            found += [(float(explained[k] / sc[k] ** 2), int(i[k]), size) for k in np.flatnonzero(hit)]
        # an outlier shows in the tests of the readings near it as well: the strongest one first, the others again without it
        near = np.zeros(m, dtype=bool)
        for _, at, size in sorted(found, reverse=True):
            if not near[at : at + size].any():
                near[max(0, at - REACH) : at + size + REACH] = True
                flag[at : at + size] = True
    return flag


def _tracks(us: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, facts: dict) -> tuple[np.ndarray, list, list]:
    """Time in s, tracks in metres (plane and altitude) and the least scale of each."""
    lon0, lat0 = facts["lon0"], facts["lat0"]
    east = np.radians((x - lon0 + 180) % 360 - 180) * EARTH_RADIUS_M * np.cos(np.radians(np.clip(lat0, -89, 89)))
    north = np.radians(y - lat0) * EARTH_RADIUS_M
    t = (us - us[0]) / 1e6
    t = t + np.arange(len(t)) * 1e-9
    degree = np.radians(1.0) * EARTH_RADIUS_M
    step = max(_quantum(facts["x"]) * np.cos(np.radians(lat0)), _quantum(facts["y"])) * degree
    return t, [np.column_stack([east, north]), z], [max(0.5, 0.3 * step), max(0.02, 0.3 * _quantum(facts["z"]))]


def _rounds(t: np.ndarray, tracks: list, floors: list, cut: float, models: list, wholes: Iterable) -> np.ndarray:
    """Outliers after one round of tests per entry of ``wholes``, each without the readings flagged before, until none is found."""
    out = np.zeros(len(t), dtype=bool)
    for whole in wholes:
        rest = np.flatnonzero(~out)
        new = _block_tests(t[rest], [k[rest] for k in tracks], floors, cut, models, whole)
        add = np.zeros(len(t), dtype=bool)
        add[rest[new]] = True
        add &= ~_in_long_stretches(out | add)
        if whole is None and not add.any():
            break
        out |= add
    return out


def _in_long_stretches(out: np.ndarray) -> np.ndarray:
    """Readings in stretches of more than three: a spike is one reading, alone or with one or two neighbours."""
    long = np.zeros(len(out), dtype=bool)
    ends = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(int), [0]])))
    for a, b in zip(ends[::2], ends[1::2], strict=True):
        long[a:b] = b - a > 3
    return long


def judge(
    us: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, *, cut: float = 7.5, stuck_run: int = 8
) -> np.ndarray:
    """Reason per reading ('' if it is fine) for one source's readings in (ts, seq) order; NaN marks nulls."""
    n = len(x)
    why = np.full(n, "", dtype=object)
    with np.errstate(invalid="ignore"):
        ok = (np.abs(x) <= 180) & (np.abs(y) <= 90) & (z >= MIN_ALTITUDE_M) & (z <= MAX_ALTITUDE_M)
    blank = ok & (((x == 0) & (y == 0)) | ((x == y) & (y == z)))
    why[~ok] = LIMIT
    why[blank] = PLACEHOLDER
    use = np.flatnonzero(ok & ~blank & ~np.isnan(us))
    if len(use) < 2:
        return why

    # Stuck runs: exactly equal positions in a row, at a source that otherwise changes.
    px, py, pz = x[use], y[use], z[use]
    same = (np.diff(px) == 0) & (np.diff(py) == 0) & (np.diff(pz) == 0)
    run_id = np.concatenate([[0], np.cumsum(~same)])
    length = np.bincount(run_id)[run_id]
    long = length >= stuck_run
    short = ~(long[1:] & long[:-1])
    resent = np.diff(us[use]) == 0
    habit = same[short & ~resent]
    repeats = float(habit.mean()) if len(habit) else 1.0
    if long.any() and repeats < HABIT and (~long).sum() >= stuck_run:
        why[use[long]] = STUCK

    # Spikes. Copies sent again at the same time count once; of a stuck run its first reading stays.
    first = np.concatenate([[True], ~(same & (resent | (long[1:] & long[:-1])))])
    keep = use[first]
    facts = {"lon0": np.median(x[keep]), "lat0": np.median(y[keep])}
    facts |= {k: _multiples(v[keep]) for k, v in (("x", x), ("y", y), ("z", z))}
    t, tracks, floors = _tracks(us[keep], x[keep], y[keep], z[keep], facts)
    out = _rounds(t, tracks, floors, cut, [fit(t, k) for k in tracks], repeat(None))
    group = np.cumsum(first) - 1
    hit = out[group] & (why[use] == "")
    why[use[hit]] = SPIKE
    return why


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, pd.DataFrame]]:
    """(shard, key, rows) per source of a sorted shard."""
    got = [b for b in batches if b.num_rows]
    if got:
        rows = pa.Table.from_batches(got).to_pandas()
        for key, g in rows.groupby(KEY, sort=False):
            yield int(g["shard"].iloc[0]), key, g


def _steps(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps to an equal position, steps without time, number of each reading's run."""
    same = np.logical_and.reduce([np.diff(g[k].to_numpy()) == 0 for k in ("x", "y", "z")])
    return same, np.diff(g["us"].to_numpy()) == 0, np.concatenate([[0], np.cumsum(~same)])


def _summarise(stuck_run: int) -> Callable:
    """Per shard and source its outermost runs and the sums of the runs between them."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, key, g in _sources(batches):
            same, resent, run = _steps(g)
            us, pos = g["us"].to_numpy(), g[["x", "y", "z"]].to_numpy()
            n = np.bincount(run)
            equal, again = (np.bincount(run[1:][same & w], minlength=len(n)) for w in (~resent, resent))
            fresh, long = ~resent[~same], n >= stuck_run
            ends = np.cumsum(n)

            def one(i: int) -> dict:
                return {
                    "pos": tuple(pos[ends[i] - 1]), "n": int(n[i]), "equal": int(equal[i]), "again": int(again[i]),
                    "from": int(us[ends[i] - n[i]]), "to": int(us[ends[i] - 1]), "shard": shard,
                }

            out = {"head": one(0), "tail": one(len(n) - 1) if len(n) > 1 else None, "middle": None}
            if len(n) > 2:
                m, short = slice(1, -1), ~long[1:-1]
                counted = fresh[1:-1] & ~(long[1:-2] & long[2:-1])
                out["middle"] = {
                    "free": int(n[m][short].sum()), "equal": int(equal[m][short].sum()), "steps": int(counted.sum()),
                    "long": bool(long[m].any()), "kept": int(np.where(long[m], 1, n[m] - again[m]).sum()),
                    "in": (bool(fresh[0]), bool(long[1])), "out": (bool(fresh[-1]), bool(long[-2])),
                }
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "summary": pa.array([pickle.dumps((key, out))], pa.binary())}
            )

    return f


def _merge(parts: list[dict], stuck_run: int) -> dict[int, dict]:
    """From a source's summaries in order, per shard: full length of its first and last run and what lies before it."""
    known: dict[int, dict] = {p["head"]["shard"]: {"joined": False, "resent": False, "kept": 0} for p in parts}
    free = equal = steps = 0
    run: list[dict] = []  # members of the open run, one per shard
    fresh = before = any_long = False  # the step into the open run takes time; the run before it is long

    def close() -> bool:
        nonlocal free, equal, steps, any_long
        border = [a["to"] == b["from"] for a, b in zip(run, run[1:], strict=False)]
        n, same = sum(m["n"] for m in run), sum(m["equal"] for m in run) + border.count(False)
        long = n >= stuck_run
        any_long |= long
        steps += fresh and not (before and long)
        if not long:
            free, equal, steps = free + n, equal + same, steps + same
        for i, m in enumerate(run):
            k = known[m["shard"]]
            k["tail_n"] = n
            k.setdefault("head_n", n)
            k["kept"] += (i == 0) if long else m["n"] - m["again"] - (i > 0 and border[i - 1])
            if i:
                k["joined"], k["resent"] = True, border[i - 1]
        run.clear()
        return long

    for p in parts:
        head, middle, tail = p["head"], p["middle"], p["tail"]
        if run and run[-1]["pos"] != head["pos"]:
            last = run[-1]["to"]
            before, fresh = close(), last != head["from"]
        run.append(head)
        if middle:
            long = close()
            enters, next_long = middle["in"]
            steps += enters and not (long and next_long)
            free, equal, steps = free + middle["free"], equal + middle["equal"], steps + middle["steps"] + middle["equal"]
            known[head["shard"]]["kept"] += middle["kept"]
            any_long |= middle["long"]
            fresh, before = middle["out"]
            run.append(tail)
        elif tail:
            last = head["to"]
            before, fresh = close(), last != tail["from"]
            run.append(tail)
    close()
    stuck = any_long and steps > 0 and equal / steps < HABIT and free >= stuck_run
    offset = 0
    for k in known.values():
        k["offset"], k["stuck"] = offset, stuck
        offset += k["kept"]
    return known


def _numbered(known: dict[tuple, dict[int, dict]], stuck_run: int) -> Callable:
    """Adds to each reading whether it is stuck, whether it stays for the spike test, and its (or its copy's) number there."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, key, g in _sources(batches):
            of = known[key][shard]
            same, resent, run = _steps(g)
            n = np.bincount(run)
            n[0], n[-1] = of["head_n"], of["tail_n"]
            long = n[run] >= stuck_run
            stays = np.concatenate(
                [[not (of["joined"] and (of["resent"] or long[0]))], ~(same & (resent | (long[1:] & long[:-1])))]
            )
            g = g.drop(columns="shard").assign(k=of["offset"] + np.cumsum(stays) - 1, stays=stays, stuck=long & of["stuck"])
            yield pa.RecordBatch.from_pandas(g, preserve_index=False)

    return f


def _busy_spikes(kept: DataFrame, cut: float, shard_rows: int) -> DataFrame:
    """Numbers ``k`` of the spikes among the numbered readings of busy sources."""
    share = lambda c, d: F.avg((F.abs(c * 10.0**d - F.rint(c * 10.0**d)) < 1e-6).cast("double"))
    got = kept.groupBy(*KEY).agg(
        F.percentile_approx("x", 0.5).alias("lon0"),
        F.percentile_approx("y", 0.5).alias("lat0"),
        *[F.array(*[share(F.col(c), d) for d in range(DIGITS)]).alias(c) for c in ("x", "y", "z")],
    )
    facts = {(r.namespace, r.object_id): r.asDict() for r in got.collect()}
    models: dict[tuple, list] = {}
    wholes: dict[tuple, list] = defaultdict(list)
    k = F.col("k")
    near = F.sequence(F.greatest(F.lit(0), F.floor((k - HALO) / shard_rows)), F.floor((k + HALO) / shard_rows))
    lent = kept.withColumn("shard", F.explode(near))
    keys = "namespace string, object_id string, "

    def medians(f: Callable, names: list[str], *more: Column) -> list[Row]:
        """Whole-source medians of what ``f`` gives per reading."""
        parts = lent.groupBy(*KEY, "shard").applyInPandas(f, keys + "out boolean, " + ", ".join(f"{c} double" for c in names))
        per = [F.percentile_approx(F.when(~F.isnan(c), F.col(c)), 0.5).alias(c) for c in names]
        return parts.groupBy(*KEY).agg(*more, *per).collect()

    def tracks_of(g: pd.DataFrame) -> tuple:
        key = (g["namespace"].iloc[0], g["object_id"].iloc[0])
        return key, *_tracks(*[g[c].to_numpy(dtype=float) for c in ("us", "x", "y", "z")], facts[key])

    def outliers(g: pd.DataFrame) -> tuple:
        key, t, tracks, floors = tracks_of(g)
        return t, tracks, models[key], _rounds(t, tracks, floors, cut, models[key], wholes.get(key, []))

    def paces(pdf: pd.DataFrame) -> pd.DataFrame:
        """What the model is fitted to: steps in time, sums and differences of paces; one row per reading and coordinate."""
        g = pdf.sort_values("k")
        _, t, tracks, _ = tracks_of(g)
        own = (g["k"] // shard_rows == g["shard"]).to_numpy()
        sums = [_pace_sums(t, track.reshape(len(t), -1)) for track in tracks]
        parts = []
        for c in range(2):
            res = g[KEY].assign(out=False, step=[np.nan, *np.diff(t)] if c == 0 else np.nan)
            for i, s in enumerate(sums):
                for j, v in enumerate(s):
                    res[f"m{i}{j}"] = [np.nan, *v[:, c]] if c < v.shape[1] else np.nan
            parts.append(res[own])
        return pd.concat(parts)

    def usual(pdf: pd.DataFrame) -> pd.DataFrame:
        """Outlier effects and paces of the shard's own readings that aren't flagged so far."""
        g = pdf.sort_values("k")
        t, tracks, model, out = outliers(g)
        rest = np.flatnonzero(~out)
        res = g[KEY].assign(out=out)
        for i, track in enumerate(tracks):
            r, pace = np.full(len(g), np.nan), np.full(len(g), np.nan)
            if len(rest) > 2:
                r[rest[1:-1]], pace[rest[:-1]] = _usual(t[rest], track[rest].reshape(len(rest), -1), model[i])
            res[f"r{i}"], res[f"p{i}"] = r, pace
        return res[(g["k"] // shard_rows == g["shard"]).to_numpy()]

    def spikes(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values("k")
        return g.loc[outliers(g)[3] & (g["k"] // shard_rows == g["shard"]).to_numpy(), [*KEY, "k"]]

    sums = [f"m{i}{j}" for i in range(2) for j in range(4)]
    for r in medians(paces, ["step", *sums]):
        v = [r[c] or 0.0 for c in sums]
        models[r.namespace, r.object_id] = [(*coefficients(v[i : i + 4]), r.step or 1.0) for i in (0, 4)]
    names, flagged = ["r0", "p0", "r1", "p1"], -1
    while True:
        rows = medians(usual, names, F.count_if("out").alias("n_out"))
        found = sum(r.n_out for r in rows)
        if found == flagged:
            break
        flagged = found
        for r in rows:
            v = [r[c] or 0.0 for c in names]
            wholes[r.namespace, r.object_id].append([(v[0], v[1]), (v[2], v[3])])
    return lent.groupBy(*KEY, "shard").applyInPandas(spikes, keys + "k bigint")


def _judge_busy(readings: DataFrame, cut: float, stuck_run: int, shard_rows: int) -> DataFrame:
    """namespace, object_id, seq, us, reason of stuck readings and spikes of sources too large for one task.

    ``readings``: usable, with a time, copies dropped.
    """
    parts = shards(readings, KEY, ["us", "seq"], shard_rows)
    by: dict[tuple, list] = defaultdict(list)
    for r in sorted(parts.mapInArrow(_summarise(stuck_run), "shard int, summary binary").collect(), key=lambda r: r.shard):
        key, summary = pickle.loads(bytes(r.summary))
        by[key].append(summary)
    known = {key: _merge(s, stuck_run) for key, s in by.items()}
    schema = "namespace string, object_id string, us bigint, seq bigint, x double, y double, z double, k bigint, stays boolean, stuck boolean"
    numbered = cut_(parts.mapInArrow(_numbered(known, stuck_run), schema))
    kept = numbered.where("stays").select(*KEY, "k", "us", "x", "y", "z")
    spikes = _busy_spikes(kept, cut, shard_rows)
    stuck = numbered.where("stuck").select(*KEY, "seq", "us", F.lit(STUCK).alias("reason"))
    # a number may stand for a whole run of equal readings
    spike = numbered.where(~F.col("stuck")).join(spikes, [*KEY, "k"]).select(*KEY, "seq", "us", F.lit(SPIKE).alias("reason"))
    return stuck.unionByName(spike)


def flag_readings(feed: DataFrame, *, cut: float = 7.5, stuck_run: int = 8, shard_rows: int = 50_000) -> DataFrame:
    """Wrong readings: namespace, object_id, seq, ts, reason (limit, placeholder, stuck or spike).

    Readings are the U records of ``feed``, redelivered copies (same seq) once, in (ts, seq) order of their object;
    deletes don't matter.  Reasons: ``limit`` for a null, non-finite or out-of-range coordinate; ``placeholder`` for
    x = y = 0 or x = y = z; ``stuck`` for ``stuck_run`` or more exactly equal positions in a row at a source whose
    positions otherwise repeat in less than ``HABIT`` of the steps; ``spike`` for blocks of one to three readings whose
    effect against the source's autoregression is over ``cut`` times the usual effect while the readings around agree.

    Defined cases: readings with null ``ts`` are judged by ``limit`` and ``placeholder`` only; rows with a null
    namespace, object_id or seq are left out; sources with fewer than eight usable readings have no spikes; copies
    sent again under a new seq share the verdict; an empty feed gives no rows; further columns are ignored.
    A source with more than ``shard_rows`` rows is spread over several tasks and judged by the same whole-source values
    (medians to a rank of 1 in 10 000).
    """
    r = (
        feed.where((F.col("op") == "U") & F.col("namespace").isNotNull() & F.col("object_id").isNotNull())
        .where(F.col("seq").isNotNull())
        .select(*KEY, "seq", F.unix_micros("ts").alias("us"), "x", "y", "z")
    )
    schema = "namespace string, object_id string, seq bigint, us bigint, reason string"
    # limits and placeholders row by row; only usable readings with a time, each once, get into the groups
    blank = ((F.col("x") == 0) & (F.col("y") == 0)) | ((F.col("x") == F.col("y")) & (F.col("y") == F.col("z")))
    once = without_copies(r, [*KEY, "us", "seq"]).withColumn("reason", F.when(~usable(), LIMIT).when(blank, PLACEHOLDER))
    bad = once.where(F.col("reason").isNotNull()).select(*KEY, "seq", "us", "reason")
    fine = once.where(F.col("reason").isNull() & F.col("us").isNotNull()).drop("reason")
    busy = cut_(fine.groupBy(*KEY).count().where(F.col("count") > shard_rows).select(*KEY))
    n_busy = busy.count()
    keys = F.broadcast(busy) if n_busy <= MAX_BROADCAST_SOURCES else busy
    rest = fine.join(keys, KEY, "left_anti") if n_busy else fine
    wrong = bad.unionByName(rest.groupBy(*KEY).applyInPandas(_judge_group(cut, stuck_run), schema))
    if n_busy:
        wrong = wrong.unionByName(_judge_busy(fine.join(keys, KEY, "left_semi"), cut, stuck_run, shard_rows))
    return wrong.select(*KEY, "seq", F.timestamp_micros("us").alias("ts"), "reason")


def _judge_group(cut: float, stuck_run: int):  # noqa: ANN202
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.iloc[np.lexsort((pdf["seq"].to_numpy(), pdf["us"].to_numpy(dtype=float)))]
        why = judge(*[g[k].to_numpy(dtype=float) for k in ("us", "x", "y", "z")], cut=cut, stuck_run=stuck_run)
        hit = why != ""
        out = g.loc[hit, [*KEY, "seq", "us"]].copy()
        out["us"] = out["us"].astype("Int64")
        out["reason"] = why[hit]
        return out

    return f
