"""Runs of (nearly) equal consecutive events, collapsed to one event with count and duration.

Only boundary rows leave the scan: an event that starts a run, with its position in the object's sequence
and the time of the event before it.  ``lead`` over the starts then gives everything: the difference of
positions is the count, the next start's previous-event time is the end.  An event belongs to a run while it
lies near the run's *first* event, so the scan carries that first event from shard to shard.  The lead is taken
within the shard in which a run began; a run that ends in a later shard sends its closing row there.

A shard sums up for the driver what it does to a run of an earlier shard: the first event out of reach of any place must lie
outside the hull of those before it, so these *records* (few, whether the object moves or stays), each with the run that
is open at the end if the earlier one breaks there, tell the state left behind for every state on entry.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.constants import EARTH_RADIUS_M
from driftline.functions.geo import usable
from driftline.operators.geometry import monotone_chain
from driftline.operators.ordered import BIN_S, Reach, scan, time_shards, unit, without_copies
from driftline.session import cut

KEY = ["namespace", "object_id"]
#: Records that a shard sends to the driver; with more it is asked again when its entry state is known.
MAX_RECORDS = 2048
#: Events ahead that are looked at for all events at once.
LAGS = 8


def records(x: np.ndarray, y: np.ndarray, most: int = MAX_RECORDS) -> list[int] | None:
    """Indices of the points outside the hull of all earlier ones; None if there are more than ``most``."""
    px, py = (x - x[0]) * np.cos(np.radians(y[0])), y - y[0]
    found, i, step, n = [0], 1, 64, len(x)
    hull = [(0.0, 0.0)]
    while i < n:
        to = min(n, i + step)
        cx, cy = px[i:to], py[i:to]
        if len(hull) < 3:
            inside = np.zeros(to - i, dtype=bool)
            for a, b in hull:
                inside |= (cx == a) & (cy == b)
        else:
            inside = np.ones(to - i, dtype=bool)
            for (ax, ay), (bx, by) in zip(hull, [*hull[1:], hull[0]], strict=True):
                inside &= (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) >= 0
        out = np.flatnonzero(~inside)
        if not len(out):
            i, step = to, min(8192, step * 2)
            continue
        j = i + int(out[0])
        found.append(j)
        if len(found) > most:
            return None
        hull = monotone_chain(np.array([*[p[0] for p in hull], px[j]]), np.array([*[p[1] for p in hull], py[j]]))
        i, step = j + 1, 64
    return found


@dataclass
class Events:
    """One object's events of a shard in order."""

    key: tuple
    shard: int
    x: np.ndarray
    y: np.ndarray
    t: np.ndarray
    reach: Reach
    gaps: np.ndarray  # events too long after the one before
    soon: np.ndarray  # start of the next run if it is at most LAGS events ahead, else 0


class RunScan:
    """State: first event's x and y, shard and position of the run's start, events so far, time of the last event."""

    extra: dict

    def __init__(self, near_m: float, gap_s: float):
        self.near_m, self.gap_s = near_m, gap_s

    def load(self, key: tuple, shard: int, cols: dict[str, np.ndarray]) -> Events:
        x, y, t = cols["x"], cols["y"], cols["ts"]
        reach, n = Reach(x, y, self.near_m, 1, EARTH_RADIUS_M), len(x)
        late = np.concatenate([[False], np.diff(t) > self.gap_s])
        soon = np.zeros(n, dtype=np.int64)
        for lag in range(min(LAGS, n - 1), 0, -1):
            starts = reach.lag(lag)
            starts[: n - lag] |= late[lag:]
            soon[starts] = np.flatnonzero(starts) + lag
        return Events(key, shard, x, y, t, reach, np.flatnonzero(late), soon)

    def _break(self, e: Events, place: np.ndarray, start: int) -> int:
        """First event from ``start`` on that doesn't belong to a run begun at ``place``; n if all do."""
        i = int(np.searchsorted(e.gaps, start))
        return e.reach.first(place, start, int(e.gaps[i]) if i < len(e.gaps) else len(e.x))

    def _next(self, e: Events, i: int) -> int:
        return int(e.soon[i]) or self._break(e, e.reach.u[i], i + 1 + min(LAGS, len(e.x) - 1 - i))

    def _open(self, e: Events, i: int) -> tuple:
        return (float(e.x[i]), float(e.y[i]), e.shard, i, len(e.x) - i, float(e.t[-1]))

    def _first_break(self, e: Events, entry: tuple | None) -> int:
        if entry is None or e.t[0] - entry[5] > self.gap_s:
            return 0
        return self._break(e, unit(np.array(entry[0]), np.array(entry[1]))[0], 0)

    def run(self, e: Events, entry: Any, last: bool, emit: Any) -> Any:
        n, at = len(e.x), self._first_break(e, entry)
        if emit is not None and entry is not None and (at < n or last):  # closes a run of an earlier shard
            emit(*e.key, entry[2], entry[3] + entry[4] + at, None, float(e.t[at - 1]) if at else entry[5])
        begun = -1
        while at < n:
            if emit is not None:
                before = float(e.t[at - 1]) if at else None if entry is None else entry[5]
                emit(*e.key, e.shard, at, float(e.t[at]), before)
            begun, at = at, self._next(e, at)
        if begun < 0:
            x, y, shard, pos, count, _ = entry
            return (x, y, shard, pos, count + n, float(e.t[-1]))
        if emit is not None and last:
            emit(*e.key, e.shard, n, None, float(e.t[-1]))
        return self._open(e, begun)

    def summary(self, e: Events, first: bool) -> Any:
        if first:
            return {"exit": self.run(e, None, False, None)}
        n = len(e.x)
        # an event at twice the distance from the first one, or a gap, ends every earlier run
        wide = Reach(e.x, e.y, 2 * self.near_m + 0.001, 1, EARTH_RADIUS_M)
        gap = int(e.gaps[0]) if len(e.gaps) else n
        upto = wide.first(wide.u[0], 1, gap)
        part = slice(0, min(n, upto + 1))
        if np.ptp(e.x[part]) > 90 or np.abs(e.y[part]).max() > 89:
            return {"exit": None}  # the hull in plain degrees isn't one on the globe
        at = records(e.x[part], e.y[part])
        if at is None:
            return {"exit": None}
        if upto == gap < n and at[-1] != gap:
            at.append(gap)
        ends: dict[int, int] = {}
        for r in reversed(at):
            path, i = [], r
            while i not in ends and (j := self._next(e, i)) < n:
                path.append(i)
                i = j
            end = ends.get(i, i)
            ends.update(dict.fromkeys([*path, i], end))
        return {
            "exit": None, "x": e.x[at], "y": e.y[at], "left": [self._open(e, ends[i]) for i in at],
            "forced": at.index(gap) if upto == gap < n else None, "from": float(e.t[0]), "to": float(e.t[-1]), "n": n,
        }

    def settle(self, entry: Any, summary: Any) -> Any:
        if summary["exit"] is not None or "x" not in summary or entry is None:
            return summary["exit"]
        x, y, shard, pos, count, last = entry
        if summary["from"] - last > self.gap_s:
            return summary["left"][0]
        chord = np.linalg.norm(unit(summary["x"], summary["y"]) - unit(np.array(x), np.array(y)), axis=1)
        out = chord > 2 * np.sin(self.near_m / EARTH_RADIUS_M / 2)
        if summary["forced"] is not None:
            out[summary["forced"]] = True
        if out.any():
            return summary["left"][int(out.argmax())]
        return (x, y, shard, pos, count + summary["n"], summary["to"])

    def cases(self, summary: Any) -> list:
        return list(dict.fromkeys(summary.get("left", ())))


def trajectory_events(batches: DataFrame) -> DataFrame:
    """The usable elements of all rows of an object: namespace, object_id, x, y, ts (epoch seconds), copies included.

    Null and empty arrays give no event; elements with a null, non-finite or out-of-range field or a negative
    ``ts`` and rows with a null key are left out; further columns are ignored.
    """
    p = (
        batches.where(F.col("namespace").isNotNull() & F.col("object_id").isNotNull())
        .select(*KEY, F.explode("points").alias("p"))
        .select(*KEY, *[(F.col(f"p.{k}") + F.lit(0.0)).alias(k) for k in ("x", "y", "ts")])
    )
    return p.where(usable(z=None) & F.coalesce(F.col("ts").between(0.0, 1e15), F.lit(False)))


def prepared_events(events: DataFrame, rows_per_shard: int, bin_s: float = BIN_S) -> DataFrame:
    """Distinct events in time shards, sorted within them and written to the checkpoint folder."""
    once = without_copies(events.select(*KEY, "x", "y", "ts"), [*KEY, "ts", "x", "y"])
    sharded = time_shards(once, (F.least(F.col("ts"), F.lit(9e12)) * 1e6).cast("bigint"), rows_per_shard, bin_s=bin_s).drop("halo")
    return cut(sharded.repartition(*KEY, "shard").sortWithinPartitions(*KEY, "shard", "ts", "x", "y"))


def boundaries(
    events: DataFrame, near_m: float, gap_s: float, rows_per_shard: int = 65_536, bin_s: float = BIN_S
) -> DataFrame:
    """Boundary rows: key, shard, pos, ts (null on a closing row), prev_ts."""
    schema = "namespace string, object_id string, shard int, pos bigint, ts double, prev_ts double"
    return scan(prepared_events(events, rows_per_shard, bin_s), RunScan(near_m, gap_s), schema)


def collapse_runs(
    events: DataFrame, *, near_m: float = 10.0, gap_s: float = 1800.0, rows_per_shard: int = 65_536, bin_s: float = BIN_S
) -> DataFrame:
    """One row per run: namespace, object_id, start_ts, end_ts, n, duration_s (times in epoch seconds).

    A run begins with an event and takes in each next event within ``near_m`` metres of the run's first event
    and at most ``gap_s`` seconds after the event before it; otherwise a new run begins.

    Defined cases: ``events`` as from ``trajectory_events``; equal events count once; events of equal time are taken in the order of
    (x, y); an event alone is a run of one with duration zero; no events give no runs.  An object with more than ``rows_per_shard`` events is
    spread over several tasks by bins of ``bin_s`` seconds, with the same result.
    """
    b = boundaries(events, near_m, gap_s, rows_per_shard, bin_s)
    w = Window.partitionBy(*KEY, "shard").orderBy("pos")
    return (
        b.withColumns({"n": F.lead("pos").over(w) - F.col("pos"), "end_ts": F.lead("prev_ts").over(w)})
        .where(F.col("ts").isNotNull())
        .select(
            *KEY, F.col("ts").alias("start_ts"), "end_ts", "n", (F.col("end_ts") - F.col("ts")).alias("duration_s")
        )
    )
