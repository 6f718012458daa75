"""Stops and trips from location pings.

Windows over (object, time shard), with a halo of earlier pings, give each ping's lagged distance and speed and the path so
far; legs that are too fast for the device are jumps.  Within a shard the stops are islands: one begins at the first ping
from which the object stays within ``radius_m`` for ``min_stop_s``, and ends before the first gap, that is more than
``max_away`` pings in a row elsewhere, so jumps and silences are merged into the stop they interrupt.  A stop that goes
on over several shards leaves one piece in each; pieces are merged by their first ping.  ``lead`` over an object's stops (at
most one per ``min_stop_s`` of its time, so a bounded group whatever the ping rate) gives the trips.

From shard to shard goes a state of constant size: the first ping of an open stop, or the time and seq of the first ping
that may still begin one; the pings themselves are in the next shard's halo.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.constants import EARTH_RADIUS_M
from driftline.functions.geo import haversine, usable
from driftline.operators.ordered import BIN_S, MAX_CASES, Reach, scan, time_shards, unit, without_copies
from driftline.session import cut

KEY = ["namespace", "object_id"]
PIECES = (
    "namespace string, object_id string, anchor_us bigint, anchor_seq bigint, start_m double, end_us bigint, end_seq bigint,"
    " end_m double, pings bigint"
)
#: Nothing is open and no earlier ping may begin a stop.
FREE = ("free", None, None)
#: Pings ahead that are looked at for all pings at once, one by one and further apart.
NEAR_LAGS, FAR_LAGS = 16, (24, 48, 96, 192, 384, 768)
#: Possible beginnings of a stop that are followed up for the summary of a shard.
MAX_FOLLOWED = 4096


@dataclass
class Pings:
    """One object's pings of a shard in order, those of the halo first (``own`` of them)."""

    key: tuple
    x: np.ndarray
    y: np.ndarray
    us: np.ndarray
    seq: np.ndarray
    m: np.ndarray  # path so far, from the halo's last ping on
    base: float  # path before the shard
    own: int  # index of the first ping that isn't of the halo
    reach: Reach
    leave: np.ndarray  # where the object has left the ping's surroundings, if that is soon, else 0
    maybe: np.ndarray  # pings that may begin a stop


class StopScan:
    """State: FREE, ("free", us, seq) of a ping that may begin a stop, or ("open", x, y, us, seq) of a stop's first ping."""

    extra: dict

    def __init__(self, radius_m: float, min_stop_s: float, max_away: int):
        self.radius_m, self.min_us, self.gap = radius_m, round(min_stop_s * 1e6), max_away + 1
        self.extra = {}

    def load(self, key: tuple, shard: int, cols: dict[str, np.ndarray]) -> Pings:
        x, y, us, seq, m = (cols[k] for k in ("x", "y", "us", "seq", "path_m"))
        n, own, gap = len(x), int(cols["halo"].sum()), self.gap
        reach = Reach(x, y, self.radius_m, gap, EARTH_RADIUS_M)
        away = [reach.lag(i) for i in range(1, NEAR_LAGS + gap)]
        leave = np.zeros(n, dtype=np.int64)
        for lag in range(NEAR_LAGS, 0, -1):
            left = np.logical_and.reduce(away[lag - 1 : lag - 1 + gap])
            leave[left] = np.flatnonzero(left) + lag
        maybe = (leave == 0) | (us[np.maximum(leave - 1, 0)] - us >= self.min_us)
        for lag in FAR_LAGS:
            if lag + gap > n or not maybe.any():
                break
            left = np.logical_and.reduce([reach.lag(lag + i) for i in range(gap)])
            left[: n - lag] &= us[lag:] - us[: n - lag] < self.min_us
            maybe &= ~(left & (leave == 0))
        return Pings(key, x, y, us, seq, m - (m[own - 1] if own else 0.0), self.extra.get((*key, shard), 0.0), own, reach, leave, np.flatnonzero(maybe))

    def _end(self, p: Pings, place: np.ndarray, begin: int, k: int) -> int:
        """Last ping before ``k`` within reach of ``place``; ``begin`` if there is none after it."""
        if k < len(p.x):
            return k - 1
        near = np.flatnonzero(~p.reach.far(place, max(begin + 1, k - self.gap), k))
        return max(begin + 1, k - self.gap) + int(near[-1]) if len(near) else begin

    def _try(self, p: Pings, i: int) -> tuple[int, int, bool]:
        """(ping after the stay begun at i, its last ping, whether it lasts long enough)."""
        k = int(p.leave[i]) or p.reach.first(p.reach.u[i], i + 1)
        end = self._end(p, p.reach.u[i], i, k)
        return k, end, bool(p.us[end] - p.us[i] >= self.min_us)

    def _piece(self, p: Pings, anchor: tuple, place: np.ndarray, begin: int | None, end: int, emit: Any) -> None:
        start = p.own if begin is None else begin
        if emit is not None and end >= start:
            pings = int((~p.reach.far(place, start, end + 1)).sum())
            if pings:
                start_m = None if begin is None else p.base + float(p.m[begin])
                emit(*p.key, *anchor, start_m, int(p.us[end]), int(p.seq[end]), p.base + float(p.m[end]), pings)

    def _from(self, p: Pings, at: int, last: bool, emit: Any) -> tuple:
        """Islands from ping ``at`` on; gives the state at the end."""
        n, c = len(p.x), int(np.searchsorted(p.maybe, at))
        while c < len(p.maybe):
            i = int(p.maybe[c])
            k, end, stop = self._try(p, i)
            if stop:
                self._piece(p, (int(p.us[i]), int(p.seq[i])), p.reach.u[i], i, end, emit)
                if k == n and not last:
                    return ("open", float(p.x[i]), float(p.y[i]), int(p.us[i]), int(p.seq[i]))
                c = int(np.searchsorted(p.maybe, end + 1))
            elif k == n and not last:
                return ("free", int(p.us[i]), int(p.seq[i]))
            else:
                c += 1
        return FREE

    def run(self, p: Pings, entry: Any, last: bool, emit: Any) -> Any:
        if entry is None or entry == FREE:
            return self._from(p, p.own, last, emit)
        if entry[0] == "free":
            at = np.flatnonzero((p.us == entry[1]) & (p.seq == entry[2]))  # always in the halo, if it is the true entry
            return self._from(p, int(at[0]) if len(at) else p.own, last, emit)
        place = unit(np.array(entry[1]), np.array(entry[2]))[0]
        k = p.reach.first(place, max(0, p.own - self.gap + 1))
        end = self._end(p, place, max(0, p.own - self.gap) - 1, k)
        self._piece(p, entry[3:], place, None, end, emit)
        if k == len(p.x) and not last:
            return entry
        return self._from(p, end + 1, last, emit)

    def summary(self, p: Pings, first: bool) -> Any:
        n, gap = len(p.x), self.gap
        out = {"exit": None, "free": None, "cases": [], "path": float(p.m[-1]), "circle": None}
        if first:
            return out | {"exit": self.run(p, None, False, None)}
        begun = p.maybe[: int(np.searchsorted(p.maybe, p.own, side="right")) + 1]
        if len(begun) <= MAX_FOLLOWED:  # entered with nothing open
            left = self._all_ends(p, begun.tolist())
            out["free"] = left[0] if len(left) == 1 else None
        # any open stop has a ping of the last few in reach; once all those are twice the radius away it has ended
        wide = Reach(p.x, p.y, 2 * self.radius_m + 0.001, gap, EARTH_RADIUS_M)
        since = max(0, p.own - gap + 1)
        ends = [wide.first(wide.u[h], since) for h in range(max(0, p.own - gap), p.own)]
        latest = max(ends)
        if latest < n:
            upto = int(np.searchsorted(p.maybe, max(latest, p.own), side="right")) + 1
            followed = p.maybe[:upto]
            if len(followed) <= MAX_FOLLOWED:
                left = self._all_ends(p, followed.tolist())
                out["exit"] = left[0] if len(left) == 1 else None
                out["cases"] = left if len(left) <= MAX_CASES else []
        else:
            # where all but short excursions lie within a circle, a stop that reaches all of it goes on
            u = p.reach.u[since:]
            center = np.median(u, axis=0)
            d = np.linalg.norm(u - center, axis=1)
            three = d
            for i in range(1, gap):
                three = np.minimum(three[:-1], d[i:])
            out["circle"] = (*center.tolist(), float(three.max()) if len(three) else 0.0)
        return out

    def _all_ends(self, p: Pings, starts: list[int]) -> list[tuple]:
        """Distinct states at the end if the islands are sought from any of ``starts`` on."""
        n, known = len(p.x), {}
        following = dict(zip(p.maybe.tolist(), [*p.maybe[1:].tolist(), n], strict=True))
        for start in starts or [n]:
            path, i = [], start
            while i < n and i not in known:
                path.append(i)
                k, end, stop = self._try(p, i)
                if k == n:
                    known[i] = ("open", float(p.x[i]), float(p.y[i]), int(p.us[i]), int(p.seq[i])) if stop else ("free", int(p.us[i]), int(p.seq[i]))
                elif stop:
                    at = int(np.searchsorted(p.maybe, end + 1))
                    i = int(p.maybe[at]) if at < len(p.maybe) else n
                else:
                    i = following[i]
            left = known.get(i, FREE)
            known.update(dict.fromkeys(path, left))
            known[start] = left
        return list(dict.fromkeys(known[s] for s in (starts or [n])))

    def settle(self, entry: Any, summary: Any) -> Any:
        if summary["exit"] is not None or entry is None:
            return summary["exit"]
        if entry[0] == "free" or summary["circle"] is None:
            return summary["free"] if entry[0] == "free" else None
        *center, radius = summary["circle"]
        gap = np.linalg.norm(unit(np.array(entry[1]), np.array(entry[2]))[0] - np.array(center)) + radius
        return entry if gap <= 2 * np.sin(self.radius_m / EARTH_RADIUS_M / 2) - 1e-12 else None

    def cases(self, summary: Any) -> list:
        return summary["cases"]


def _paths_before(summaries: dict[tuple, Any]) -> dict[tuple, float]:
    """Path length of an object before each of its shards."""
    out: dict[tuple, float] = {}
    by: dict[tuple, list[int]] = {}
    for *key, shard in summaries:
        by.setdefault(tuple(key), []).append(shard)
    for key, found in by.items():
        found.sort()
        ends = accumulate((summaries[*key, s]["path"] for s in found), initial=0.0)
        out |= {(*key, s): m for s, m in zip(found, ends, strict=False)}
    return out


def pings(feed: DataFrame) -> DataFrame:
    """Usable U records with a time and a seq: namespace, object_id, us, seq, x, y (redelivered copies are still there)."""
    return (
        feed.where((F.col("op") == "U") & usable() & F.col("ts").isNotNull())
        .where(F.col("namespace").isNotNull() & F.col("object_id").isNotNull() & F.col("seq").isNotNull())
        .select(*KEY, F.unix_micros("ts").alias("us"), "seq", "x", "y")
    )


def legs(
    readings: DataFrame, max_speed: float, rows_per_shard: int, *, halo_s: float, halo_rows: int, bin_s: float = BIN_S
) -> DataFrame:
    """Pings in time shards with the lagged distance ``leg_m``, ``speed`` (m/s) and the path so far ``path_m`` within shard and halo.

    Legs faster than ``max_speed`` belong to jumps and count as nothing in the path.
    """
    s = time_shards(readings, F.col("us"), rows_per_shard, halo_s=halo_s, halo_rows=halo_rows, bin_s=bin_s)
    w = Window.partitionBy(*KEY, "shard").orderBy("us", "seq")
    s = s.withColumns({f"p_{k}": F.lag(k).over(w) for k in ("x", "y", "us")})
    s = s.withColumn("leg_m", F.coalesce(haversine("p_x", "p_y", "x", "y"), F.lit(0.0)))
    s = s.withColumn("speed", F.try_divide(F.col("leg_m"), (F.col("us") - F.col("p_us")) / 1e6))
    real = F.when(F.col("leg_m") <= max_speed * (F.col("us") - F.col("p_us")) / 1e6, F.col("leg_m")).otherwise(0.0)
    return s.withColumn("path_m", F.sum(real).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("p_x", "p_y", "p_us")


def stops_and_trips(
    readings: DataFrame,
    *,
    radius_m: float = 100.0,
    min_stop_s: float = 300.0,
    max_away: int = 2,
    max_speed: float = 100.0,
    rows_per_shard: int = 65_536,
    bin_s: float = BIN_S,
) -> DataFrame:
    """One row per stop and per trip between successive stops, from ``pings``.

    Columns: namespace, object_id, kind, start_seq, end_seq, start_ts, end_ts, duration_s, distance_m (path
    length along the pings; of a trip from the last ping of one stop to the first of the next; legs faster than
    ``max_speed`` m/s are jumps and left out), pings (of stops).

    Defined cases: redelivered copies (same time and seq) count once; pings of equal time are taken in order of seq; one or two pings away and back, and silence,
    do not end a stop; an object with fewer than two stops has no trip; no pings give no rows.  An object with more than
    ``rows_per_shard`` pings is spread over several tasks by bins of ``bin_s`` seconds, with the same result.
    """
    once = without_copies(readings, [*KEY, "us", "seq"])
    ready = legs(once, max_speed, rows_per_shard, halo_s=min_stop_s, halo_rows=max_away + 1, bin_s=bin_s)
    ready = cut(ready.select(*KEY, "shard", "halo", "busy", "us", "seq", "x", "y", "path_m"))
    pieces = scan(ready, StopScan(radius_m, min_stop_s, max_away), PIECES, extra=_paths_before)
    stops = pieces.groupBy(*KEY, F.col("anchor_us").alias("start_us"), F.col("anchor_seq").alias("start_seq")).agg(
        F.max("start_m").alias("m0"), F.max(F.struct("end_us", "end_seq", "end_m")).alias("end"), F.sum("pings").alias("pings")
    )
    stops = stops.select(*KEY, "start_us", "start_seq", "m0", "pings", "end.end_us", "end.end_seq", F.col("end.end_m").alias("m1"))
    nxt = Window.partitionBy(*KEY).orderBy("start_us", "start_seq")
    names = ["seq", "us"]
    both = stops.withColumns(
        {f"n_{k}": F.lead(f"start_{k}").over(nxt) for k in names} | {"n_m": F.lead("m0").over(nxt)}
    )
    stop = F.struct(
        F.lit("stop").alias("kind"), "start_seq", "end_seq", "start_us", "end_us",
        (F.col("m1") - F.col("m0")).alias("distance_m"), F.col("pings"),
    )
    trip = F.when(
        F.col("n_seq").isNotNull(),
        F.struct(
            F.lit("trip").alias("kind"), F.col("end_seq").alias("start_seq"), F.col("n_seq").alias("end_seq"),
            F.col("end_us").alias("start_us"), F.col("n_us").alias("end_us"),
            (F.col("n_m") - F.col("m1")).alias("distance_m"), F.lit(None).cast("bigint").alias("pings"),
        ),
    )
    return (
        both.select(*KEY, F.explode(F.array(stop, trip)).alias("r"))
        .where(F.col("r").isNotNull())
        .select(
            *KEY, "r.kind", "r.start_seq", "r.end_seq",
            F.timestamp_micros("r.start_us").alias("start_ts"), F.timestamp_micros("r.end_us").alias("end_ts"),
            ((F.col("r.end_us") - F.col("r.start_us")) / 1e6).alias("duration_s"), "r.distance_m", "r.pings",
        )
    )
