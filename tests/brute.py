"""Plain single-process versions of the operators, straight from their definitions."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

R = 6_371_008.8


def meters(x1, y1, x2, y2):
    p1, p2 = math.radians(y1), math.radians(y2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, a)))


def usable(x, y, z=0.0):
    if any(v is None or not math.isfinite(v) for v in (x, y, z)):
        return False
    return abs(x) <= 180 and abs(y) <= 90 and -11000 <= z <= 100000


def good_id(v):
    return bool(v) and not any(b in v for b in ("|", "\n", "\r", "::"))


def replay(rows):
    """rows: dicts of the feed -> {(namespace, object_id): row}."""
    seen, state = set(), {}
    for r in sorted((r for r in rows if r["seq"] is not None), key=lambda r: r["seq"]):
        if not good_id(r["object_id"]) or r["namespace"] is None:
            continue
        k = (r["namespace"], r["object_id"])
        if (k, r["seq"], r["op"]) in seen:
            continue
        seen.add((k, r["seq"], r["op"]))
        if r["op"] == "T":
            state.pop(k, None)
        elif r["op"] == "U" and r["ts"] is not None and usable(r["x"], r["y"], r["z"]):
            if k not in state or state[k]["ts"] <= r["ts"]:
                state[k] = r
    return state


def ring_position(x, y, ring):
    """1 inside, 0 outside, -1 on the boundary; exact in the doubles' values."""
    pts = [(Fraction(a), Fraction(b)) for a, b in ring]
    x, y, inside = Fraction(x), Fraction(y), False
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
        side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return -1
        if (y1 <= y < y2 and side > 0) or (y2 <= y < y1 and side < 0):
            inside = not inside
    return int(inside)


def in_polygon(x, y, outer, holes):
    xs, ys = [p[0] for p in outer], [p[1] for p in outer]
    if not (min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys)):
        return False
    return ring_position(x, y, outer) == 1 and all(ring_position(x, y, h) == 0 for h in holes or ())


def locations(rows):
    best = {}
    for r in rows:
        if r["namespace"] is None or r["object_id"] is None or not usable(r["x"], r["y"], r["z"]):
            continue
        k = (r["namespace"], r["object_id"])
        rank = (r["ts"] is not None, r["ts"] or 0, r["x"], r["y"], r["z"])
        if k not in best or rank > best[k][0]:
            best[k] = (rank, r)
    return {k: v[1] for k, v in best.items()}


def near(loc, radius):
    by = defaultdict(list)
    for (ns, oid), r in loc.items():
        by[ns].append((oid, r["x"], r["y"], r["z"]))
    out = set()
    for ns, pts in by.items():
        pts.sort()
        for i, (a, x, y, z) in enumerate(pts):
            for b, x2, y2, z2 in pts[i + 1 :]:
                if math.hypot(meters(x, y, x2, y2), z - z2) <= radius:
                    out.add((ns, a, b))
    return out


def unfilled(rows, periods):
    slots = defaultdict(set)
    for r in rows:
        if r["op"] == "U" and r["namespace"] in periods and r["ts_us"] is not None and r["object_id"] is not None:
            if usable(r["x"], r["y"], r["z"]):
                p = periods[r["namespace"]] * 1_000_000
                slots[r["namespace"], r["object_id"]].add(r["ts_us"] // p * p // 1_000_000)
    out = set()
    for k, s in slots.items():
        p = periods[k[0]]
        out |= {(*k, v) for v in range(min(s), max(s), p) if v not in s}
    return out


def runs(events, near_m=10.0, gap_s=1800.0):
    """events: (key, x, y, ts) -> list of (key, start, end, n)."""
    by = defaultdict(set)
    for k, x, y, t in events:
        by[k].add((t, x, y))
    out = []
    for k, ev in by.items():
        cur = None
        for t, x, y in sorted(ev):
            if cur is None or t - cur[3] > gap_s or meters(cur[0], cur[1], x, y) > near_m:
                if cur:
                    out.append((k, cur[2], cur[3], cur[4]))
                cur = [x, y, t, t, 0]
            cur[3], cur[4] = t, cur[4] + 1
        if cur:
            out.append((k, cur[2], cur[3], cur[4]))
    return out


def stops(pings, radius=100.0, min_us=300_000_000, away=2):
    """pings of one object: (us, seq, x, y), sorted -> list of (start_seq, end_seq)."""
    out, i, n = [], 0, len(pings)
    while i < n:
        last, missed, j = i, 0, i + 1
        while j < n and missed <= away:
            if meters(pings[i][2], pings[i][3], pings[j][2], pings[j][3]) <= radius:
                last, missed = j, 0
            else:
                missed += 1
            j += 1
        if pings[last][0] - pings[i][0] >= min_us:
            out.append((pings[i][1], pings[last][1]))
            i = last + 1
        else:
            i += 1
    return out
