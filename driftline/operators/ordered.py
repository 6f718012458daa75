"""Sequential scans over time shards, with small states composed from shard to shard.

Some per-object results depend on everything that came before (a run is measured from its first event, a
stop from its first ping).  Grouping by object would put a busy object into one task, so its rows are cut into *time
shards* of about ``rows_per_shard`` rows.  Row counts per time bin (map-side combined) give the borders; a shard may also
borrow rows from before its first one (the *halo*).  Objects with fewer rows are one shard each.

The scan then takes a fixed number of narrow passes, whatever the number of shards:

1. every shard of a busy object says what state it leaves behind, for all states it might be entered with: mostly that is
   one and the same state, since the possible scans meet; else a short table of cases;
2. shards whose cases the driver can't tell apart by their table run the few states that the shard before may leave;
3. all shards run with their true entry state and give their rows.

The driver holds one state and one table of bounded size per shard of a busy object.  Where a table would be too long
(``MAX_CASES``), the shard is asked again once the state before it is known, in a pass of its own: results stay exact.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.session import cut, shuffle_partitions

KEY = ["namespace", "object_id"]
#: Busy objects up to which their keys are broadcast.
MAX_BROADCAST_KEYS = 50_000
#: States a shard may be asked about before the true one is known.
MAX_CASES = 64
#: Width of the time bins that shards are made of.
BIN_S = 600.0


def without_copies(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row of those equal in ``by``, written to the checkpoint folder.

    Combined map-side, so a row delivered very often is one row per map task.
    """
    rest = [F.first(k).alias(k) for k in df.columns if k not in by]
    return cut(df.groupBy(*by).agg(*rest) if rest else df.distinct())


def shards(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_shard: int = 65_536) -> DataFrame:
    """``df`` sorted by (keys, order) in shards of about ``rows_per_shard`` rows, written to the checkpoint folder.

    The column ``shard`` numbers the shards in order.  Rows equal in keys and order can't be parted, so copies are to be
    dropped before (``without_copies``); else they would all lie in one shard.
    """
    rows = df.count()
    n = max(min(shuffle_partitions(df.sparkSession), 1 + rows // 4096), 1 + rows // rows_per_shard)
    by = [F.col(k).asc_nulls_first() for k in (*keys, *order)]
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return cut(ranged.withColumn("shard", F.spark_partition_id()))


def of_busy(df: DataFrame, busy: DataFrame, n_busy: int, how: str = "left_semi") -> DataFrame:
    """Rows of the objects in ``busy`` (or of the others, ``left_anti``); the keys are broadcast up to a bound."""
    return df.join(F.broadcast(busy) if n_busy <= MAX_BROADCAST_KEYS else busy, KEY, how)


def time_shards(
    df: DataFrame, us: Column, rows_per_shard: int, *, halo_s: float = 0.0, halo_rows: int = 0, bin_s: float = BIN_S
) -> DataFrame:
    """``df`` with ``shard`` (int, 0 for an object's first), ``halo`` (row of an earlier shard, lent) and ``busy``.

    The halo of a shard holds at least the ``halo_rows`` rows before its first one and the ``halo_s`` seconds before
    those.  ``us`` is the row's time in microseconds.  Rows of an object within one bin of time stay together.
    """
    busy = cut(df.groupBy(*KEY).count().where(F.col("count") > rows_per_shard).select(*KEY))
    n_busy = busy.count()
    if not n_busy:
        return df.withColumns({"shard": F.lit(0), "halo": F.lit(False), "busy": F.lit(False)})
    width = int(bin_s * 1e6)
    binned = df.withColumn("__bin", ((us - F.pmod(us, F.lit(width))) / width).cast("bigint"))
    w = Window.partitionBy(*KEY).orderBy("__bin")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = [F.lead("own", i + 1).over(w) for i in range(halo_rows - int(-halo_s // bin_s))]
    bins = (
        of_busy(binned, busy, n_busy)
        .groupBy(*KEY, "__bin")
        .agg(F.count("*").alias("n"))
        .withColumn("own", F.floor(before / rows_per_shard).cast("int"))
        .withColumn("targets", F.array_distinct(F.array_compact(F.array("own", *later))))
        .select(*KEY, "__bin", "own", "targets")
    )
    return (
        binned.join(bins, [*KEY, "__bin"], "left")
        .withColumn("shard", F.explode(F.coalesce("targets", F.array(F.lit(0)))))
        .withColumns({"halo": F.coalesce(F.col("shard") > F.col("own"), F.lit(False)), "busy": F.col("own").isNotNull()})
        .drop("__bin", "own", "targets")
    )


def groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(values of ``by``, other columns as arrays) of the groups that lie side by side in a sorted partition."""
    held: list[pa.RecordBatch] = []
    held_key: tuple = ()

    def group() -> tuple[tuple, dict[str, np.ndarray]]:
        table = pa.Table.from_batches(held)
        return held_key, {k: table.column(k).to_numpy() for k in table.column_names if k not in by}

    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, dtype=bool)
        new[0] = True
        for k in by:
            v = b.column(b.schema.get_field_index(k))
            new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
        starts = [*np.flatnonzero(new).tolist(), b.num_rows]
        for start, stop in zip(starts, starts[1:], strict=False):
            key = tuple(b.column(b.schema.get_field_index(k))[start].as_py() for k in by)
            if held and key != held_key:
                yield group()
                held.clear()
            held_key = key
            held.append(b.slice(start, stop - start))
    if held:
        yield group()


class Reach:
    """Finds the first of ``run`` points in a row that are all out of reach of a place.

    Distances are compared as chords of the unit sphere.  Blocks of points that lie within reach as a whole are passed
    over by their circle, so the cost hardly depends on how long the points stay within reach.
    """

    BLOCK = 64

    def __init__(self, x: np.ndarray, y: np.ndarray, radius_m: float, run: int, earth_m: float):
        self.u, self.run, self.n = unit(x, y), run, len(x)
        self.limit = 2 * np.sin(min(radius_m / earth_m, np.pi) / 2)
        blocks = -(-self.n // self.BLOCK) if self.n else 0
        at = np.arange(blocks) * self.BLOCK
        sums = np.add.reduceat(self.u, at, axis=0) if blocks else np.zeros((0, 3))
        sizes = np.diff([*at, self.n])[:, None] if blocks else np.ones((0, 1))
        self.centers = sums / sizes
        spread = np.linalg.norm(self.u - np.repeat(self.centers, sizes[:, 0].astype(int), axis=0), axis=1)
        self.spreads = np.maximum.reduceat(spread, at) if blocks else np.zeros(0)

    def far(self, place: np.ndarray, start: int, stop: int) -> np.ndarray:
        d = self.u[start:stop] - place
        return np.einsum("ij,ij->i", d, d) > self.limit * self.limit

    def lag(self, by: int) -> np.ndarray:
        """Whether point i + by is out of reach of point i, for all i (False beyond the end)."""
        out = np.zeros(self.n, dtype=bool)
        if by < self.n:
            d = self.u[by:] - self.u[:-by]
            out[: self.n - by] = np.einsum("ij,ij->i", d, d) > self.limit * self.limit
        return out

    def _within(self, place: np.ndarray, start: int, stop: int) -> int:
        away = self.far(place, start, min(self.n, stop + self.run - 1))
        all_away = away
        for i in range(1, self.run):
            all_away = all_away[:-1] & away[i:]
        at = int(all_away.argmax()) if len(all_away) else 0
        return start + at if len(all_away) and all_away[at] else -1

    def first(self, place: np.ndarray, start: int, stop: int | None = None) -> int:
        """First k in [start, stop) with points k to k + run - 1 all out of reach; ``stop`` (or n) if there is none."""
        stop = self.n if stop is None else stop
        if start >= stop:
            return stop
        block = start // self.BLOCK + 1
        k = self._within(place, start, min(stop, block * self.BLOCK))
        while k < 0 and block * self.BLOCK < stop:
            upto = min(block + 512, len(self.centers))
            gap = np.linalg.norm(self.centers[block:upto] - place, axis=1) + self.spreads[block:upto]
            for b in (np.flatnonzero(gap > self.limit - 1e-13) + block).tolist():
                if b * self.BLOCK >= stop:
                    break
                k = self._within(place, b * self.BLOCK, min(stop, (b + 1) * self.BLOCK))
                if k >= 0:
                    break
            block = upto
        return stop if k < 0 else min(k, stop)


def unit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Points of the unit sphere."""
    lon, lat = np.radians(x), np.radians(y)
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


class Scan(Protocol):
    """What an operator gives: all of it must be picklable."""

    def load(self, key: tuple, shard: int, cols: dict[str, np.ndarray]) -> Any:
        """The rows of one shard, made ready."""

    def summary(self, rows: Any, first: bool) -> Any:
        """What ``settle`` needs to know of a shard; ``first`` shards are entered with nothing."""

    def settle(self, entry: Hashable, summary: Any) -> Hashable | None:
        """State left behind by a shard entered with ``entry`` if the summary tells it, else None."""

    def cases(self, summary: Any) -> list[Hashable]:
        """The states the shard may leave behind, if they are few."""

    def run(self, rows: Any, entry: Hashable | None, last: bool, emit: Callable[..., None] | None) -> Hashable:
        """Works off a shard and gives the state left behind; ``last``: the object has no further rows."""


def _passes(prepared: DataFrame, op: Scan, ask: dict | None) -> dict[tuple, Any]:
    """Summaries of all shards of busy objects (``ask`` None), or exits of the shards and entries in ``ask``."""
    busy = prepared.where("busy")
    asked = prepared.sparkSession.sparkContext.broadcast(ask) if ask is not None else None

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*key, shard), cols in groups(batches, [*KEY, "shard"]):
            if asked is None:
                got = op.summary(op.load(tuple(key), shard, cols), shard == 0)
            elif (*key, shard) in asked.value:
                rows = op.load(tuple(key), shard, cols)
                got = {entry: op.run(rows, entry, False, None) for entry in asked.value[(*key, shard)]}
            else:
                continue
            yield pa.RecordBatch.from_pydict({"got": pa.array([pickle.dumps((*key, shard, got))], pa.binary())})

    rows = (pickle.loads(bytes(r.got)) for r in busy.mapInArrow(f, "got binary").collect())
    return {r[:3]: r[3] for r in rows}


def compose(prepared: DataFrame, op: Scan) -> tuple[dict[tuple, tuple], dict[tuple, Any], int]:
    """((namespace, object_id, shard) -> (entry state, last shard?)), summaries, passes taken, for busy objects."""
    summaries = _passes(prepared, op, None)
    by: dict[tuple, list[int]] = defaultdict(list)
    for *key, shard in summaries:
        by[tuple(key)].append(shard)
    known: dict[tuple, dict] = defaultdict(dict)
    passes = 1
    while True:
        entries: dict[tuple, tuple] = {}
        ask: dict[tuple, list] = {}
        for key, found in by.items():
            found.sort()
            state: Any = None
            maybe: list[Hashable] = []
            lost = False
            for i, shard in enumerate(found):
                at, summary = (*key, shard), summaries[*key, shard]
                if not lost:
                    entries[at] = (state, i == len(found) - 1)
                    left = op.settle(state, summary)
                    if left is None:
                        left = known[at].get(state)
                    if left is None and i < len(found) - 1:
                        ask[at], lost = [state], True
                    state = left
                    continue
                # the state before isn't known yet: ask about those it may be, in the same pass
                left = op.settle(None, summary)
                if left is not None:
                    maybe = [left]
                    continue
                prior = op.cases(summaries[*key, found[i - 1]]) or maybe
                maybe = list(dict.fromkeys([*prior, *maybe]))
                maybe = maybe if len(maybe) <= MAX_CASES else []
                todo = [m for m in maybe if m not in known[at] and op.settle(m, summary) is None]
                if passes == 1 and todo:
                    ask[at] = todo
        if not ask:
            return entries, summaries, passes
        for at, got in _passes(prepared, op, ask).items():
            known[at].update(got)
        passes += 1


def scan(
    prepared: DataFrame,
    op: Scan,
    schema: str,
    extra: Callable[[dict[tuple, Any]], dict[tuple, Any]] | None = None,
) -> DataFrame:
    """Runs ``op`` over time shards sorted by (namespace, object_id, shard, time); ``emit(*values)`` gives rows of ``schema``.

    ``prepared`` must be cut (it is run over more than once).  ``extra`` makes values per shard out of all summaries, which
    ``op.load`` then finds as ``op.extra``.
    """
    entries, summaries, _ = compose(prepared, op)
    op.extra = extra(summaries) if extra else {}
    entering = prepared.sparkSession.sparkContext.broadcast((entries, op.extra))  # a state per shard of a busy object
    op.extra = {}
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        states, op.extra = entering.value

        def emit(*values: Any) -> None:
            out.append(values)

        def batch() -> pa.RecordBatch:
            cols = zip(*out, strict=True)
            b = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, arrow, strict=True)], schema=arrow)
            out.clear()
            return b

        for (*key, shard), cols in groups(batches, [*KEY, "shard"]):
            entry, last = states.get((*key, shard), (None, True))
            op.run(op.load(tuple(key), shard, cols), entry, last, emit)
            if len(out) > 20_000:
                yield batch()
        if out:
            yield batch()

    return prepared.mapInArrow(f, schema)
