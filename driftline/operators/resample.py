"""Irregular readings onto a regular grid, with shape-preserving interpolation.

Slots begin at multiples of the period.  Readings are first reduced to one value per (object, slot) with
map-side combination.  The filled slots of an object are cut into time shards of ``shard_slots`` slots, so
a busy object is spread over many tasks; each shard lends its first and last two filled slots to its
neighbours (the halo), found through a summary of one row per shard.  Within shard plus halo, window
functions give the monotone cubic's slopes and every gap is filled or, when it is long, only marked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geo import usable
from driftline.session import cut

KEY = ["namespace", "object_id"]
VALUES = ("x", "y", "z")


def slot_readings(readings: DataFrame, spec: DataFrame) -> DataFrame:
    """One row per filled slot: namespace, object_id, period_s, slot, t (epoch s of the value), x, y, z, n.

    The value of a slot is its last reading by (ts, seq).  A reading counts when ``ts`` is present and the
    position is usable; redelivered copies (same seq) are the same reading.
    """
    grid = (
        spec.where((F.col("period_s") > 0) & F.col("namespace").isNotNull())
        .groupBy("namespace")
        .agg(F.min("period_s").cast("bigint").alias("period_s"))
    )
    ok = readings.where(usable() & F.col("ts").isNotNull() & F.col("object_id").isNotNull())
    # grid_spec has one row per namespace: joined by size (broadcast when it is small, as Catalyst decides).
    ok = ok.select(*KEY, "seq", "x", "y", "z", F.unix_micros("ts").alias("us")).join(grid, "namespace")
    slot = F.expr("us - pmod(us, period_s * 1000000L)") / 1_000_000
    return (
        ok.withColumn("slot", slot.cast("bigint"))
        .groupBy(*KEY, "period_s", "slot")
        .agg(F.max(F.struct("us", "seq", *VALUES)).alias("v"))
        .select(*KEY, "period_s", "slot", (F.col("v.us") / 1e6).alias("t"), *[F.col(f"v.{k}").alias(k) for k in VALUES])
    )


def _neighbours(filled: DataFrame, values: Sequence[str], shard_slots: int) -> DataFrame:
    """Each filled slot with its next (``n_``), previous (``p_``) and second next (``m_``) one.

    One shuffle by (object, time shard) settles all rows but the outermost two of a shard; those, four per
    shard at most, are settled by a second window over the shards' edges alone (the exchanged halo).
    """
    names = ["slot", "t", *values]
    f = filled.withColumn("shard", F.floor(F.col("slot") / (F.col("period_s") * shard_slots)))
    inner = Window.partitionBy(*KEY, "shard").orderBy("slot")
    outer = Window.partitionBy(*KEY).orderBy("slot")

    def near(w: Window) -> dict[str, Column]:
        return {f"n_{k}": F.lead(k).over(w) for k in names} | {
            f"{to}_{k}": fn(k, n).over(w) for k in names[1:] for to, fn, n in (("p", F.lag, 1), ("m", F.lead, 2))
        }

    done = f.withColumns(near(inner) | {"edge": F.lag("slot", 2).over(inner).isNull() | F.lead("slot", 2).over(inner).isNull()})
    done = cut(done)
    found = [k for k in done.columns if k[:2] in ("n_", "p_", "m_")]
    edge = done.where("edge")
    wide = near(outer)
    edge = edge.withColumns({f"o_{k}": wide[k] for k in found}).withColumns(
        {k: F.coalesce(F.col(k), F.col(f"o_{k}")) for k in found}
    )
    return done.where(~F.col("edge")).unionByName(edge.select(*done.columns)).drop("edge", "shard")


def _slope(hp: Column, hn: Column, dp: Column, dn: Column) -> Column:
    """Weighted harmonic mean of the neighbouring secants; zero at an extremum."""
    w1, w2 = 2 * hn + hp, hn + 2 * hp
    return F.when(dp * dn <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / dp + w2 / dn))


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Three-point slope at an end, limited so that the curve stays monotone."""
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(m * d0 <= 0, F.lit(0.0)).when((d0 * d1 <= 0) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)


def gaps(filled: DataFrame, values: Sequence[str] = VALUES, shard_slots: int = 4096) -> DataFrame:
    """Intervals between successive filled slots of an object, with the monotone cubic's slopes at both ends."""
    g = _neighbours(filled.select(*KEY, "period_s", "slot", "t", *values), values, shard_slots)
    g = g.where(F.col("n_slot").isNotNull())
    hc, hp, hn = F.col("n_t") - F.col("t"), F.col("t") - F.col("p_t"), F.col("m_t") - F.col("n_t")
    out = {}
    for k in values:
        d = (F.col(f"n_{k}") - F.col(k)) / hc
        dp = (F.col(k) - F.col(f"p_{k}")) / hp
        dn = (F.col(f"m_{k}") - F.col(f"n_{k}")) / hn
        no_p, no_n = F.col("p_t").isNull(), F.col("m_t").isNull()
        out[f"s0_{k}"] = (
            F.when(no_p & no_n, d).when(no_p, _end_slope(hc, hn, d, dn)).otherwise(_slope(hp, hc, dp, d))
        )
        out[f"s1_{k}"] = (
            F.when(no_p & no_n, d).when(no_n, _end_slope(hc, hp, d, dp)).otherwise(_slope(hc, hn, d, dn))
        )
    keep = [*KEY, "period_s", "slot", "t", "n_slot", "n_t", *values, *[f"n_{k}" for k in values]]
    return g.withColumns(out).select(*keep, *out)


def missing_slots(gap: DataFrame, pieces: int = 4096) -> DataFrame:
    """One row per slot without a reading; very long gaps are opened in two steps so that no row explodes at once."""
    p = F.col("period_s")
    first, last = F.col("slot") + p, F.col("n_slot") - p
    return (
        gap.where(F.col("n_slot") > first)
        .withColumn("from", F.explode(F.sequence(first, last, p * pieces)))
        .withColumn("slot_start", F.explode(F.sequence("from", F.least(last, F.col("from") + p * (pieces - 1)), p)))
        .drop("from")
    )


def regular_series(
    readings: DataFrame, spec: DataFrame, *, max_gap_slots: int = 6, shard_slots: int = 4096
) -> DataFrame:
    """The regular series of each object: namespace, object_id, slot_start, x, y, z, status.

    ``status``: ``reading`` (the slot's last reading), ``filled`` (monotone cubic at the slot's start) or
    ``missing`` (marked, null position) in gaps longer than ``max_gap_slots``.  Every slot from the object's
    first to its last filled one has exactly one row.

    Defined cases: deletes don't hide readings; null ``ts``, null keys and unusable positions fill no slot;
    namespaces without a (positive) period and objects with no usable reading have no series; an object with
    one filled slot has that one row; longitudes are interpolated as given, across the date line as missing.
    """
    filled = slot_readings(readings.where(F.col("op") == "U"), spec)
    gap = missing_slots(gaps(filled, VALUES, shard_slots))
    hc = F.col("n_t") - F.col("t")
    s = (F.col("slot_start") - F.col("t")) / hc
    short = ((F.col("n_slot") - F.col("slot")) / F.col("period_s") - 1 <= max_gap_slots) & (
        F.abs(F.col("n_x") - F.col("x")) <= 180
    )
    vals = []
    for k in VALUES:
        v = (
            (1 + 2 * s) * (1 - s) * (1 - s) * F.col(k)
            + s * (1 - s) * (1 - s) * hc * F.col(f"s0_{k}")
            + s * s * (3 - 2 * s) * F.col(f"n_{k}")
            + s * s * (s - 1) * hc * F.col(f"s1_{k}")
        )
        vals.append(F.when(short, v).alias(k))
    empty = gap.select(*KEY, "slot_start", *vals, F.when(short, "filled").otherwise("missing").alias("status"))
    full = filled.select(*KEY, F.col("slot").alias("slot_start"), *VALUES, F.lit("reading").alias("status"))
    return full.unionByName(empty)


def unfilled_slots(readings: DataFrame, spec: DataFrame, shard_slots: int = 4096) -> DataFrame:
    """namespace, object_id, slot_start of each period without a reading between an object's first and last one.

    Taken from the regular series; a filled period whose values aren't numbers stops the query.
    """
    s = regular_series(readings, spec, shard_slots=shard_slots).where(F.col("status") != "reading")
    lacks = F.lit(False)
    for k in VALUES:
        lacks |= F.col(k).isNull() | F.isnan(k)
    wrong = (F.col("status") == "filled") & lacks
    slot = F.when(wrong, F.raise_error(F.lit("filled slot without a value")).cast("bigint")).otherwise(F.col("slot_start"))
    return s.select(*KEY, slot.alias("slot_start"))
