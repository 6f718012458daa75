"""Replaying a change feed: current state by newest-first resolution.

The feed is cut into batches by ranges of ``seq`` (quantiles, so a far-off ``seq`` doesn't matter), written once by batch, and the
batches are worked off from the newest to the oldest.  Before a batch is aggregated, its rows are anti-joined with the keys that
are *resolved* already, so a feed that repeats its keys costs less with every batch.  A key is resolved

* by the newest tombstone: nothing older matters; only images behind it are kept;
* by its image, once no older record can have a later time: every older batch has a bound that all but a few of
  its times keep to (``LATE``); keys of the few older records beyond it stay open until those are met.

Of every batch the first-seen images are recorded, reduced to one row per key with map-side combination, so a key that
holds a large share of the feed costs no more than any other one.  At the end the winning image of every key is taken and base
rows that no batch touched are appended.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import usable
from driftline.session import cut, shared_folder

KEY = ["namespace", "object_id"]
# What an identifier may not contain.
FORBIDDEN_IN_ID = r"[|\n\r]|::"
#: Rows from which a feed gets more than two batches: one more for each doubling.
BATCH_ROWS = 1_000_000
#: Quantiles of ``seq`` that are borders of batches.
GRID = 64
#: Share of a batch's records whose time keeps to the batch's bound.
LATE = 0.99
#: Keys up to which a list of them is broadcast (some 20 MB); longer lists are joined by shuffle.
MAX_BROADCAST_KEYS = 200_000


def valid_identifier(col: str) -> Column:
    """Present, not empty and free of the log's separators."""
    return F.coalesce((F.col(col) != "") & ~F.col(col).rlike(FORBIDDEN_IN_ID), F.lit(False))


def _with_keys(df: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
    return df.join(F.broadcast(keys) if n <= MAX_BROADCAST_KEYS else keys, KEY, how)


def replay(
    feed: DataFrame,
    base: DataFrame | None = None,
    *,
    payload: Sequence[str] = ("x", "y", "z", "metadata"),
    batches: int | None = None,
    tie: str = "last",
    on_batch: Callable[[int, DataFrame], None] | None = None,
) -> DataFrame:
    """State of each object at the end of ``feed``: namespace, object_id, ts, seq and ``payload``.

    In ``seq`` order a T removes the object whatever the times; a U replaces the state unless the present
    state has a later ``ts``; with equal ``ts`` the later ``seq`` wins (``tie='last'``) or the earlier one
    (``tie='first'``).  A U after a T creates the object again, also with an older ``ts``.

    Defined cases: records with a null ``seq`` or ``namespace`` or a malformed ``object_id``, and U records
    with null ``ts`` or an unusable position, are never applied; redelivered records (same ``seq``) count
    once; ``op`` other than U and T is ignored; an empty feed gives the base rows, or none; further columns
    of the feed are ignored.  ``base`` holds earlier state rows (same columns); their ``seq``, if they have one,
    is older than the feed.  An object of ``base`` without a record in the feed is appended as it is.
    ``batches`` follows from the number of rows unless given; it doesn't change the result.  ``on_batch`` is shown the
    rows of each batch that are left to aggregate.
    """
    if tie not in ("last", "first"):
        raise ValueError("tie is 'last' or 'first'")
    applied = (
        feed.where(valid_identifier("object_id") & F.col("namespace").isNotNull() & F.col("seq").isNotNull())
        .where((F.col("op") == "T") | ((F.col("op") == "U") & F.col("ts").isNotNull() & usable()))
        .select(*KEY, "op", "seq", "ts", *payload)
    )
    spark = feed.sparkSession
    grid = F.percentile_approx("seq", [i / GRID for i in range(1, GRID)])
    rows, quantiles = feed.agg(F.count("seq"), grid).first()
    n = batches or 2 + int(math.log2(1 + rows / BATCH_ROWS))
    borders = sorted({quantiles[i * GRID // n - 1] for i in range(1, min(n, GRID))}) if quantiles else []
    batch = reduce(lambda c, b: c + (F.col("seq") > b).cast("int"), borders, F.lit(0))
    folder = shared_folder(spark)
    applied.withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
    table = spark.read.schema(applied.withColumn("batch", F.lit(0)).schema).parquet(folder)
    us = F.unix_micros("ts")
    live_ts = F.when(F.col("op") == "U", us)
    late = {r.batch: r.b for r in table.groupBy("batch").agg(F.percentile_approx(live_ts, LATE).alias("b")).collect()}
    bound = reduce(lambda c, kv: c.when(F.col("batch") == kv[0], kv[1]), [kv for kv in late.items() if kv[1] is not None], F.when(F.lit(False), F.lit(0)))
    odd = table.where(live_ts > bound).select(*KEY, us.alias("us"), "batch")
    if base is not None:
        late[-1] = base.agg(F.percentile_approx(us, LATE)).first()[0]
        if late[-1] is not None:
            odd = odd.unionByName(base.where(us > late[-1]).select(*KEY, us.alias("us"), F.lit(-1).alias("batch")))
    odd = cut(odd)

    order = F.col("seq") if tie == "last" else -F.col("seq")
    image = F.struct("ts", order.alias("ord"), "seq", *payload)
    updates = F.col("op") == "U"
    images: list[DataFrame] = []
    gone: list[DataFrame] = []
    resolved, n_resolved = None, 0
    for b in sorted((k for k in late if k >= 0), reverse=True):
        live = table.where(F.col("batch") == b)
        if n_resolved:
            live = _with_keys(live, resolved, n_resolved, "left_anti")
        if on_batch is not None:
            on_batch(b, live)
        # When the batch's best image is newer than its last delete it is the right one; only where it is older must the
        # images behind the delete be looked at again.
        per = cut(
            live.groupBy(*KEY).agg(F.max(F.when(~updates, F.col("seq"))).alias("gone"), F.max(F.when(updates, image)).alias("image"))
        )
        stale = F.coalesce(F.col("image.seq") < F.col("gone"), F.lit(False))
        recheck = per.where(stale).select(*KEY, "gone")
        n_stale = recheck.count()
        images.append(per.where(F.col("image").isNotNull() & ~stale).select(*KEY, "image"))
        if n_stale:
            behind = _with_keys(live.where(updates), recheck, n_stale, "inner").where(F.col("seq") > F.col("gone"))
            images.append(cut(behind.groupBy(*KEY).agg(F.max(image).alias("image"))))
        gone.append(per.where(F.col("gone").isNotNull()).select(*KEY))
        older = [v for k, v in late.items() if k < b and v is not None]
        if any(k < b and k >= 0 for k in late):
            best = F.unix_micros("image.ts")
            enough = F.lit(True) if not older else best >= max(older) if tie == "last" else best > max(older)
            final = reduce(DataFrame.unionByName, images).where(enough).select(*KEY)
            if older:
                final = final.join(odd.where((F.col("batch") < b) & (F.col("us") > max(older))).select(*KEY), KEY, "left_anti")
            resolved = cut(reduce(DataFrame.unionByName, [*gone, final]).distinct())
            n_resolved = resolved.count()
    empty = applied.select(*KEY, image.alias("image")).limit(0)
    found = reduce(DataFrame.unionByName, images, empty)
    columns = ["ts", "seq", *payload]
    untouched = None
    if base is not None:
        dead = reduce(DataFrame.unionByName, gone, empty.select(*KEY)).distinct()
        touched = cut(found.select(*KEY).unionByName(dead).distinct())
        n_touched = touched.count()
        old = F.struct(
            "ts",
            (F.coalesce("seq", F.lit(-1)) if tie == "last" else F.coalesce(-F.col("seq"), F.lit(1))).cast("bigint").alias("ord"),
            F.col("seq").cast("bigint").alias("seq"),
            *payload,
        )
        met = _with_keys(base, touched, n_touched, "left_semi").join(dead, KEY, "left_anti")
        found = found.unionByName(met.select(*KEY, old.alias("image")))
        untouched = _with_keys(base, touched, n_touched, "left_anti").select(*KEY, "ts", F.col("seq").cast("bigint").alias("seq"), *payload)
    state = found.groupBy(*KEY).agg(F.max("image").alias("image")).select(*KEY, *[F.col("image")[c].alias(c) for c in columns])
    return state if untouched is None else state.unionByName(untouched)
