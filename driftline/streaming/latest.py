"""Current state of a stream of updates.

``latest_state``: inserts and updates only, as a native stateful aggregation (the state never expires, since late
records may come at any time).  ``latest_state_with_deletes``: the full semantics with tombstones, one small state per
object in the state store.  ``apply_batches``: micro-batches folded into a versioned snapshot table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftline.functions.geo import usable
from driftline.operators.change_feed import KEY, replay, valid_identifier

STATE = "ts bigint, seq bigint, x double, y double, z double, metadata string"
OUT = "namespace string, object_id string, op string, us bigint, seq bigint, x double, y double, z double, metadata string"


def applicable(updates: DataFrame) -> DataFrame:
    """Records that may change the state."""
    ok = (F.col("op") == "T") | ((F.col("op") == "U") & F.col("ts").isNotNull() & usable())
    return updates.where(ok & valid_identifier("object_id") & F.col("namespace").isNotNull() & F.col("seq").isNotNull())


def latest_state(updates: DataFrame) -> DataFrame:
    """Latest U record per object by (ts, seq); use output mode complete or update."""
    row = F.struct("ts", "seq", "x", "y", "z", "metadata")
    live = applicable(updates).where(F.col("op") == "U")
    return live.groupBy(*KEY).agg(F.max(row).alias("r")).select(*KEY, "r.*")


class LatestWithDeletes(StatefulProcessor):
    """Keeps the winning image and the last tombstone of an object; emits its state after each batch that touches it.

    Records may arrive in any order of ``seq`` across batches: a tombstone only removes images older than itself, so the
    images that a later tombstone would uncover need not be kept - none can be older and survive.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._image = handle.getListState("images", STATE)
        self._gone = handle.getValueState("gone", "seq bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gone = self._gone.get()[0] if self._gone.exists() else -1
        images = [tuple(r) for r in self._image.get()] if self._image.exists() else []
        for pdf in rows:
            dead = pdf.loc[pdf["op"] == "T", "seq"]
            gone = max(gone, int(dead.max())) if len(dead) else gone
            live = pdf.loc[(pdf["op"] == "U") & (pdf["seq"] > gone)]
            for r in live[["us", "seq", "x", "y", "z", "metadata"]].itertuples(index=False, name=None):
                images.append((int(r[0]), int(r[1]), *r[2:]))
        # Of the images that survive, one that is older in both time and order can never win again.
        best: list[tuple] = []
        for image in sorted({i for i in images if i[1] > gone}, key=lambda i: (-i[1], -i[0])):
            if not best or image[0] > best[-1][0]:
                best.append(image)
        self._gone.update((gone,))
        if best:
            self._image.put(best)
        else:
            self._image.clear()
        top = max(best, key=lambda i: (i[0], i[1]), default=None)
        at = (None, gone, None, None, None, None) if top is None else top
        yield pd.DataFrame(
            [[*key, "T" if top is None else "U", *at]],
            columns=["namespace", "object_id", "op", "us", "seq", "x", "y", "z", "metadata"],
        ).astype({"us": "Int64"})

    def close(self) -> None:
        pass


def latest_state_with_deletes(updates: DataFrame) -> DataFrame:
    """Changes of the state (op U with its image, or T); needs the RocksDB state store and output mode update."""
    rows = applicable(updates).select(*KEY, "op", F.unix_micros("ts").alias("us"), "seq", "x", "y", "z", "metadata")
    return rows.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=LatestWithDeletes(), outputStructType=OUT, outputMode="Update", timeMode="None"
    )


def apply_batches(updates: DataFrame, folder: str, checkpoint: str) -> Any:
    """Starts a query that keeps all records under ``folder/updates`` and a fresh ``folder/state_<batch>`` per batch.

    A batch whose records are all newer (by seq) than those before is applied to the last state alone; only a batch with
    older records makes the state anew from all records.  Appends are idempotent: each batch is written to its own
    partition, so a restarted batch replaces itself.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch_id}")
        new = spark.read.schema(batch.schema).parquet(f"{folder}/updates/batch={batch_id}")
        whole = spark.read.parquet(f"{folder}/updates")
        lo, before = whole.agg(
            F.min(F.when(F.col("batch") == batch_id, F.col("seq"))), F.max(F.when(F.col("batch") < batch_id, F.col("seq")))
        ).first()
        if before is not None and (lo is None or lo > before):
            state = replay(new, spark.read.parquet(f"{folder}/state_{batch_id - 1}"))
        else:
            state = replay(whole.where(F.col("batch") <= batch_id))
        state.write.mode("overwrite").parquet(f"{folder}/state_{batch_id}")

    return updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
