"""Facade over an append-only table of updates: writes append rows, reads are lazy DataFrames."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftline.config import Config
from driftline.errors import ClosedError
from driftline.functions import namespaces, validate
from driftline.operators import geometry, history, spatial
from driftline.operators import stats as counters
from driftline.operators.change_feed import replay
from driftline.session import cut, shared_folder, ship_package

SCHEMA = (
    "namespace string, object_id string, op string, seq bigint, ts timestamp, x double, y double, z double,"
    " metadata string"
)
ROW = ["namespace", "object_id", "op", "seq", "ts", "x", "y", "z", "metadata"]

#: Appended frames that are kept side by side in memory before they are made one.
MAX_FRAMES = 16


class Engine:
    """``Engine(spark)`` keeps updates in memory, ``Engine(spark, path)`` in Parquet partitioned by namespace.

    Small writes are buffered on the driver and flushed as one append; bulk loads go through ``append``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, config: Config | None = None):
        ship_package(spark)
        self.spark, self.path, self.config = spark, path, config or Config()
        self._held: list[tuple] = []
        self._frames: list[DataFrame] = []
        self._closed = False
        self._upserts = 0
        self._seq = 0
        self._state: DataFrame | None = None  # current state of the records with seq < _applied
        self._applied = 0
        if path is not None:
            try:
                self._seq = spark.read.parquet(path).agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
            except Exception as e:  # noqa: BLE001 - no table yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise

    # --- writing

    def _open(self) -> None:
        if self._closed:
            raise ClosedError("the engine is closed")

    def _add(self, namespace: str, object_id: str, op: str, us: int | None, at: tuple, metadata: str | None) -> None:
        self._held.append((namespace, object_id, op, self._seq, us, *at, metadata))
        self._seq += 1

    def upsert(
        self,
        namespace: str,
        object_id: str,
        position: Sequence[float],
        metadata: Any = None,
        timestamp: float | None = None,
    ) -> None:
        import json

        self._open()
        validate.identifier(namespace, "namespace")
        validate.identifier(object_id, "object id")
        at = validate.point_3d(*position) if len(position) == 3 else (*validate.point(*position), 0.0)
        us = validate.seconds(time.time() if timestamp is None else timestamp)
        self._add(namespace, object_id, "U", us, at, json.dumps(metadata))
        self._upserts += 1

    update_location = upsert

    def delete(self, namespace: str, object_id: str) -> None:
        self._open()
        validate.identifier(namespace, "namespace")
        validate.identifier(object_id, "object id")
        self._add(namespace, object_id, "T", None, (None, None, None), None)

    def insert_trajectory(self, namespace: str, object_id: str, points: Sequence[tuple[float, float, float]]) -> None:
        """(x, y, epoch seconds) rows; altitude 0 and empty metadata; the whole batch is validated first."""
        self._open()
        validate.identifier(namespace, "namespace")
        validate.identifier(object_id, "object id")
        rows = [(*validate.point(x, y), validate.seconds(t)) for x, y, t in points]
        for x, y, us in rows:
            self._add(namespace, object_id, "U", us, (x, y, 0.0), "{}")
            self._upserts += 1

    def append(self, updates: DataFrame) -> DataFrame:
        """Bulk append of update rows that already carry ``seq``; gives the refused rows with their problem."""
        self._open()
        good, bad = validate.quarantine(updates)
        good = good.select(*ROW)
        ends = [F.min("seq").alias("lo"), F.max("seq").alias("hi")]
        if self.path is None:
            good = cut(good)
            self._frames.append(good)
            lo, hi = good.agg(*ends).first()
        else:  # the range of seq is watched while the rows are written
            seen = Observation()
            good.observe(seen, *ends).write.mode("append").partitionBy("namespace").parquet(self.path)
            lo, hi = seen.get["lo"], seen.get["hi"]
        if lo is not None:
            self._seq = max(self._seq, hi + 1)
            if lo < self._applied:  # older than the kept state
                self._state, self._applied = None, 0
        return bad

    def flush(self) -> None:
        if not self._held:
            return
        raw = self.spark.createDataFrame(self._held, SCHEMA.replace("ts timestamp", "ts bigint"))
        df = raw.withColumn("ts", F.timestamp_micros("ts")).select(*ROW)
        if self.path is None:
            self._frames.append(df)
        else:
            df.write.mode("append").partitionBy("namespace").parquet(self.path)
        self._held = []

    def close(self) -> None:
        self.flush()
        self._closed = True

    # --- reading

    def updates(self) -> DataFrame:
        self.flush()
        if len(self._frames) > MAX_FRAMES:
            self._frames = [cut(reduce(DataFrame.unionByName, self._frames))]
        frames = list(self._frames)
        if self.path is not None:
            try:
                frames.append(self.spark.read.parquet(self.path).select(*ROW))
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        out = self.spark.createDataFrame([], SCHEMA)
        for f in frames:
            out = out.unionByName(f)
        return out

    def current(self) -> DataFrame:
        """The kept current state, brought up to date by the records since the last read.

        It is a Parquet table by namespace in the shared folder, so namespace and envelope of a query reach its scan.
        """
        self._open()
        updates = self.updates()
        if self._state is None or self._applied < self._seq:
            new = updates.where(F.col("seq") >= self._applied)
            state = replay(new, self._state, tie=self.config.tie, batches=self.config.replay_batches)
            folder = shared_folder(self.spark)
            state.write.partitionBy("namespace").parquet(folder)
            self._state = self.spark.read.schema(state.schema).parquet(folder).select(*state.columns)
            self._applied = self._seq
        return self._state

    def get(self, namespace: str, object_id: str) -> DataFrame:
        return self.current().where((F.col("namespace") == namespace) & (F.col("object_id") == object_id))

    def query_radius(self, namespace: str, center: Sequence[float], radius: float, limit: int | None = 100) -> DataFrame:
        return spatial.radius_3d(self.current(), namespace, center, radius, limit, envelope=self.config.envelope)

    def query_near(self, namespace: str, object_id: str, radius: float, limit: int | None = 100) -> DataFrame:
        return spatial.near_object(self.current(), namespace, object_id, radius, limit)

    def query_bbox(self, namespace: str, *box: float, limit: int | None = 100) -> DataFrame:
        return spatial.bbox(self.current(), namespace, *box, limit=limit)

    def query_bbox_3d(self, namespace: str, *box: float, limit: int | None = 100) -> DataFrame:
        return spatial.bbox_3d(self.current(), namespace, box[:3], box[3:], limit)

    def query_bbox_near_object(self, namespace: str, object_id: str, width: float, height: float, limit: int | None = 100) -> DataFrame:
        return spatial.bbox_near_object(self.current(), namespace, object_id, width, height, limit)

    def query_bbox_3d_near_object(
        self, namespace: str, object_id: str, width: float, height: float, depth: float, limit: int | None = 100
    ) -> DataFrame:
        return spatial.bbox_3d_near_object(self.current(), namespace, object_id, width, height, depth, limit)

    def query_cylinder(
        self, namespace: str, center: Sequence[float], min_z: float, max_z: float, radius: float, limit: int | None = 100
    ) -> DataFrame:
        return spatial.cylinder(self.current(), namespace, center, min_z, max_z, radius, limit)

    def query_cylinder_near_object(
        self, namespace: str, object_id: str, min_z: float, max_z: float, radius: float, limit: int | None = 100
    ) -> DataFrame:
        return spatial.cylinder_near_object(self.current(), namespace, object_id, min_z, max_z, radius, limit)

    def query_polygon(self, namespace: str, exterior: Sequence, interiors: Sequence = (), limit: int | None = 100) -> DataFrame:
        return spatial.polygon(self.current(), namespace, exterior, interiors, limit)

    contains = query_polygon

    def knn(self, namespace: str, center: Sequence[float], k: int, metric: str = "index") -> DataFrame:
        return spatial.knn(self.current(), namespace, center, k, metric=metric)

    def knn_near_object(self, namespace: str, object_id: str, k: int) -> DataFrame:
        return spatial.knn_near_object(self.current(), namespace, object_id, k)

    def query_trajectory(
        self, namespace: str, object_id: str, start: float | None = None, end: float | None = None, limit: int | None = 100
    ) -> DataFrame:
        self._open()
        return history.trajectory(self.updates(), namespace, object_id, start, end, limit)

    def distance(self, namespace: str, a: str, b: str, metric: str = "haversine") -> float | None:
        row = spatial.distance_between(self.current(), namespace, a, b, metric).first()
        return None if row is None else row[0]

    def distance_to(self, namespace: str, object_id: str, x: float, y: float, metric: str = "haversine") -> float | None:
        row = spatial.distance_to(self.current(), namespace, object_id, x, y, metric).first()
        return None if row is None else row[0]

    def convex_hull(self, namespace: str) -> DataFrame:
        return geometry.convex_hull(spatial.of_namespace(self.current(), namespace))

    def bounding_box(self, namespace: str) -> DataFrame:
        return geometry.extent(spatial.of_namespace(self.current(), namespace))

    def namespaces(self) -> DataFrame:
        return namespaces.counts(self.current())

    def stats(self) -> DataFrame:
        """Works after ``close`` too."""
        updates = self.updates()
        state = self._state if self._state is not None and self._applied == self._seq else replay(updates, tie=self.config.tie)
        return counters.stats(updates, state, self.config.buffer_capacity)
