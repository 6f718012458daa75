"""Grid cells for spatial equi-joins.

``sphere_*``: rows of latitude, each with its own number of columns so that a column is never narrower
than the cell size; columns wrap at the date line and thin out towards the poles, so closeness on the globe
always means equal or neighbouring cells.

``plane_*``: nested square cells in plain degrees; a box lives on the level whose cells are at least as
large as the box, so it covers at most four cells whatever its size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.constants import EARTH_RADIUS_M
from driftline.session import cut

MAX_PLANE_LEVEL = 24
#: Home rows of one cell that are handled together.
CROWD = 4096
#: Crowded cells up to which their list is broadcast.
MAX_BROADCAST_CELLS = 50_000


class SphereGrid:
    """Cells for joins within ``radius`` metres: ``cell`` is twice the radius, so a ball meets few cells."""

    def __init__(self, radius: float):
        self.radius = float(radius)
        self.angle = min(self.radius / EARTH_RADIUS_M, math.pi) * (1 + 1e-9) + 1e-12
        self.dlat = math.degrees(self.angle)
        self.height = max(2 * self.dlat, 1e-7)
        self.rows = max(1, math.ceil(180.0 / self.height))

    def row(self, lat: Column) -> Column:
        r = F.floor((lat + 90.0) / self.height)
        return F.greatest(F.lit(0), F.least(F.lit(self.rows - 1), r)).cast("int")

    def columns(self, row: Column) -> Column:
        """Number of columns of a row, by its latitude nearest to a pole."""
        low, high = row * F.lit(self.height) - 90.0, (row + 1) * F.lit(self.height) - 90.0
        worst = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
        return F.greatest(F.lit(1), F.floor(F.cos(F.radians(worst)) * 360.0 / self.height)).cast("bigint")

    def column(self, lon: Column, row: Column) -> Column:
        n = self.columns(row)
        return F.pmod(F.floor((lon + 180.0) / 360.0 * n), n)

    def home(self, df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """Adds the cell of each point: ``g_row``, ``g_col``."""
        df = df.withColumn("g_row", self.row(F.col(y)))
        return df.withColumn("g_col", self.column(F.col(x), F.col("g_row")))

    def reach(self, df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """One row for each cell that the ball around the point may meet."""
        lat, lon = F.col(y), F.col(x)
        polar = (F.abs(lat) + self.dlat >= 90.0) | F.lit(self.angle >= math.pi / 2)
        half = F.when(polar, F.lit(180.0)).otherwise(
            F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(self.angle, math.pi / 2))) / F.cos(F.radians(lat)))))
            * (1 + 1e-9)
            + 1e-9
        )
        df = df.withColumn(
            "g_row", F.explode(F.sequence(self.row(lat - self.dlat), self.row(lat + self.dlat)))
        ).withColumn("g_n", self.columns(F.col("g_row")))
        first = F.floor((lon - half + 180.0) / 360.0 * F.col("g_n"))
        last = F.least(F.floor((lon + half + 180.0) / 360.0 * F.col("g_n")), first + F.col("g_n") - 1)
        return df.withColumn("g_col", F.explode(F.sequence(first, last))).withColumn(
            "g_col", F.pmod(F.col("g_col"), F.col("g_n"))
        ).drop("g_n")


def split_join(home: DataFrame, visitors: DataFrame, cell: list[str], key: str, crowd: int = CROWD) -> DataFrame:
    """Join of rows that stay in their cell with rows that visit it, on ``cell``.

    Cells with more than ``crowd`` home rows are split: their home rows are spread over sub-cells by a hash of ``key``, and
    only the visitors of those cells are copied, so one cell never becomes one task.
    """
    crowded = cut(
        home.groupBy(*cell)
        .count()
        .where(F.col("count") > crowd)
        .select(*cell, F.ceil(F.col("count") / crowd).cast("int").alias("g_parts"))
    )
    n = crowded.count()
    if not n:
        return home.join(visitors, cell)
    crowded = F.broadcast(crowded) if n <= MAX_BROADCAST_CELLS else crowded
    parts = F.coalesce(F.col("g_parts"), F.lit(1))
    a = home.join(crowded, cell, "left").withColumn("g_sub", F.pmod(F.xxhash64(key), parts).cast("int")).drop("g_parts")
    b = visitors.join(crowded, cell, "left").withColumn("g_sub", F.explode(F.sequence(F.lit(0), parts - 1))).drop("g_parts")
    return a.join(b, [*cell, "g_sub"]).drop("g_sub")


def plane_level(width: Column, height: Column) -> Column:
    """The finest level whose cells are at least as large as the box."""
    span = F.greatest(width, height, F.lit(360.0 / 2**MAX_PLANE_LEVEL))
    return F.greatest(F.lit(0), F.least(F.lit(MAX_PLANE_LEVEL), F.floor(F.log2(F.lit(360.0) / span)))).cast("int")


def plane_cell(v: Column, level: Column) -> Column:
    return F.floor((v + 180.0) * F.pow(F.lit(2.0), level) / 360.0)


def plane_boxes(df: DataFrame, min_x: str, min_y: str, max_x: str, max_y: str) -> DataFrame:
    """Boxes exploded to their cells: ``g_level``, ``g_x``, ``g_y``.  Inverted or non-finite boxes contain nothing."""
    finite = F.lit(True)
    for k in (min_x, min_y, max_x, max_y):
        finite &= ~F.isnan(k) & (F.abs(F.col(k)) < float("inf"))
    df = df.where(finite & (F.col(min_x) <= F.col(max_x)) & (F.col(min_y) <= F.col(max_y)))
    # usable points lie on the globe, so only that part of a box needs cells
    edge = {
        "g_x0": F.greatest(F.col(min_x), F.lit(-180.0)), "g_x1": F.least(F.col(max_x), F.lit(180.0)),
        "g_y0": F.greatest(F.col(min_y), F.lit(-90.0)), "g_y1": F.least(F.col(max_y), F.lit(90.0)),
    }
    df = df.withColumns(edge).where((F.col("g_x0") <= F.col("g_x1")) & (F.col("g_y0") <= F.col("g_y1")))
    df = df.withColumn("g_level", plane_level(F.col("g_x1") - F.col("g_x0"), F.col("g_y1") - F.col("g_y0")))
    for k in ("x", "y"):
        cells = F.sequence(*[plane_cell(F.col(f"g_{k}{i}"), F.col("g_level")) for i in (0, 1)])
        df = df.withColumn(f"g_{k}", F.explode(cells))
    return df.drop(*edge)


def plane_points(df: DataFrame, levels: list[int], x: str = "x", y: str = "y") -> DataFrame:
    """Points with one row per level that occurs among the boxes (at most 25)."""
    if not levels:
        return df.withColumn("g_level", F.lit(0)).withColumn("g_x", F.lit(0)).withColumn("g_y", F.lit(0)).limit(0)
    df = df.withColumn("g_level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])))
    return df.withColumn("g_x", plane_cell(F.col(x), F.col("g_level"))).withColumn(
        "g_y", plane_cell(F.col(y), F.col("g_level"))
    )
