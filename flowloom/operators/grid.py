"""Grid index queries: points in fixed cells, asked for by circle, box or place.

A query names the cells that it touches and says of each whether it lies wholly inside: points of such cells are taken as they are, those of cells on
the rim are tested. Cells are clamped to the grid, as points outside it lie in its border cells, so border cells are always tested.
The index is a DataFrame with a cell column; laid out by cell (`stored`), a query reads the cells it names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.geo import length2


@dataclass(frozen=True)
class Grid:
    """Cells of width `step` from (low_x, low_y) on, m by n of them."""

    low_x: float = -180.0
    low_y: float = -90.0
    high_x: float = 180.0
    high_y: float = 90.0
    step: float = 5.0

    @property
    def m(self) -> int:
        return math.ceil((self.high_x - self.low_x) / self.step)

    @property
    def n(self) -> int:
        return math.ceil((self.high_y - self.low_y) / self.step)

    def _cell(self, v: Column, low: float, cells: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((v - F.lit(low)) / F.lit(self.step)), F.lit(cells - 1))).cast("long")

    def i(self, x: Column) -> Column:
        return self._cell(x, self.low_x, self.m)

    def j(self, y: Column) -> Column:
        return self._cell(y, self.low_y, self.n)

    def index(self, points: DataFrame) -> DataFrame:
        """points(x, y, ...) with cell_i, cell_j."""
        return points.withColumns({"cell_i": self.i(F.col("x")), "cell_j": self.j(F.col("y"))})

    def _cells(self, queries: DataFrame, outer: tuple[Column, ...], inner: tuple[Column, ...]) -> DataFrame:
        """Cells between the outer bounds (x1, y1, x2, y2) of each query; `whole` where a cell lies between the inner ones and not at the border."""
        x1, y1, x2, y2 = outer
        rows = queries.withColumn("cell_i", F.explode(F.sequence(self.i(x1), self.i(x2)))).withColumn("cell_j", F.explode(F.sequence(self.j(y1), self.j(y2))))
        left, bottom = F.lit(self.low_x) + F.col("cell_i") * self.step, F.lit(self.low_y) + F.col("cell_j") * self.step
        border = (F.col("cell_i") == 0) | (F.col("cell_j") == 0) | (F.col("cell_i") == self.m - 1) | (F.col("cell_j") == self.n - 1)
        a, b, c, d = inner
        return rows.withColumn("whole", ~border & (left > a) & (bottom > b) & (left + self.step < c) & (bottom + self.step < d))

    def within(self, index: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
        """Points at most `radius` from each query(q, qx, qy): q, the point's columns, whole."""
        x, y, r, s = F.col("qx"), F.col("qy"), F.lit(radius), F.lit(radius / math.sqrt(2))
        cells = self._cells(queries.select("q", "qx", "qy"), (x - r, y - r, x + r, y + r), (x - s, y - s, x + s, y + s))
        hit = index.join(cells, ["cell_i", "cell_j"])
        return hit.where(F.col("whole") | (F.sqrt(length2("x", "y", "qx", "qy")) <= radius)).drop("qx", "qy")

    def range(self, index: DataFrame, boxes: DataFrame) -> DataFrame:
        """Points strictly inside each box(q, x1, y1, x2, y2): q, the point's columns, whole."""
        corners = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
        cells = self._cells(boxes.select("q", "x1", "y1", "x2", "y2").where("x1 <= x2 AND y1 <= y2"), corners, corners)
        strict = F.expr("x > x1 AND x < x2 AND y > y1 AND y < y2")
        return index.join(cells, ["cell_i", "cell_j"]).where(F.col("whole") | strict).drop("x1", "y1", "x2", "y2")

    def find(self, index: DataFrame, places: DataFrame) -> DataFrame:
        """Points at exactly the place of each query(q, x, y): q and the point's columns."""
        return index.join(self.index(places.select("q", "x", "y")), ["cell_i", "cell_j", "x", "y"])

    def delete(self, index: DataFrame, gone: DataFrame) -> DataFrame:
        """The index without the points at the places gone(x, y)."""
        return index.join(self.index(gone.select("x", "y")).distinct(), ["cell_i", "cell_j", "x", "y"], "left_anti")


def stored(index: DataFrame, path: str) -> DataFrame:
    """The index as Parquet sorted by cell, so that row groups of other cells are skipped."""
    index.repartitionByRange("cell_j", "cell_i").sortWithinPartitions("cell_j", "cell_i").write.parquet(path)
    return index.sparkSession.read.parquet(path)
