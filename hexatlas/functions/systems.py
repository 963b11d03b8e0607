"""Cell systems: one interface over hexagon indexes and a plain lng/lat lattice."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexatlas.functions import cells


def whole_quotient(a: Column, b: int) -> Column:
    """Integer division as BIGINT, exact at any size."""
    return F.call_function("div", a, F.lit(b).cast("long"))


class CellSystem:
    """What the tiling operators need to know about a family of cells."""

    #: Resolution whose cells are the folders of a store: some tens to a hundred.
    block_res: ClassVar[int]

    def with_centroid(self, df: DataFrame, res: int) -> DataFrame:
        """Add ``lng, lat`` in degrees for ``cell_id`` at one resolution."""
        raise NotImplementedError

    def parent(self, cell: Column, child_res: int, res: int) -> Column:
        raise NotImplementedError

    def edge_deg(self, res: int) -> float:
        raise NotImplementedError

    def dimension(self, spark: SparkSession, res: int) -> DataFrame:
        """All cells of a resolution as ``cell_id, lng, lat``."""
        raise NotImplementedError

    def size_at(self, res: int) -> int:
        """Exact number of cells of a resolution: the bound that permits a broadcast."""
        raise NotImplementedError

    def block(self, cell: Column, res: int) -> Column:
        """The store folder of a cell: its ancestor at ``block_res``, NULL for NULL."""
        return self.parent(cell, res, self.block_res)

    def curve(self, cell: Column) -> Column:
        """A number by which cells of one resolution that are near sort near."""
        raise NotImplementedError


@dataclass(frozen=True)
class Lattice(CellSystem):
    """Square lattice of ``2^(res+2)`` cells each way, addressed in milli-degrees.

    ``cell_id = res << 52 | x << 26 | y``. All arithmetic on ids is integer arithmetic.
    """

    block_res: ClassVar[int] = 0

    def side(self, res: int) -> int:
        return 1 << (res + 2)

    def cell_at(self, lng_m: Column, lat_m: Column, res: int) -> Column:
        n = self.side(res)
        x = whole_quotient((lng_m + 180000) * n, 360000)
        y = whole_quotient((lat_m + 90000) * n, 180000)
        return self.pack(res, x, y)

    def pack(self, res: int, x: Column, y: Column) -> Column:
        return (F.lit(res << 52).cast("long")
                .bitwiseOR(F.shiftleft(x, 26)).bitwiseOR(y))

    def column_of(self, cell: Column) -> Column:
        return F.shiftright(cell, 26).bitwiseAND(F.lit((1 << 26) - 1).cast("long"))

    def row_of(self, cell: Column) -> Column:
        return cell.bitwiseAND(F.lit((1 << 26) - 1).cast("long"))

    def with_centroid(self, df: DataFrame, res: int) -> DataFrame:
        n = self.side(res)
        return df.withColumns({
            "lng": (self.column_of(F.col("cell_id")) + 0.5) * (360.0 / n) - 180.0,
            "lat": (self.row_of(F.col("cell_id")) + 0.5) * (180.0 / n) - 90.0,
        })

    def parent(self, cell: Column, child_res: int, res: int) -> Column:
        gap = child_res - res
        return self.pack(res, F.shiftright(self.column_of(cell), gap),
                         F.shiftright(self.row_of(cell), gap))

    def edge_deg(self, res: int) -> float:
        return 360.0 / self.side(res)

    def dimension(self, spark: SparkSession, res: int) -> DataFrame:
        n = self.side(res)
        ids = spark.range(self.size_at(res)).select(
            self.pack(res, whole_quotient(F.col("id"), n), F.col("id") % n).alias("cell_id"))
        return self.with_centroid(ids, res)

    def size_at(self, res: int) -> int:
        return self.side(res) ** 2

    def curve(self, cell: Column) -> Column:
        """Z-order: the bits of column and row in turn."""
        def spread(v: Column) -> Column:
            for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                                (2, 0x3333333333333333), (1, 0x5555555555555555)):
                v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
            return v

        return F.shiftleft(spread(self.column_of(cell)), 1).bitwiseOR(spread(self.row_of(cell)))


@dataclass(frozen=True)
class Hexagons(CellSystem):
    """Hexagon indexes whose centroids come from a ``cell_dim(cell_id, res, lng, lat)``.

    Keep ``cell_dim`` partitioned by ``res``: every use reads one resolution. The digits of an
    index are its path through nested parents, so indexes sort along a curve as they are, and
    the 122 base cells are the folders of a store.
    """

    block_res: ClassVar[int] = 0

    cell_dim: DataFrame

    def with_centroid(self, df: DataFrame, res: int) -> DataFrame:
        # cell_id is unique in the dimension, so the join neither grows nor pairs rows;
        # a repeated cell in df is split by adaptive skew handling
        return df.join(self.dimension(df.sparkSession, res), "cell_id")

    def parent(self, cell: Column, child_res: int, res: int) -> Column:
        return cells.hex_parent(cell, res)

    def edge_deg(self, res: int) -> float:
        return cells.edge_deg_value(res)

    def dimension(self, spark: SparkSession, res: int) -> DataFrame:
        return self.cell_dim.where(F.col("res") == res).select("cell_id", "lng", "lat")

    def size_at(self, res: int) -> int:
        return 2 + 120 * 7 ** res

    def curve(self, cell: Column) -> Column:
        return cell
