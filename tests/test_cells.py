"""Cell ids, zoom bins, edges and tile boxes against fixed values."""

import math

import pytest
from pyspark.sql import functions as F

from hexatlas.functions import cells
from hexatlas.functions.systems import Hexagons, Lattice

# Zoom and the resolution drawn at it.
ZOOMS = [(-1, 1), (0, 1), (0.5, 1), (1, 1), (1.5, 1), (2.2, 2), (2.5, 2), (3.4, 3), (4.6, 4), (5.8, 5),
         (7, 6), (8.2, 7), (9.4, 8), (10.6, 9), (11.8, 10), (12, 10), (13, 10), (15, 10), (20, 10),
         (22, 10), (22.5, 10), (25, 10)]
# Mean edge in degrees of resolutions 1..10.
EDGES = [3.75703205141601, 1.42002463939223, 0.536718864488001, 0.202860662770318, 0.0766741234982859,
         0.028980094681474, 0.0109534462140408, 0.00414001352592486, 0.00156477803057726,
         0.000591430503703552]
# Z, x, y, then west, east, south, north.
BOXES = [
    (0, 0, 0, -180, 180, -85.0511287798066, 85.0511287798066),
    (1, 0, 0, -180, 0, 0, 85.0511287798066),
    (1, 1, 1, 0, 180, -85.0511287798066, 0),
    (5, 3, 12, -146.25, -135, 31.952162238025, 40.9798980696201),
    (8, 41, 100, -122.34375, -120.9375, 35.4606699514953, 36.5978891330702),
    (10, 163, 397, -122.6953125, -122.34375, 37.1603165467368, 37.4399740522706),
    (14, 2613, 6361, -122.58544921875, -122.5634765625, 37.2653099556187, 37.2827946491104),
]


def test_zoom_bins(spark):
    df = spark.createDataFrame([(float(z), r) for z, r in ZOOMS], "z double, want int")
    assert df.where(cells.zoom_to_res(F.col("z")) != F.col("want")).count() == 0
    assert [cells.res_for_zoom(z) for z, _ in ZOOMS] == [r for _, r in ZOOMS]


def test_edges(spark):
    df = spark.range(1, 11).select(cells.edge_deg(F.col("id")).alias("e")).orderBy("id")
    got = [r["e"] for r in df.collect()]
    assert got == pytest.approx(EDGES, rel=1e-12)
    assert [cells.edge_deg_value(r) for r in range(1, 11)] == pytest.approx(EDGES, rel=1e-12)


def test_boxes(spark):
    df = spark.createDataFrame([b[:3] for b in BOXES], "z int, x int, y int")
    rows = df.select("z", "x", "y", cells.tile_bbox(F.col("z"), F.col("x"), F.col("y")).alias("b")).collect()
    for row, want in zip(rows, BOXES):
        assert tuple(row["b"]) == pytest.approx(want[3:], abs=1e-9)
    text = df.selectExpr(f"{cells.west_sql()} w", f"{cells.north_sql()} n").collect()
    assert [r["n"] for r in text] == pytest.approx([b[6] for b in BOXES], abs=1e-9)


def test_tiles_off_the_map_have_no_box(spark):
    df = spark.createDataFrame([(1, 2, 0), (1, 0, 2), (1, -1, 0), (0, 0, 1)], "z int, x int, y int")
    assert df.where(cells.tile_bbox(F.col("z"), F.col("x"), F.col("y")).isNotNull()).count() == 0


def test_hex_text_resolution_and_parent(spark):
    df = spark.createDataFrame([(0x85283473FFFFFFF,)], "c bigint").select(
        cells.cell_hex(F.col("c")).alias("h"), cells.cell_resolution(F.col("c")).alias("r"),
        cells.cell_hex(cells.hex_parent(F.col("c"), 3)).alias("p"))
    assert tuple(df.head()) == ("85283473fffffff", 5, "832834fffffffff")


def test_lattice_parent_is_the_cell_of_the_same_place(spark):
    lat = Lattice()
    pts = spark.range(2000).select((F.col("id") * 137507 % 360000 - 180000).alias("x"),
                                   (F.col("id") * 61803 % 180000 - 90000).alias("y"))
    for res in range(1, 10):
        fine, coarse = lat.cell_at(F.col("x"), F.col("y"), 10), lat.cell_at(F.col("x"), F.col("y"), res)
        assert pts.where(lat.parent(fine, 10, res) != coarse).count() == 0


def test_lattice_centroid_is_inside_its_cell(spark):
    lat = Lattice()
    dim = lat.dimension(spark, 2)
    assert dim.count() == lat.size_at(2) == dim.select("cell_id").distinct().count()
    milli = dim.withColumns({"x": F.round(F.col("lng") * 1000).cast("bigint"),
                             "y": F.round(F.col("lat") * 1000).cast("bigint")})
    assert milli.where(lat.cell_at(F.col("x"), F.col("y"), 2) != F.col("cell_id")).count() == 0


def test_hexagon_counts():
    # Cells of a whole-earth hexagon grid.
    assert [Hexagons(None).size_at(r) for r in (0, 1, 2, 3)] == [122, 842, 5882, 41162]
    assert math.isclose(Hexagons(None).edge_deg(5), EDGES[4], rel_tol=1e-12)
