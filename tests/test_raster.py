"""Value maps, lookup, colours, re-wrapping and tile pixels."""

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hexatlas.functions import colour
from hexatlas.operators import raster as R
from hexatlas.operators.compare import parity_totals, tile_parity
from hexatlas.plans.raster_tiles import model_layer, raster_tiles, source_layer

NAN = float("nan")


def test_value_map_takes_the_last_finite_value(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, 3.0, 2), (1, NAN, 3), (2, None, 1), (0, 1.0, 1), (-4, 1.0, 1), (3, 8.0, 9), (3, 9.0, 9)],
                               "cell_id int, value double, seq int")
    assert {tuple(r) for r in R.value_map(df, order="seq").collect()} == {(1, 3.0), (3, 9.0)}
    assert {tuple(r) for r in R.value_map(df).collect()} == {(1, 5.0), (3, 9.0)}


def test_a_map_of_more_than_a_million_rows_keeps_them_all(spark):
    df = spark.range(1, 1_200_001).selectExpr("id cell_id", "if(id % 2 = 0, 1D, double('NaN')) value")
    assert R.value_map(df).count() == 600_000
    with pytest.raises(ValueError):
        R.require_rows(R.value_map(df.where("cell_id % 2 = 1")))


def test_lookup(spark):
    px = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, -3, 7, 9, 7])], "i int, cell_id int")
    vm = spark.createDataFrame([(7, 1.5)], "cell_id bigint, value double")
    got = {r["i"]: r["value"] for r in R.lookup(px, vm).collect()}
    assert got[3] == got[5] == 1.5 and all(math.isnan(got[i]) for i in (0, 1, 2, 4))


def test_empty_pixels_are_spread(spark):
    px = spark.range(100_000).selectExpr("id px", "0 cell_id")
    vm = spark.range(10).selectExpr("id cell_id", "1D value")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        parts = R.lookup(px, vm).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in parts) == 100_000
    assert max(r["count"] for r in parts) < 20_000


def reference_byte(v, lo, hi):
    if hi <= lo:
        hi = lo + 1
    scaled = np.clip((np.array(v) - lo) / (hi - lo), 0, 1) * 255
    return np.nan_to_num(scaled, nan=0).astype(np.uint8).tolist()


@pytest.mark.parametrize("lo,hi", [(0.0, 10.0), (5.0, 5.0), (7.0, 3.0), (-2.5, 99.0)])
def test_byte_scale(spark, lo, hi):
    values = [NAN, -1e9, 0.0, 2.5, 5.0, 5.5, 9.999, 10.0, 1e9, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(colour.to_byte(F.col("v"), F.lit(lo), F.lit(hi))).collect()]
    assert got == reference_byte(values, lo, hi)


def test_colour_and_range_text(spark):
    df = spark.createDataFrame([("#1122ff",), ("1122FF80",), ("#12",), ("#gggggg",), (None,)], "t string")
    got = [r[0] and tuple(r[0]) for r in df.select(colour.parse_colour(F.col("t"))).collect()]
    assert got == [(17, 34, 255, 255), (17, 34, 255, 128), None, None, None]
    rng = spark.createDataFrame([("1,2.5",), ("1",), ("a,b",), ("1,2,3",), (" -1 , 1e3",)], "t string")
    got = [r[0] and tuple(r[0]) for r in rng.select(colour.parse_range(F.col("t"))).collect()]
    assert got == [(1.0, 2.5), None, None, None, (-1.0, 1000.0)]


def palette(spark):
    return spark.range(256).selectExpr("cast(id as int) byte", "cast(id as int) r", "0 g", "0 b", "if(id = 0, 0, 200) a")


def pixels(spark):
    return spark.createDataFrame([(0, 0, 0, i, 0, c, m) for i, (c, m) in enumerate([(1, 255), (2, 255), (3, 0), (9, 255), (0, 0)])],
                                 "z int, x int, y int, px int, py int, cell_id int, mask int")


def test_raster_tiles(spark):
    layer = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 5.0)], "cell_id int, value double")
    rows = raster_tiles(layer, pixels(spark), palette(spark)).orderBy("px").collect()
    assert [(r["r"], r["a"]) for r in rows] == [(0, 0), (255, 200), (127, 0), (0, 0), (0, 0)]
    fixed = raster_tiles(layer, pixels(spark), palette(spark), rescale=(0.0, 20.0)).orderBy("px").collect()
    assert [r["r"] for r in fixed] == [0, 127, 63, 0, 0]
    mask = raster_tiles(layer, pixels(spark), single_colour="#0a0b0c80").orderBy("px").collect()
    assert [(r["r"], r["a"]) for r in mask] == [(10, 128), (10, 128), (10, 0), (10, 0), (10, 0)]
    with pytest.raises(PySparkException, match="not a colour"):
        raster_tiles(layer, pixels(spark), single_colour="red").collect()


def wrap_dense(src, left, step):
    """The same move on a dense array."""
    cut = round((180 - left) / step)
    out = np.zeros((src.shape[0], round(360 / step)), dtype=np.int64)
    clean = np.nan_to_num(src, nan=0).astype(np.int64)
    east, west = clean[:, :cut], clean[:, cut:]
    start = round((left + 180) / step)
    east = east[:, :max(0, out.shape[1] - start)]
    out[:, start:start + east.shape[1]] = east
    w = min(west.shape[1], out.shape[1])
    out[:, :w] = west[:, :w]
    return out


@pytest.mark.parametrize("left,width", [(0.0, 36), (100.0, 36), (100.0, 44), (-180.0, 36), (150.0, 20), (10.0, 10)])
def test_rewrap_equals_the_dense_move(spark, left, width):
    rng = np.random.default_rng(3)
    src = rng.integers(1, 1000, (3, width)).astype(float)
    src[rng.random(src.shape) < 0.2] = NAN
    rows = [(r, c, float(src[r, c])) for r in range(3) for c in range(width)]
    df = spark.createDataFrame(rows, "row int, col int, cell_id double")
    got = np.zeros((3, 36), dtype=np.int64)
    result = R.rewrap(df, left, 10.0, width).collect()
    assert len({(r["row"], r["col"]) for r in result}) == len(result)
    for r in result:
        got[r["row"], r["col"]] = r["cell_id"]
    assert (got == wrap_dense(src, left, 10.0)).all()


def test_tile_pixels_take_the_nearest_source(spark):
    rows = [(r, c, r * 36 + c + 1) for r in range(18) for c in range(36)]
    raster = spark.createDataFrame(rows, "row int, col int, cell_id int")
    got = R.tile_pixels(raster, 1, -180.0, 90.0, 10.0, 10.0).collect()
    assert len(got) == 4 * 256 * 256
    for r in got[::997]:
        gx, gy = r["x"] * 256 + r["px"] + 0.5, r["y"] * 256 + r["py"] + 0.5
        lng = gx / 512 * 360 - 180
        lat = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * gy / 512))))
        assert r["cell_id"] == int((90 - lat) // 10) * 36 + int((lng + 180) // 10) + 1
    one = R.tile_pixels(raster, 1, -180.0, 90.0, 10.0, 10.0, tile=(1, 0))
    assert one.count() == 65536 and {tuple(r) for r in one.select("x", "y").distinct().collect()} == {(1, 0)}


def test_profile_and_documents(spark):
    px = spark.createDataFrame([(1, 0, 0, c, 255 if c else 0) for c in [0, 0, 0, -2, 5, 5, 9]],
                               "z int, x int, y int, cell_id int, mask int")
    r = R.tile_profile(px, top=3).head()
    assert (r["valid_px"], r["total_px"], r["zero_px"], r["negative_px"], r["id_min"], r["id_max"]) == (4, 7, 3, 1, -2, 9)
    assert r["top_ids"] == "0:3,5:2,-2:1"
    b = spark.createDataFrame([(-180.0, -90.0, 180.0, 80.0)], "xmin double, ymin double, xmax double, ymax double")
    doc = json.loads(R.layer_documents(b, "cells", "https://t.example/", {"mdl_key": F.lit("a|b c")}, 1, 9).head()["document"])
    assert doc["center"] == [0.0, -5.0, 1] and doc["bounds"] == [-180, -90, 180, 80]
    assert doc["tiles"] == ["https://t.example/{z}/{x}/{y}.png?mdl_key=a%7Cb+c"]


def test_model_key_wins_and_unknown_keys_fail(spark):
    cells = spark.createDataFrame([(1, 10, 2), (2, 10, 3)], "mdl_id int, cell_id int, val int")
    reg = spark.createDataFrame([("a", 1), ("b", 2)], "mdl_key string, mdl_id int")
    other = spark.createDataFrame([(5, 5.0)], "cell_id int, value double")
    assert [tuple(r) for r in source_layer("b", other, cells, reg).collect()] == [(10, 3.0)]
    assert source_layer(None, other) is other
    with pytest.raises(LookupError):
        model_layer(cells, reg, "c")
    with pytest.raises(ValueError):
        source_layer("", None)


def test_parity(spark):
    a = spark.createDataFrame([(0, 0, 0, 0, i, 5) for i in range(4)], "z int, x int, y int, px int, py int, v int")
    b = a.withColumn("v", F.when(F.col("py") == 2, 6).otherwise(5)).where("py < 3")
    per = tile_parity(a, b, ["v"])
    assert tuple(per.select("pixels", "differing").head()) == (4, 2)
    assert tuple(parity_totals(tile_parity(a, a, ["v"])).head()) == (1, 1, 0)
    nulls = a.withColumn("v", F.lit(None).cast("int"))
    assert tile_parity(nulls, nulls, ["v"]).head()["differing"] == 0


def test_parity_sees_every_row_of_a_pixel(spark):
    schema = "z int, x int, y int, px int, py int, v int"
    a = spark.createDataFrame([(0, 0, 0, 0, 0, 9), (0, 0, 0, 0, 0, 3), (0, 0, 0, 0, 1, 9), (0, 0, 0, 0, 1, None)], schema)
    b = spark.createDataFrame([(0, 0, 0, 0, 0, 9), (0, 0, 0, 0, 0, 4), (0, 0, 0, 0, 1, None), (0, 0, 0, 0, 1, 9)], schema)
    assert tuple(tile_parity(a, b, ["v"]).select("pixels", "differing").head()) == (2, 1)
    assert tuple(tile_parity(a, a, ["v"]).select("pixels", "differing").head()) == (2, 0)


def test_a_pixel_of_two_rows_is_one_pixel_of_the_profile(spark):
    px = spark.createDataFrame([(1, 0, 0, 3, 7, 5, 255), (1, 0, 0, 3, 7, 0, 0), (1, 0, 0, 4, 7, 5, 255), (1, 0, 0, 4, 7, 5, 255), (1, 0, 0, 5, 7, -2, 255)],
                               "z int, x int, y int, px int, py int, cell_id bigint, mask int")
    r = R.tile_profile(R.whole_tiles(px)).head()
    assert (r["valid_px"], r["total_px"], r["zero_px"], r["negative_px"]) == (3, 65_536, 65_534, 1)
    assert r["top_ids"] == "0:65534,5:2,-2:1"


def test_whole_tiles_have_every_pixel(spark):
    px = spark.createDataFrame([(1, 0, 0, 3, 7, 5, 255), (1, 0, 0, 255, 7, 6, 255), (1, 0, 0, 0, 255, 0, 0), (1, 1, 0, 9, 9, -4, 255)],
                               "z int, x int, y int, px int, py int, cell_id bigint, mask int")
    whole = R.whole_tiles(px)
    counts = {(r["x"], r["y"]): (r["total_px"], r["valid_px"], r["negative_px"], r["id_max"]) for r in R.tile_profile(whole).collect()}
    assert counts == {(0, 0): (65_536, 2, 0, 6), (1, 0): (65_536, 1, 1, 0)}
    assert whole.select("z", "x", "y", "px", "py").distinct().count() == 2 * 65_536
    assert px.exceptAll(whole.select(px.columns)).count() == 0
    assert whole.where("px < 0 OR px > 255 OR py < 0 OR py > 255").count() == 0 and R.whole_tiles(px.limit(0)).count() == 0
    from hexatlas.plans.raster_tiles import raster_tiles
    shown = raster_tiles(spark.createDataFrame([(5, 1.0), (6, 2.0)], "cell_id bigint, value double"), px, single_colour="#102030", whole=True)
    assert shown.count() == 2 * 65_536 and shown.where("a > 0").count() == 2
