"""Pixels: re-wrapping, lookup, colours, whole raster tiles, profiles and parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.functions import colour
from hexatlas.operators import raster as R
from hexatlas.operators.compare import parity_totals, tile_parity
from hexatlas.plans import standins as S
from hexatlas.plans.raster_tiles import raster_tiles
from hexatlas.suite.base import grid_cell_sql, grid_col_sql, grid_row_sql, query

Z = 2
_N = f"{256 * 2 ** Z}"

# the palette of the checks: 256 rows, the lowest byte transparent
_PALETTE = ("SELECT CAST(i AS INTEGER) AS byte, CAST(i AS INTEGER) AS r, CAST(255-i AS INTEGER) AS g, "
            "CAST((i*7)%256 AS INTEGER) AS b, CASE WHEN i=0 THEN 0 ELSE 255 END AS a FROM range(256) p(i)")


def palette(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(256).select(
        i.alias("byte"), i.alias("r"), (255 - i).alias("g"), (i * 7 % 256).alias("b"),
        F.when(i == 0, 0).otherwise(255).alias("a"))


_RASTER = (f"SELECT DISTINCT {grid_row_sql('c_custkey')} AS row, {grid_col_sql('c_custkey')} AS col, "
           f"CASE WHEN c_nationkey=0 THEN 0 ELSE {grid_cell_sql('c_custkey')} END AS cell_id FROM customer")


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """Half-degree pixels of customers; those of one nation are empty."""
    k = F.col("c_custkey")
    return S.table(spark, sf, "customer").select(
        S.grid_row(k).alias("row"), S.grid_col(k).alias("col"),
        F.when(F.col("c_nationkey") == 0, F.lit(0)).otherwise(S.grid_cell(k)).alias("cell_id")).distinct()


_PIXELS = f"""
    SELECT {Z} AS z, CAST(c.i//256 AS INTEGER) AS x, CAST(r.i//256 AS INTEGER) AS y,
      CAST(c.i%256 AS INTEGER) AS px, CAST(r.i%256 AS INTEGER) AS py, g.cell_id,
      CASE WHEN g.cell_id<>0 THEN 255 ELSE 0 END AS mask
    FROM ({_RASTER}) g
    JOIN (SELECT i, CAST(floor(((i+0.5)/{_N}::DOUBLE*360.0-180.0+180.0)/0.5) AS BIGINT) AS col FROM range({_N}) t(i)) c USING (col)
    JOIN (SELECT i, CAST(floor((90.0-atan(sinh(pi()*(1-2*(i+0.5)/{_N}::DOUBLE)))*180.0/pi())/0.5) AS BIGINT) AS row FROM range({_N}) t(i)) r USING (row)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return R.tile_pixels(raster(spark, sf), Z, -180.0, 90.0, 0.5, 0.5)


@query("C6_tile_pixels", _PIXELS)
def all_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf)


_VALUES = (f"SELECT cell_id, max(v) AS value FROM (SELECT {grid_cell_sql('o_custkey')} AS cell_id, "
           "o_totalprice AS v FROM orders) GROUP BY 1")


def order_values(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "orders").select(
        S.grid_cell(F.col("o_custkey")).alias("cell_id"), F.col("o_totalprice").alias("value"))


@query("J2_pixel_lookup",
       f"SELECT o_orderkey, CASE WHEN cell>0 THEN coalesce(value,'NaN'::DOUBLE) ELSE 'NaN'::DOUBLE END AS value "
       f"FROM (SELECT o_orderkey, CASE WHEN o_orderstatus='P' THEN 0 WHEN o_orderkey%5=0 THEN 1000000+o_custkey ELSE {grid_cell_sql('o_custkey')} END AS cell FROM orders) "
       f"LEFT JOIN ({_VALUES}) ON cell=cell_id")
def pixel_lookup(spark: SparkSession, sf: str) -> DataFrame:
    # every order is a pixel; those of one status are empty, and a fifth have unknown ids
    px = S.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(0).cast("bigint"))
        .when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1000000)
        .otherwise(S.grid_cell(F.col("o_custkey"))).alias("cell_id"))
    return R.lookup(px, R.value_map(order_values(spark, sf))).select("o_orderkey", "value")


def _byte_sql(v: str, lo: str, hi: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR isnan({v}) THEN 0 ELSE CAST(trunc(greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
            f"({v}-{lo})/(CASE WHEN {hi}<={lo} THEN {lo}+1 ELSE {hi} END-{lo})))*255.0::DOUBLE) AS INTEGER) END")


@query("C1_byte_scale",
       f"SELECT {_byte_sql('v', '20000.0::DOUBLE', '90000.0::DOUBLE')} AS byte, "
       f"{_byte_sql('v', '50000.0::DOUBLE', '50000.0::DOUBLE')} AS flat_byte, count(*) AS n FROM "
       "(SELECT CASE WHEN l_linenumber=7 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS v FROM lineitem) GROUP BY 1,2")
def byte_scale(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    rows = S.table(spark, sf, "lineitem").select(v.alias("v"))
    return rows.groupBy(
        colour.to_byte(F.col("v"), F.lit(20000.0), F.lit(90000.0)).alias("byte"),
        colour.to_byte(F.col("v"), F.lit(50000.0), F.lit(50000.0)).alias("flat_byte")).agg(
        F.count(F.lit(1)).alias("n"))


@query("C2_range_text", """
    WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'low,high' WHEN 'O' THEN '1.5'
      ELSE o_custkey||','||o_orderkey||'.25' END AS s FROM orders)
    SELECT o_orderkey, CASE WHEN s LIKE '%.25' THEN CAST(split_part(s,',',1) AS DOUBLE) END AS low,
      CASE WHEN s LIKE '%.25' THEN CAST(split_part(s,',',2) AS DOUBLE) END AS high FROM t""")
def range_text(spark: SparkSession, sf: str) -> DataFrame:
    s = (F.when(F.col("o_orderstatus") == "P", "low,high").when(F.col("o_orderstatus") == "O", "1.5")
         .otherwise(F.concat_ws(",", "o_custkey", F.concat("o_orderkey", F.lit(".25")))))
    return (S.table(spark, sf, "orders").select("o_orderkey", colour.parse_range(s).alias("r"))
            .select("o_orderkey", "r.low", "r.high"))


@query("C2_automatic_range", f"SELECT min(value) AS low, max(value) AS high FROM ({_VALUES})")
def automatic(spark: SparkSession, sf: str) -> DataFrame:
    # one row with both ends as the colouring step receives them
    mapped = R.value_map(order_values(spark, sf))
    low, high = R.value_range(mapped)
    return mapped.agg(F.count(F.lit(1)).alias("c")).withColumns({"low": low, "high": high}).select("low", "high")


@query("C3_C4_palette",
       f"SELECT l_orderkey, l_linenumber, l_partkey, byte, r, g, b, CASE WHEN l_returnflag<>'A' AND isfinite(v) THEN a ELSE 0 END AS a "
       f"FROM (SELECT *, {_byte_sql('v', '20000.0::DOUBLE', '90000.0::DOUBLE')} AS byte FROM "
       "(SELECT *, CASE WHEN l_linenumber=7 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS v FROM lineitem)) "
       f"JOIN ({_PALETTE}) USING (byte)")
def palette_lookup(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    valued = S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", v.alias("value"),
        F.when(F.col("l_returnflag") == "A", 0).otherwise(255).alias("mask"))
    return R.coloured(valued, F.lit(20000.0), F.lit(90000.0), palette(spark)).drop("value", "mask")


@query("C5_colour_text", """
    WITH t AS (SELECT p_partkey, p_size, (p_partkey*7919)%16777216 AS v FROM part),
    u AS (SELECT *, lpad(to_hex(v),6,'0') AS h FROM t)
    SELECT p_partkey, CASE WHEN p_size<>3 THEN CAST(v//65536 AS INTEGER) END AS r,
      CASE WHEN p_size<>3 THEN CAST((v//256)%256 AS INTEGER) END AS g,
      CASE WHEN p_size<>3 THEN CAST(v%256 AS INTEGER) END AS b,
      CASE WHEN p_size<>3 THEN CASE WHEN p_size%2=0 THEN 128 ELSE 255 END END AS a FROM u""")
def colour_text(spark: SparkSession, sf: str) -> DataFrame:
    hex6 = F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0")
    text = (F.when(F.col("p_size") == 3, F.concat(F.lit("#"), hex6, F.lit("0")))
            .when(F.col("p_size") % 2 == 0, F.concat(F.lit("#"), hex6, F.lit("80"))).otherwise(hex6))
    return (S.table(spark, sf, "part").select("p_partkey", colour.parse_colour(text).alias("c"))
            .select("p_partkey", "c.r", "c.g", "c.b", "c.a"))


_VALUED = (f"SELECT p.*, coalesce(v.value,'NaN'::DOUBLE) AS value FROM ({_PIXELS}) p "
           f"LEFT JOIN ({_VALUES}) v ON v.cell_id=p.cell_id AND p.cell_id>0")


@query("C6_raster_tiles",
       f"WITH v AS ({_VALUED}), k AS (SELECT min(value) AS lo, max(value) AS hi FROM ({_VALUES})), "
       f"s AS (SELECT v.*, {_byte_sql('value', 'lo', 'hi')} AS byte FROM v, k) "
       "SELECT z,x,y,px,py,r,g,b, CASE WHEN mask>0 AND isfinite(value) THEN a ELSE 0 END AS a "
       f"FROM s JOIN ({_PALETTE}) USING (byte)")
def colour_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return raster_tiles(order_values(spark, sf), pixels(spark, sf), palette(spark)).select("z", "x", "y", "px", "py", "r", "g", "b", "a")


_WHOLE = (f"SELECT z, x, y, px, py, coalesce(cell_id, 0) AS cell_id, coalesce(mask, 0) AS mask FROM (SELECT * FROM (SELECT DISTINCT z, x, y FROM ({_PIXELS})), "
          "(SELECT CAST(i AS INTEGER) AS px FROM range(256) a(i)), (SELECT CAST(i AS INTEGER) AS py FROM range(256) b(i))) "
          f"LEFT JOIN ({_PIXELS}) USING (z, x, y, px, py)")


@query("A8_whole_tile_profile", f"""
    WITH p AS ({_WHOLE}), c AS (SELECT z,x,y,cell_id,count(*) AS c FROM p GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY z,x,y ORDER BY c DESC, cell_id) AS k FROM c),
    b AS (SELECT z,x,y,string_agg(cell_id||':'||c, ',' ORDER BY k) AS top_ids FROM t WHERE k<=10 GROUP BY ALL)
    SELECT z,x,y, count(*) FILTER (mask>0) AS valid_px, CAST(65536 AS BIGINT) AS total_px,
      count(*) FILTER (cell_id=0) AS zero_px, count(*) FILTER (cell_id<0) AS negative_px,
      min(cell_id) AS id_min, max(cell_id) AS id_max, any_value(top_ids) AS top_ids
    FROM p JOIN b USING (z,x,y) GROUP BY z,x,y""")
def whole_profile(spark: SparkSession, sf: str) -> DataFrame:
    return R.tile_profile(R.whole_tiles(pixels(spark, sf)))


# every pixel of every tile, counted by what is shown
@query("C6_whole_tiles",
       f"WITH v AS (SELECT p.z, p.x, p.y, mask, value FROM ({_WHOLE}) p LEFT JOIN ({_VALUES}) v ON v.cell_id=p.cell_id AND p.cell_id>0), "
       f"k AS (SELECT min(value) AS lo, max(value) AS hi FROM ({_VALUES})), "
       f"s AS (SELECT v.*, {_byte_sql('value', 'lo', 'hi')} AS byte FROM v, k) "
       "SELECT z,x,y,r,g,b, CASE WHEN mask>0 AND isfinite(value) THEN a ELSE 0 END AS a, count(*) AS px "
       f"FROM s JOIN ({_PALETTE}) USING (byte) GROUP BY ALL")
def colour_whole_tiles(spark: SparkSession, sf: str) -> DataFrame:
    drawn = raster_tiles(order_values(spark, sf), pixels(spark, sf), palette(spark), whole=True)
    return drawn.groupBy("z", "x", "y", "r", "g", "b", "a").agg(F.count(F.lit(1)).alias("px"))


@query("C5_mask_tiles",
       f"SELECT z,x,y,px,py, 17 AS r, 34 AS g, 255 AS b, CASE WHEN mask>0 AND isfinite(value) THEN 128 ELSE 0 END AS a "
       f"FROM ({_VALUED})")
def mask_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return raster_tiles(order_values(spark, sf), pixels(spark, sf), single_colour="#1122ff80").select("z", "x", "y", "px", "py", "r", "g", "b", "a")


_LEFT, _STEP, _WIDTH = 100.0, 0.5, 800
_SOURCE = ("SELECT (c_custkey*7)%360 AS row, (c_custkey*37)%800 AS col, "
           "max(CASE WHEN c_nationkey=0 THEN 'NaN'::DOUBLE ELSE CAST(c_custkey+1 AS DOUBLE) END) AS cell_id "
           "FROM customer GROUP BY 1,2")


@query("T12_rewrapped_raster", f"""
    WITH s AS ({_SOURCE}),
    p AS (SELECT row, col+560 AS col, cell_id, 1 AS rank FROM s WHERE col<160 AND col+560<720
          UNION ALL SELECT row, col-160, cell_id, 2 FROM s WHERE col>=160),
    w AS (SELECT r.i AS row, c.i AS col, 0.0::DOUBLE AS cell_id, 2 AS rank FROM range(360) r(i), range(640) c(i)
          WHERE (r.i,c.i) NOT IN (SELECT (row,col) FROM p WHERE rank=2)),
    a AS (SELECT *, true AS real FROM p UNION ALL SELECT *, false FROM w)
    SELECT row, col, CAST(CASE WHEN isnan(cell_id) THEN 0 ELSE cell_id END AS BIGINT) AS cell_id FROM
      (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY rank DESC) AS k FROM a) WHERE k=1 AND real""")
def rewrapped(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    ident = F.when(F.col("c_nationkey") == 0, F.lit(float("nan"))).otherwise((k + 1).cast("double"))
    source = S.table(spark, sf, "customer").groupBy(
        (k * 7 % 360).alias("row"), (k * 37 % 800).alias("col")).agg(F.max(ident).alias("cell_id"))
    return R.rewrap(source, _LEFT, _STEP, _WIDTH)


# every line item is a pixel of the tile its order key names; ids repeat and may be <= 0
_PROFILE_PX = (f"SELECT 5 AS z, CAST(l_orderkey%3 AS INTEGER) AS x, CAST(l_suppkey%2 AS INTEGER) AS y, "
               "l_partkey%97-3 AS cell_id, CASE WHEN l_partkey%97-3<>0 THEN 255 ELSE 0 END AS mask FROM lineitem")


@query("A8_tile_profile", f"""
    WITH p AS ({_PROFILE_PX}), c AS (SELECT z,x,y,cell_id,count(*) AS c FROM p GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY z,x,y ORDER BY c DESC, cell_id) AS k FROM c),
    b AS (SELECT z,x,y,string_agg(cell_id||':'||c, ',' ORDER BY k) AS top_ids FROM t WHERE k<=10 GROUP BY ALL)
    SELECT z,x,y, count(*) FILTER (mask>0) AS valid_px, count(*) AS total_px,
      count(*) FILTER (cell_id=0) AS zero_px, count(*) FILTER (cell_id<0) AS negative_px,
      min(cell_id) AS id_min, max(cell_id) AS id_max, any_value(top_ids) AS top_ids
    FROM p JOIN b USING (z,x,y) GROUP BY z,x,y""")
def profile(spark: SparkSession, sf: str) -> DataFrame:
    ident = F.col("l_partkey") % 97 - 3
    return R.tile_profile(S.table(spark, sf, "lineitem").select(
        F.lit(5).alias("z"), (F.col("l_orderkey") % 3).cast("int").alias("x"),
        (F.col("l_suppkey") % 2).cast("int").alias("y"), ident.alias("cell_id"),
        F.when(ident != 0, 255).otherwise(0).alias("mask")))


# the same tiles drawn at two ranges: pixels differ where the byte does
def _drawn_sql(lo: str, hi: str) -> str:
    return f"SELECT z,x,y,px,py,{_byte_sql('value', lo, hi)} AS byte FROM ({_VALUED})"


_A, _B = _drawn_sql("0.0::DOUBLE", "500000.0::DOUBLE"), _drawn_sql("1000.0::DOUBLE", "500000.0::DOUBLE")
_PARITY = (f"SELECT z,x,y,count(*) AS pixels, count(*) FILTER (a.byte<>b.byte) AS differing "
           f"FROM ({_A}) a JOIN ({_B}) b USING (z,x,y,px,py) GROUP BY z,x,y")


def drawn(spark: SparkSession, sf: str, rescale: tuple[float, float]) -> DataFrame:
    return raster_tiles(order_values(spark, sf), pixels(spark, sf), palette(spark), rescale=rescale).select("z", "x", "y", "px", "py", "byte")


@query("J8_tile_parity", _PARITY)
def parity(spark: SparkSession, sf: str) -> DataFrame:
    return tile_parity(drawn(spark, sf, (0.0, 500000.0)), drawn(spark, sf, (1000.0, 500000.0)), ["byte"])


@query("J8_parity_totals",
       f"SELECT count(*) AS tiles, count(*) FILTER (differing=0) AS identical, max(differing) AS worst FROM ({_PARITY})")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return parity_totals(parity(spark, sf))
