"""Tile geometry, assignment, capping, pruning and the tile sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.functions import cells
from hexatlas.functions.systems import Hexagons
from hexatlas.operators import tiling as T
from hexatlas.operators.layers import hex_layer
from hexatlas.plans import standins as S
from hexatlas.plans.hex_tiles import mean_layer, pyramid, single_tile
from hexatlas.session import scratch_path
from hexatlas.sources.stores import write_blocks, write_tile_documents
from hexatlas.suite.base import (
    cell_sql, hexed, lat_of, lng_of, north_sql, query, risen, tiled_sql,
    tiles_sql, turned)


def layer_of(spark: SparkSession, sf: str):
    return lambda res: S.order_layer(spark, sf, res)


_ONE = "z=2 AND x=1 AND y=1"


@query("tile_of_orders",
       f"SELECT {hexed('cell_id')} AS h3id, value, n FROM ({tiled_sql(2, 5)}) WHERE {_ONE}")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return single_tile(layer_of(spark, sf), S.LATTICE, 2, 1, 1, res=5)


_BREAKS = "[0,2.2,3.4,4.6,5.8,7,8.2,9.4,10.6,11.8,22]"


@query("T1_zoom_to_res", f"""
    WITH e AS (SELECT value/20 - 1 AS zoom FROM events)
    SELECT CAST(greatest(1, least(10, (SELECT count(*) FROM (SELECT unnest({_BREAKS}) AS b)
      WHERE b <= zoom))) AS INTEGER) AS res, count(*) AS n FROM e GROUP BY 1""")
def zoom_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    zoom = F.col("value") / 20 - 1
    return (S.table(spark, sf, "events").groupBy(cells.zoom_to_res(zoom).alias("res"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("T2_edge_length", """
    SELECT p_size, round(1106.54/(sqrt(7)**(p_size%10+1))/111.32, 9) AS edge, count(*) AS n
    FROM part GROUP BY 1,2""")
def edges(spark: SparkSession, sf: str) -> DataFrame:
    edge = F.round(cells.edge_deg(F.col("p_size") % 10 + 1), 9).alias("edge")
    return S.table(spark, sf, "part").groupBy("p_size", edge).agg(F.count(F.lit(1)).alias("n"))


_N = "(2.0::DOUBLE**z)"


@query("T3_tile_bbox", f"""
    WITH r AS (SELECT o_orderkey, CAST(o_orderkey%12 AS INTEGER) AS z,
                      CAST(o_custkey%300 AS INTEGER) AS x,
                      CAST((o_orderkey+o_custkey)%300 AS INTEGER) AS y FROM orders)
    SELECT o_orderkey, x<{_N} AND y<{_N} AS ok,
      CASE WHEN x<{_N} AND y<{_N} THEN round(x/{_N}*360.0-180.0,8) END AS lon_min,
      CASE WHEN x<{_N} AND y<{_N} THEN round((x+1)/{_N}*360.0-180.0,8) END AS lon_max,
      CASE WHEN x<{_N} AND y<{_N} THEN round({north_sql('y+1', _N)},8) END AS lat_min,
      CASE WHEN x<{_N} AND y<{_N} THEN round({north_sql('y', _N)},8) END AS lat_max FROM r""")
def boxes(spark: SparkSession, sf: str) -> DataFrame:
    o = S.table(spark, sf, "orders")
    z = (F.col("o_orderkey") % 12).cast("int")
    x = (F.col("o_custkey") % 300).cast("int")
    y = ((F.col("o_orderkey") + F.col("o_custkey")) % 300).cast("int")
    b = o.select("o_orderkey", cells.tile_bbox(z, x, y).alias("b"))
    return b.select("o_orderkey", F.col("b").isNotNull().alias("ok"), *[
        F.round(f"b.{c}", 8).alias(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")])


@query("T4_one_tile_at_the_antimeridian",
       f"SELECT cell_id, value, n FROM ({tiled_sql(3, 4)}) WHERE z=3 AND x=0 AND y=3")
def seam_tile(spark: SparkSession, sf: str) -> DataFrame:
    located = S.LATTICE.with_centroid(hex_layer(S.order_layer(spark, sf, 4)), 4)
    return T.one_tile(located, 3, 0, 3, S.LATTICE.edge_deg(4)).select("cell_id", "value", "n")


@query("T5_tile_pyramid", " UNION ALL ".join(
    f"SELECT z, x, y, {hexed('cell_id')} AS h3id, value, n FROM ({tiled_sql(z, r)})"
    for z, r in ((3, 2), (4, 3), (5, 4), (6, 5))))
def whole_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    prices = S.table(spark, sf, "orders").select(
        S.cell_of_customer(F.col("o_custkey"), 5).alias("cell_id"), S.cents(F.col("o_totalprice")).alias("value"))
    return pyramid(mean_layer(prices, S.LATTICE, 5, scale=100), S.LATTICE, [3, 4, 5, 6], unique=True)


# hexagon indexes of customers at resolution 5; a cell lies where its least customer does
_HEX5 = f"((1::BIGINT << 59) | (5::BIGINT << 52) | (({{k}}%122) << 45) | ((({{k}}//2)%7) << 42) | ((({{k}}//5)%7) << 39) | {(1 << 39) - 1})"


def _hex5(k):
    index = F.lit((1 << 59) | (5 << 52) | ((1 << 39) - 1)).cast("bigint")
    return (index.bitwiseOR(F.shiftleft(k % 122, 45))
            .bitwiseOR(F.shiftleft(S.whole_quotient(k, 2) % 7, 42))
            .bitwiseOR(F.shiftleft(S.whole_quotient(k, 5) % 7, 39)))


_EDGE5 = "(1106.54::DOUBLE/(sqrt(7.0::DOUBLE)**5)/111.32::DOUBLE*1.5)"


@query("T5_hexagon_tiles", f"""
    WITH d AS (SELECT cell_id, {turned('k')}/1000.0::DOUBLE-180.0 AS lng, {risen('k')}/1000.0::DOUBLE-90.0 AS lat
      FROM (SELECT {_HEX5.format(k='c_custkey')} AS cell_id, min(c_custkey) AS k FROM customer GROUP BY 1)),
    l AS (SELECT {_HEX5.format(k='o_custkey')} AS cell_id, max(o_totalprice) AS value, count(*) AS n FROM orders GROUP BY 1)
    SELECT z, x, y, {hexed('cell_id')} AS h3id, value, n FROM l JOIN d USING (cell_id), ({tiles_sql(6)}) g
    WHERE (lng BETWEEN round(w-{_EDGE5},10) AND round(e+{_EDGE5},10)
        OR lng+360 BETWEEN round(w-{_EDGE5},10) AND round(e+{_EDGE5},10)
        OR lng-360 BETWEEN round(w-{_EDGE5},10) AND round(e+{_EDGE5},10))
      AND lat BETWEEN round(s-{_EDGE5},10) AND round(t+{_EDGE5},10)""")
def hexagon_tiles(spark: SparkSession, sf: str) -> DataFrame:
    places = S.table(spark, sf, "customer").groupBy(_hex5(F.col("c_custkey")).alias("cell_id")).agg(
        F.min("c_custkey").alias("k"))
    k = F.col("k")
    dim = places.select("cell_id", F.lit(5).alias("res"), ((S.lng_m(k) + 180000) / 1000.0 - 180.0).alias("lng"),
                        ((S.lat_m(k) + 90000) / 1000.0 - 90.0).alias("lat"))
    layer = S.table(spark, sf, "orders").groupBy(_hex5(F.col("o_custkey")).alias("cell_id")).agg(
        F.max("o_totalprice").alias("value"), F.count(F.lit(1)).alias("n"))
    return pyramid(lambda res: layer, Hexagons(dim), [6])


# order rows as layer rows, so that cells repeat
_RAW = f"SELECT {cell_sql('o_custkey', 4)} AS cell_id, o_totalprice AS value, o_orderkey AS n FROM orders"


@query("T6_capped_tiles", " UNION ALL ".join(
    f"(SELECT z, x, y, {hexed('cell_id')} AS h3id, value, n, count(*) OVER (PARTITION BY z,x,y) AS n_total "
    f"FROM ({tiled_sql(z, 4, _RAW)}) "
    "QUALIFY row_number() OVER (PARTITION BY z,x,y ORDER BY cell_id, value, n) <= 200)"
    for z in (0, 1, 2)))
def capped(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "orders").select(
        S.cell_of_customer(F.col("o_custkey"), 4).alias("cell_id"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("n"))
    return T.layer_tiles([(hex_layer(rows), 4, {0: 4, 1: 4, 2: 4})], S.LATTICE, cap=200)


def supplier_tiles(spark: SparkSession, sf: str, z: int) -> DataFrame:
    """The tiles suppliers are in: a set of requested tiles that comes from the data."""
    k = F.col("s_suppkey")
    n = float(2 ** z)
    lng, lat = S.lng_m(k) / 1000.0, S.lat_m(k) / 1000.0
    return S.table(spark, sf, "supplier").select(
        F.lit(z).alias("z"), F.floor((lng + 180.0) / 360.0 * n).cast("int").alias("x"),
        F.floor(cells.tile_row_at(lat, F.lit(n))).cast("int").alias("y")).distinct()


def supplier_tiles_sql(z: int) -> str:
    n = f"{2 ** z}::DOUBLE"
    k = "s_suppkey"
    lat = f"(({risen(k)}-90000)/1000.0::DOUBLE)"
    return (f"SELECT DISTINCT CAST(floor({turned(k)}/1000.0::DOUBLE/360.0*{n}) AS INTEGER) AS x, "
            f"CAST(floor({n}/2*(1-asinh(tan(radians({lat})))/pi())) AS INTEGER) AS y FROM supplier")


def coarse_sql(res: int = 3) -> str:
    n = 1 << (res + 2)
    cell = f"(({res}::BIGINT << 52) | (a.i << 26) | b.i)"
    return (f"SELECT c AS cell_id, {lng_of('c', res)} AS lng, {lat_of('c', res)} AS lat FROM "
            f"(SELECT {cell} AS c FROM range({n}) a(i), range({n}) b(i))")


def covering_sql(z: int) -> str:
    m = 360.0 / 32 * 2
    return (f"SELECT g.z, g.x, g.y, c.cell_id AS hex_prune FROM ({tiles_sql(z)}) g "
            f"JOIN ({supplier_tiles_sql(z)}) r USING (x, y), ({coarse_sql()}) c "
            f"WHERE (lng BETWEEN w-{m} AND e+{m} OR lng-360 BETWEEN w-{m} AND e+{m} OR lng+360 BETWEEN w-{m} AND e+{m}) "
            f"AND lat BETWEEN greatest(-89.9, s-{m}) AND least(89.9, t+{m})")


@query("T7_covering_cells", covering_sql(5) + " UNION ALL " + covering_sql(6))
def covers(spark: SparkSession, sf: str) -> DataFrame:
    tiles = supplier_tiles(spark, sf, 5).unionByName(supplier_tiles(spark, sf, 6))
    return T.covering(tiles, S.LATTICE)


@query("T8_pruned_tiles",
       f"SELECT z, x, y, cell_id, value, n FROM ({tiled_sql(5, 4)}) "
       f"JOIN ({supplier_tiles_sql(5)}) USING (x, y)")
def pruned(spark: SparkSession, sf: str) -> DataFrame:
    tiles = supplier_tiles(spark, sf, 5)
    k = F.col("o_custkey")
    orders = S.table(spark, sf, "orders").select(
        S.cell_of_customer(k, 4).alias("cell_id"), S.cents(F.col("o_totalprice")).alias("cents"),
        S.cell_of_customer(k, T.PRUNE_RES).alias("hex_prune"))
    path = scratch_path(spark, "located_orders")
    write_blocks(orders, path, S.LATTICE)
    scanned = T.prune_scan(spark.read.parquet(path), tiles, S.LATTICE, layer_res=4)
    layer = scanned.groupBy("cell_id").agg(
        (F.sum("cents").cast("double") / F.count(F.lit(1)) / 100).alias("value"),
        F.count(F.lit(1)).alias("n"))
    located = S.LATTICE.with_centroid(hex_layer(layer), 4)
    drawn = T.to_tiles(T.aimed(located, [5], S.LATTICE.edge_deg(4)))
    return drawn.select(*T.TILE, "cell_id", "value", "n").join(tiles, T.TILE, "left_semi")


_INDEX = ("((1::BIGINT << 59) | (7::BIGINT << 52) | ((o_custkey%122) << 45) | "
          "((o_custkey%7) << 42) | ((o_orderkey%7) << 39) | (((o_custkey//7)%7) << 36) | "
          "(((o_orderkey//7)%7) << 33) | (((o_custkey//49)%7) << 30) | "
          "(((o_orderkey//49)%7) << 27) | (((o_custkey//343)%7) << 24) | 16777215)")


def _parent_sql(res: int) -> str:
    blank = (1 << (3 * (15 - res))) - 1
    return f"((h & {~(15 << 52)}) | ({res}::BIGINT << 52) | {blank})"


@query("T9_resolution_and_parent",
       f"SELECT {hexed(_parent_sql(3))} AS res3, {hexed(_parent_sql(5))} AS res5, "
       f"CAST((h >> 52) & 15 AS INTEGER) AS res, count(*) AS n FROM (SELECT {_INDEX} AS h FROM orders) GROUP BY ALL")
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    # hexagon indexes of resolution 7 whose base cell and digits come from the order keys
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    digits = [c % 7, o % 7]
    for step in (7, 49):
        digits += [S.whole_quotient(c, step) % 7, S.whole_quotient(o, step) % 7]
    digits.append(S.whole_quotient(c, 343) % 7)
    index = F.lit((1 << 59) | (7 << 52) | 0xFFFFFF).cast("long").bitwiseOR(F.shiftleft(c % 122, 45))
    for i, d in enumerate(digits):
        index = index.bitwiseOR(F.shiftleft(d, 42 - 3 * i))
    h = S.table(spark, sf, "orders").select(index.alias("h"))
    return h.groupBy(
        cells.cell_hex(cells.hex_parent(F.col("h"), 3)).alias("res3"),
        cells.cell_hex(cells.hex_parent(F.col("h"), 5)).alias("res5"),
        cells.cell_resolution(F.col("h")).alias("res")).agg(F.count(F.lit(1)).alias("n"))


@query("S9_tile_documents",
       f"SELECT z, x, y, {hexed('cell_id')} AS h3id, value, CASE WHEN n > 10 THEN n END AS n, "
       f"n > 10 AS n_written FROM ({tiled_sql(4, 3)})")
def documents(spark: SparkSession, sf: str) -> DataFrame:
    layer = hex_layer(S.order_layer(spark, sf, 3).withColumn(
        "n", F.when(F.col("n") > 10, F.col("n"))))
    path = scratch_path(spark, "tiles")
    write_tile_documents(T.tile_documents(T.layer_tiles([(layer, 3, {4: 3})], S.LATTICE)), path)
    # read the documents back, so that what is compared is what a client would see
    docs = spark.read.parquet(path)
    cells_back = docs.select(*T.TILE, F.explode(F.from_json(
        "body", "cells array<map<string,string>>")["cells"]).alias("c"))
    return cells_back.select(
        *T.TILE, F.col("c.h3id"), F.col("c.value").cast("double").alias("value"),
        F.col("c.n").cast("bigint").alias("n"), F.map_contains_key("c", "n").alias("n_written"))
