"""Model registry, footprints, item search and area reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.operators import models as M
from hexatlas.operators.raster import grid_bounds, layer_documents
from hexatlas.operators.space import cells_in_polygon, cells_in_polygons
from hexatlas.plans import standins as S
from hexatlas.session import scratch_path
from hexatlas.sources import stores
from hexatlas.suite.base import (
    MODEL_CELLS, grid_cell_sql, grid_col_sql, grid_row_sql, query, risen, turned)

# a pentagon with a notch; none of its vertices shares a latitude with a cell centre
RING = [(-120.0, -40.1), (60.0, -55.1), (90.0, 20.1), (-20.0, -10.1), (-60.0, 45.1)]

_KEYS = "SELECT mdl_key, row_number() OVER (ORDER BY mdl_key) AS mdl_id FROM (SELECT DISTINCT p_brand||'|'||p_type AS mdl_key FROM part)"
_LNG = "((cell_id-1)%720+0.5)*0.5::DOUBLE-180.0"
_LAT = "90.0-((cell_id-1)//720+0.5)*0.5::DOUBLE"


def _inside_sql(lng: str, lat: str, ring: list[tuple[float, float]] = RING) -> str:
    """Even-odd rule, one term per edge."""
    terms = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        terms.append(f"(CASE WHEN (({y1}::DOUBLE>{lat}) <> ({y2}::DOUBLE>{lat})) AND {lng} < "
                     f"({x2 - x1}::DOUBLE)*({lat}-({y1}::DOUBLE))/({y2}::DOUBLE-({y1}::DOUBLE))+({x1}::DOUBLE) "
                     "THEN 1 ELSE 0 END)")
    return f"(({'+'.join(terms)})%2=1)"


def area_sql(src: str) -> str:
    return (f"SELECT cell_id FROM (SELECT cell_id, {_LNG} AS lng, {_LAT} AS lat FROM ({src})) "
            f"WHERE {_inside_sql('lng', 'lat')}")


_GRID = f"SELECT DISTINCT {grid_cell_sql('c_custkey')} AS cell_id FROM customer"


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    return S.grid_centroid(S.raster(spark, sf).select("cell_id"))


@query("W1_model_ids", _KEYS)
def ids(spark: SparkSession, sf: str) -> DataFrame:
    keys = S.table(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("mdl_key"))
    return M.model_registry(keys)


@query("J5_resolved_keys", f"""
    WITH m AS ({_KEYS}), r AS (SELECT p_partkey, CASE WHEN p_size=1 THEN 'none|'||p_type
      ELSE p_brand||'|'||p_type END AS mdl_key FROM part)
    SELECT p_partkey, r.mdl_key, mdl_id FROM r JOIN m USING (mdl_key)""")
def resolved(spark: SparkSession, sf: str) -> DataFrame:
    return M.resolve_keys(_requests(spark, sf), ids(spark, sf))


@query("J5_unknown_keys", "SELECT DISTINCT 'none|'||p_type AS mdl_key FROM part WHERE p_size=1")
def unknown(spark: SparkSession, sf: str) -> DataFrame:
    return M.unknown_keys(_requests(spark, sf), ids(spark, sf))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.when(F.col("p_size") == 1, "none").otherwise(F.col("p_brand"))
    return S.table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("|", brand, "p_type").alias("mdl_key"))


_BOXES = (f"SELECT mdl_key, min({_LNG})-0.25 AS xmin, min({_LAT})-0.25 AS ymin, "
          f"max({_LNG})+0.25 AS xmax, max({_LAT})+0.25 AS ymax, count(*) AS n_cells "
          f"FROM ({MODEL_CELLS}) GROUP BY 1")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return M.footprints(S.grid_centroid(S.model_cells(spark, sf)), 0.25, 0.25)


@query("T14_model_footprints", _BOXES)
def model_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf)


# per customer, so that boxes are small and a search has something to leave out
_SMALL = (f"SELECT CAST(o_custkey AS VARCHAR) AS item_id, 'type'||(o_custkey%5) AS collection, "
          f"min({turned('o_custkey')}/1000.0::DOUBLE-180 - o_orderkey%9) AS xmin, "
          f"min({risen('o_custkey')}/1000.0::DOUBLE-90 - o_orderkey%4) AS ymin, "
          f"max({turned('o_custkey')}/1000.0::DOUBLE-180 + o_orderkey%9) AS xmax, "
          f"max({risen('o_custkey')}/1000.0::DOUBLE-90 + o_orderkey%4) AS ymax "
          "FROM orders GROUP BY 1,2")
_MEETS = "ymin<=40.5 AND ymax>=-10.25 AND (xmax>=150.75 OR xmin<=-140.25) AND collection IN ('type1','type3')"


def items(spark: SparkSession, sf: str) -> DataFrame:
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    # the kilometre-wide reach of an order around its customer
    lng, lat = (S.lng_m(k) + 180000) / 1000.0 - 180, (S.lat_m(k) + 90000) / 1000.0 - 90
    found = S.table(spark, sf, "orders").groupBy(
        k.cast("string").alias("mdl_key"), F.concat(F.lit("type"), k % 5).alias("collection")).agg(
        F.min(lng - o % 9).alias("xmin"), F.min(lat - o % 4).alias("ymin"),
        F.max(lng + o % 9).alias("xmax"), F.max(lat + o % 4).alias("ymax"))
    return M.catalogue_items(found, F.concat(F.lit("models/"), "mdl_key"), F.col("collection"))


@query("T15_item_search", f"SELECT item_id, 'models/'||item_id AS href FROM ({_SMALL}) WHERE {_MEETS}")
def search(spark: SparkSession, sf: str) -> DataFrame:
    return M.search(items(spark, sf), ["type1", "type3"],
                    (150.75, -10.25, -140.25, 40.5)).select("item_id", "href")


# across the antimeridian, with a notch
SEAM = [(150.0, -30.3), (205.0, -42.1), (188.0, 3.7), (216.0, 20.9), (170.0, 37.7)]


def _meets_ring_sql(ring: list[tuple[float, float]]) -> str:
    """The same test, edge by edge, at a turn to either side."""
    south, north = min(p[1] for p in ring), max(p[1] for p in ring)
    turns = []
    for turn in (0, 360, -360):
        left, right, terms = f"(xmin+{turn}.0::DOUBLE)", f"(xmax+{turn}.0::DOUBLE)", []
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            sides = ", ".join(f"({bx - ax!r}::DOUBLE)*({y}-({ay!r}::DOUBLE))-({by - ay!r}::DOUBLE)*({x}-({ax!r}::DOUBLE))"
                              for x in (left, right) for y in ("ymin", "ymax"))
            terms.append(f"({left}<={max(ax, bx)!r} AND {right}>={min(ax, bx)!r} AND ymin<={max(ay, by)!r} AND ymax>={min(ay, by)!r} "
                         f"AND least({sides})<=0 AND greatest({sides})>=0)")
        turns += terms + [_inside_sql(left, "ymin", ring)]
    return f"ymin<={north} AND ymax>={south} AND ({' OR '.join(turns)})"


@query("T15_item_search_polygon", " UNION ALL ".join(
    f"SELECT '{name}' AS area, collection, item_id FROM ({_SMALL}) WHERE {_meets_ring_sql(ring)}"
    for name, ring in (("notch", RING), ("seam", SEAM))))
def search_polygon(spark: SparkSession, sf: str) -> DataFrame:
    found = [M.search(items(spark, sf), intersects=ring).select(F.lit(name).alias("area"), "collection", "item_id")
             for name, ring in (("notch", RING), ("seam", SEAM))]
    return found[0].unionByName(found[1])


@query("T16_search_page", f"""
    WITH f AS (SELECT item_id FROM ({_SMALL}) WHERE {_MEETS})
    SELECT item_id, (SELECT count(*) FROM f) AS number_matched,
      least(10, (SELECT count(*) FROM f WHERE item_id>'300')) AS number_returned
    FROM f WHERE item_id>'300' ORDER BY item_id LIMIT 10""")
def second_page(spark: SparkSession, sf: str) -> DataFrame:
    return M.page(search(spark, sf).select("item_id"), limit=10, after="300")


@query("T13_cells_in_polygon", area_sql(_GRID))
def polygon(spark: SparkSession, sf: str) -> DataFrame:
    return cells_in_polygon(grid_cells(spark, sf), RING).select("cell_id")


# one diamond around every supplier
_DIAMOND = (f"(SELECT s_suppkey AS poly_id, {turned('s_suppkey')}/1000.0::DOUBLE-180 AS cx, "
            f"{risen('s_suppkey')}/1000.0::DOUBLE-90 AS cy FROM supplier)")


@query("T13_cells_in_polygons",
       f"SELECT poly_id, cell_id FROM (SELECT cell_id, {_LNG} AS lng, {_LAT} AS lat FROM ({_GRID})), {_DIAMOND} "
       "WHERE abs(lng-cx)/12.03 + abs(lat-cy)/8.03 < 1")
def polygons(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    cx, cy = (S.lng_m(k) + 180000) / 1000.0 - 180, (S.lat_m(k) + 90000) / 1000.0 - 90

    def vertex(dx: float, dy: float):
        return F.struct((cx + dx).alias("lng"), (cy + dy).alias("lat"))

    diamonds = S.table(spark, sf, "supplier").select(
        k.alias("poly_id"),
        F.array(vertex(12.03, 0.0), vertex(0.0, 8.03), vertex(-12.03, 0.0), vertex(0.0, -8.03)).alias("ring"))
    return cells_in_polygons(grid_cells(spark, sf), diamonds)


_AREA = f"SELECT cell_id FROM ({area_sql(_GRID)})"


@query("A9_area_scores",
       f"SELECT metric, CAST(sum(v) AS DOUBLE)/count(*)/100 AS score, count(*) AS n_cells FROM ("
       f"SELECT o_orderstatus AS metric, {grid_cell_sql('o_custkey')} AS cell_id, "
       "max(CAST(round(o_totalprice*100) AS BIGINT)) AS v FROM orders GROUP BY 1,2) "
       f"WHERE cell_id IN ({_AREA}) GROUP BY 1")
def area_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = S.table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("metric"), S.grid_cell(F.col("o_custkey")).alias("cell_id")).agg(
        F.max(S.cents(F.col("o_totalprice"))).alias("value"))
    found = M.scores_for_cells(scores, polygon(spark, sf))
    return found.select("metric", (F.col("score") / 100).alias("score"), "n_cells")


@query("A10_area_species",
       f"SELECT mdl_key, count(*) AS n_cells, avg(val) AS mean_val FROM ({MODEL_CELLS}) "
       f"WHERE cell_id IN ({_AREA}) GROUP BY 1")
def area_species(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cell_model")
    stores.write_cell_models(S.model_cells(spark, sf), path, S.GRID_COLUMNS, S.GRID_BLOCK)
    return M.species_for_cells(spark.read.parquet(path), polygon(spark, sf),
                               stores.grid_block(F.col("cell_id"), S.GRID_COLUMNS, S.GRID_BLOCK))


@query("T10_grid_bounds",
       f"SELECT min({grid_col_sql('c_custkey')})*0.5::DOUBLE-180.0 AS xmin, 90.0-(max({grid_row_sql('c_custkey')})+1)*0.5::DOUBLE AS ymin, "
       f"(max({grid_col_sql('c_custkey')})+1)*0.5::DOUBLE-180.0 AS xmax, 90.0-min({grid_row_sql('c_custkey')})*0.5::DOUBLE AS ymax FROM customer")
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return grid_bounds(S.raster(spark, sf), -180.0, 90.0, 0.5, 0.5)


@query("T11_layer_documents",
       "SELECT mdl_key, '{\"tilejson\":\"2.2.0\",\"name\":\"cells\",\"bounds\":['||xmin||','||ymin||','||xmax||','||ymax"
       "||'],\"center\":['||(xmin+xmax)/2||','||(ymin+ymax)/2||',0.0],\"minzoom\":0,\"maxzoom\":12,"
       "\"tiles\":[\"https://tiles.example.org/cells/{z}/{x}/{y}.png?colormap=spectral_r&mdl_key='||url_encode(mdl_key)||'\"]}' AS document "
       f"FROM ({_BOXES})")
def documents(spark: SparkSession, sf: str) -> DataFrame:
    return layer_documents(boxes(spark, sf), "cells", "https://tiles.example.org/cells",
                           {"colormap": F.lit("spectral_r"), "mdl_key": F.col("mdl_key")}) \
        .select("mdl_key", "document")
