"""Registries, sources, stores and releases: written once, read back and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hexatlas.functions.cells import MAX_RES, MIN_RES
from hexatlas.operators import diversity as D
from hexatlas.operators.layers import hex_layer, with_res_columns
from hexatlas.operators.models import keyed_by_id, model_registry
from hexatlas.plans import index_store, standins as S
from hexatlas.plans.hex_tiles import stored_tile
from hexatlas.plans.raster_tiles import model_layer
from hexatlas.session import scratch_path
from hexatlas.sources import registry, releases, stores
from hexatlas.suite.base import (
    MODEL_CELLS, OCCURRENCES, cell_sql, hexed, lat_of, lng_of, north_sql, query)
from hexatlas.suite.diversity import _indices_sql, _tiers_sql, rounded

TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
          "nation", "orders", "pages", "part", "region", "supplier"]
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES)


def _counts(spark: SparkSession, names: list[str]) -> DataFrame:
    parts = [spark.table(t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows")
             for t in names]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query("S1_dataset_registry", f"SELECT 'main' AS dataset, name, n_rows FROM ({_COUNTS})")
def datasets(spark: SparkSession, sf: str) -> DataFrame:
    found = registry.checked_registry([("main", sf), ("copy", f" {sf} ")])
    names = registry.attach(spark, found["main"], registry.discover(spark, found["main"]))
    return _counts(spark, names).select(F.lit("main").alias("dataset"), "name", "n_rows")


_WIDTHS = {"benchmark": 2, "conversations": 4, "customer": 5, "documents": 5, "embeddings": 3, "events": 6,
           "labels": 3, "lineitem": 11, "nation": 3, "orders": 6, "pages": 3, "part": 6, "region": 2, "supplier": 4}


@query("S2_table_list", "SELECT name, n_rows, n_columns FROM (" + _COUNTS + ") JOIN (VALUES "
       + ",".join(f"('{t}',{n})" for t, n in _WIDTHS.items()) + ") w(name, n_columns) USING (name)")
def tables(spark: SparkSession, sf: str) -> DataFrame:
    names = registry.attach(spark, sf, registry.discover(spark, sf))
    listed = registry.table_list(spark, only=names).select("name", "n_columns")
    return listed.join(_counts(spark, names), "name")


# with each table's rows, so that the list is of tables that can be read
@query("S2_described", f"""
    SELECT 'tables' AS kind, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS place, name AS item, n_rows FROM ({_COUNTS})
    UNION ALL SELECT 'res_columns', CAST(i AS INTEGER), 'hex_h3res'||i, NULL FROM range(1, 11) t(i)
    UNION ALL SELECT 'zoom_breaks', CAST(p AS INTEGER), v, NULL FROM (SELECT unnest(
      ['0','2.2','3.4','4.6','5.8','7','8.2','9.4','10.6','11.8','22']) AS v, unnest(range(1, 12)) AS p)
    UNION ALL SELECT 'datasets', 1, 'main', NULL""")
def describe(spark: SparkSession, sf: str) -> DataFrame:
    names = registry.attach(spark, sf, registry.discover(spark, sf))
    rows = registry.described(spark, {"main": sf}, "main", names)
    counts = _counts(spark, names).select(F.lit("tables").alias("kind"), F.col("name").alias("item"), "n_rows")
    return rows.join(counts, ["kind", "item"], "left").select("kind", "place", "item", "n_rows")


_STORE = (f"WITH occ AS ({OCCURRENCES}) SELECT res, cell_id, hex_prune, aphiaid, phylum, class, \"order\", "
          f"date_year, count(*) AS records FROM ({_tiers_sql([3, 5, 7])}) GROUP BY ALL")


def _store(spark: SparkSession, sf: str) -> DataFrame:
    return D.occurrence_store(S.occurrences(spark, sf), S.LATTICE, S.FINEST)


@query("S3_prune_tables", f"SELECT 'occ_h3' AS name, 'hex_prune' AS prune_column, count(*) AS n_rows FROM ({_STORE})")
def prunable(spark: SparkSession, sf: str) -> DataFrame:
    _store(spark, sf).createOrReplaceTempView("occ_h3")
    S.taxon_tree(spark, sf).createOrReplaceTempView("taxon")
    able = registry.prune_tables(spark, only=["occ_h3", "taxon"])
    listed = spark.createDataFrame(list(able.items()), "name string, prune_column string")
    return listed.join(_counts(spark, list(able)), "name")


def _model_store(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    # the registry is written too: both its readers then see one set of ids
    path = scratch_path(spark, "model_cell")
    cells = S.model_cells(spark, sf)
    ids = scratch_path(spark, "model")
    keys = S.table(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("mdl_key"))
    model_registry(keys).write.parquet(ids)
    reg = spark.read.parquet(ids)
    stores.write_model_cells(keyed_by_id(cells, reg), path)
    return path, reg


@query("S6_model_store", MODEL_CELLS)
def model_store(spark: SparkSession, sf: str) -> DataFrame:
    path, reg = _model_store(spark, sf)
    return spark.read.parquet(path).join(reg, "mdl_id").select("mdl_key", "cell_id", "val")


@query("S4_one_model", f"SELECT cell_id, val AS value FROM ({MODEL_CELLS}) WHERE mdl_key='Brand#7|SMALL'")
def one_model(spark: SparkSession, sf: str) -> DataFrame:
    path, reg = _model_store(spark, sf)
    return model_layer(spark.read.parquet(path), reg, "Brand#7|SMALL")


@query("S5_served_view", f"SELECT mdl_key, sum(val) AS total, count(*) AS n FROM ({MODEL_CELLS}) GROUP BY 1")
def served(spark: SparkSession, sf: str) -> DataFrame:
    path, reg = _model_store(spark, sf)
    stores.serve(spark, path, "model_cell")
    reg.createOrReplaceTempView("model")
    return spark.sql("SELECT mdl_key, SUM(val) AS total, COUNT(*) AS n "
                     "FROM model_cell JOIN model USING (mdl_id) GROUP BY mdl_key")


@query("S7_cell_store", MODEL_CELLS)
def cell_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cell_model")
    stores.write_cell_models(S.model_cells(spark, sf), path, S.GRID_COLUMNS, S.GRID_BLOCK)
    return spark.read.parquet(path).drop("block")


@query("S8_occurrence_store", _STORE)
def stored_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "occ_h3")
    stores.write_occurrence_store(_store(spark, sf), path, S.LATTICE)
    return spark.read.parquet(path).drop("block")


_AT3 = "((3::BIGINT << 52) | ((((cell_id >> 26) & 67108863) >> {g}) << 26) | ((cell_id & 67108863) >> {g}))"
_PRUNE_CASES = "CASE res " + " ".join(f"WHEN {r} THEN {_AT3.format(g=r - 3)}" for r in D.INDEX_RESOLUTIONS if r >= 3) + " END"


@query("S8_taxon_index_store", f"SELECT *, {_PRUNE_CASES} AS hex_prune FROM (" + _indices_sql(
    " UNION ALL ".join(
        f"SELECT '{rank}' AS rank, \"{rank}\" AS taxon, res, cell_id, aphiaid, 1 AS w "
        f"FROM ({_tiers_sql(D.INDEX_RESOLUTIONS)})" for rank in D.INDEX_RANKS), "rank, taxon, res, cell_id") + ")")
def stored_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "idx_h3_taxon")
    index = D.taxon_index(S.occurrences(spark, sf), S.LATTICE, one_lineage=True)
    stores.write_taxon_index(D.with_prune_column(index, S.LATTICE, D.INDEX_RESOLUTIONS), path, S.LATTICE)
    return rounded(spark.read.parquet(path))


_EDITIONS = {
    "v20240101": "SELECT * FROM orders WHERE o_orderstatus='F'",
    "v20250601": "SELECT * FROM orders",
}


@query("S10_releases", " UNION ALL ".join(
    f"SELECT '{asked}' AS asked, o_orderstatus, count(*) AS n FROM ({_EDITIONS[r]}) GROUP BY 2"
    for asked, r in (("latest", "v20250601"), ("v20240101", "v20240101"), ("v20250601", "v20250601"),
                     ("rolled back", "v20240101"))))
def released(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "releases")
    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    stores.write_release(orders.where(F.col("o_orderstatus") == "F"), base, "v20240101")
    stores.write_release(orders, base, "v20250601")

    def counted(asked: str, release: str | None) -> DataFrame:
        return (stores.read_release(spark, base, release).groupBy("o_orderstatus")
                .agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(asked).alias("asked"), "o_orderstatus", "n"))

    parts = [counted("latest", None), counted("v20240101", "v20240101"), counted("v20250601", "v20250601")]
    stores.make_current(spark, base, "v20240101")
    return reduce(DataFrame.unionByName, [*parts, counted("rolled back", None)])


@query("S11_occurrence_files", "SELECT l_partkey AS aphiaid, count(*) AS records FROM lineitem GROUP BY 1")
def occurrence_files(spark: SparkSession, sf: str) -> DataFrame:
    read = registry.occurrence_files(spark, f"{sf}/linei*.parquet", ["l_partkey"])
    return read.groupBy(F.col("l_partkey").alias("aphiaid")).agg(F.count(F.lit(1)).alias("records"))


_TYPE = "(-1000*(ascii(p_type)*100+length(p_type)))::BIGINT"
_BRAND = f"({_TYPE}-CAST(substr(p_brand,7) AS BIGINT))"


@query("S12_csv_lookup", f"""
    SELECT p_partkey AS taxonID, {_BRAND} AS parentNameUsageID FROM part
    UNION ALL SELECT DISTINCT {_BRAND}, {_TYPE} FROM part
    UNION ALL SELECT DISTINCT {_TYPE}, -1::BIGINT FROM part
    UNION ALL SELECT -1::BIGINT, NULL""")
def csv_tree(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "taxon_csv")
    S.taxon_tree(spark, sf).write.csv(path, header=True)
    return registry.csv_lookup(spark, path, "taxonID BIGINT, parentNameUsageID BIGINT")


# one release per month of orders: even months are pre-releases, every third has no date
_RELEASES = """
    WITH m AS (SELECT year(o_orderdate)*12+month(o_orderdate) AS i, strftime(min(o_orderdate),'v%Y%m') AS ver,
      count(*) AS c, strftime(min(o_orderdate),'%Y-%m') AS ym FROM orders GROUP BY 1)
    SELECT ver, c||' orders' AS title, CASE WHEN i%2=0 THEN 'prerelease' ELSE 'released' END AS status,
      CASE WHEN i%3=0 THEN '' ELSE ym||'-15' END AS released,
      CASE WHEN i%5=0 THEN 'public' WHEN i%5=1 THEN '' END AS access FROM m"""


def _release_file(spark: SparkSession, sf: str, wrapped: bool) -> str:
    d = F.col("o_orderdate")
    i = F.year(d) * 12 + F.month(d)
    months = S.table(spark, sf, "orders").groupBy(i.alias("i")).agg(
        F.count(F.lit(1)).alias("c"), F.min(d).alias("d"))
    i = F.col("i")
    entry = F.struct(
        F.date_format("d", "'v'yyyyMM").alias("ver"), F.concat("c", F.lit(" orders")).alias("title"),
        F.when(i % 2 == 0, "prerelease").otherwise("released").alias("status"),
        F.when(i % 3 == 0, "").otherwise(F.date_format("d", "yyyy-MM'-15'")).alias("released"),
        F.when(i % 5 == 0, "public").when(i % 5 == 1, "").alias("access"))
    # one entry per month: the document is as long as the calendar, not as the table
    listed = months.agg(F.collect_list(entry).alias("versions"))
    text = F.to_json(F.struct("versions") if wrapped else F.col("versions"))
    path = scratch_path(spark, "versions_json")
    listed.select(text.alias("value")).coalesce(1).write.text(path)
    return path


@query("S14_release_registry", _RELEASES + " UNION ALL " + _RELEASES.replace("WITH m AS", "SELECT * FROM (WITH m AS") + ")")
def release_files(spark: SparkSession, sf: str) -> DataFrame:
    both = [releases.read_registry(spark, _release_file(spark, sf, w)) for w in (True, False)]
    return both[0].unionByName(both[1])


@query("W2_release_view", f"""
    WITH r AS ({_RELEASES}) SELECT ver, coalesce(nullif(access,''), CASE WHEN status='prerelease' THEN 'restricted'
      ELSE 'public' END) AS access, CAST(row_number() OVER (ORDER BY coalesce(nullif(released,''),ver) DESC, ver DESC) AS INTEGER) AS place FROM r""")
def release_view(spark: SparkSession, sf: str) -> DataFrame:
    view = releases.release_view(releases.read_registry(spark, _release_file(spark, sf, True)))
    # the place makes the order visible to an unordered comparison; one row per month
    dated = F.coalesce(F.nullif("released", F.lit("")), "ver")
    place = F.row_number().over(Window.orderBy(dated.desc(), F.col("ver").desc()))
    return view.select("ver", "access", place.alias("place"))


@query("S15_item_collections",
       "SELECT p_type AS collection, p_partkey AS item_id, p_size AS rows_hint FROM part")
def item_files(spark: SparkSession, sf: str) -> DataFrame:
    part = S.table(spark, sf, "part")
    path = scratch_path(spark, "items")
    (part.select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("item_id"), F.col("p_size").alias("rows_hint"))
     .write.partitionBy("kind").parquet(path))
    # the map of collections comes from the data: there are as many as part types
    kinds = [r["p_type"] for r in part.select("p_type").distinct().collect()]
    return registry.item_collections(spark, {k: f"{path}/kind={k}" for k in kinds})


@query("P3_resolution_columns", "SELECT c_custkey, " + ", ".join(
    f"{cell_sql('c_custkey', r)} AS hex_h3res{r}" for r in range(MIN_RES, MAX_RES + 1)) + " FROM customer")
def wide(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return with_res_columns(S.table(spark, sf, "customer").select("c_custkey"),
                            S.cell_of_customer(k, 10), lambda c, r: S.LATTICE.parent(c, 10, r))


_BUILT = f"""
    WITH occ AS ({OCCURRENCES}), t AS ({_tiers_sql(list(range(1, 8)))}),
    s AS (SELECT res, cell_id, aphiaid, phylum, class, "order", date_year, count(*) AS c FROM t GROUP BY ALL)
    SELECT 'occ_h3' AS store, res, count(*) AS n_rows, CAST(sum(c) AS BIGINT) AS records FROM s WHERE res IN (3,5,7) GROUP BY 2
    UNION ALL SELECT 'idx_h3', res, count(DISTINCT cell_id), CAST(sum(c) AS BIGINT) FROM s GROUP BY 2
    UNION ALL SELECT 'idx_h3_taxon', res, count(DISTINCT cell_id) + count(DISTINCT (cell_id, class)) + count(DISTINCT (cell_id, "order")),
      CAST(3*sum(c) AS BIGINT) FROM s GROUP BY 2"""


def _built(spark: SparkSession, sf: str) -> str:
    base = scratch_path(spark, "store")
    index_store.build(S.occurrences(spark, sf), S.LATTICE, base, one_lineage=True)
    return base


@query("S8_store_build", _BUILT)
def built(spark: SparkSession, sf: str) -> DataFrame:
    base = _built(spark, sf)
    parts = [spark.read.parquet(f"{base}/{t}").groupBy("res").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(m).alias("records")).select(F.lit(t).alias("store"), "res", "n_rows", "records")
        for t, m in zip(index_store.TABLES, ("records", "n", "n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _metric_sql(res: int, where: str) -> str:
    return (f"SELECT {cell_sql('k', res)} AS cell_id, count(DISTINCT aphiaid)::DOUBLE AS value, count(*) AS n "
            f"FROM occ WHERE {where} GROUP BY 1")


# the same metric from each table: precomputed, per taxon, live at a tier, live between tiers, and clamped
@query("S8_store_layers", f"WITH occ AS ({OCCURRENCES}) " + " UNION ALL ".join(
    f"SELECT '{name}' AS source, * FROM ({_metric_sql(res, where)})" for name, res, where in (
        ("cells", 4, "true"), ("taxon", 6, "class='SMALL'"), ("years", 5, "date_year BETWEEN 1996 AND 1998"),
        ("between", 2, "date_year>=1999"), ("clamped", 7, "true"))))
def store_layers(spark: SparkSession, sf: str) -> DataFrame:
    base = _built(spark, sf)

    def asked(name: str, res: int, **filters) -> DataFrame:
        at = index_store.layer(spark, base, "sp", S.LATTICE, **filters)
        return hex_layer(at(res)).select(F.lit(name).alias("source"), "cell_id", "value", "n")

    parts = [asked("cells", 4), asked("taxon", 6, taxon=("class", "SMALL")), asked("years", 5, years=(1996, 1998)),
             asked("between", 2, years=(1999, 9999)), asked("clamped", 9)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


# drawn at resolution 8: the cells stop at 7, the buffer does not
def _deep_sql(source: str, where: str) -> str:
    z, x, y, b = 3, 2, 3, 360.0 / (1 << 10) * 1.5
    n = f"{2 ** z}::DOUBLE"
    w, e = f"round({x}/{n}*360.0-180.0-{b},10)", f"round({x + 1}/{n}*360.0-180.0+{b},10)"
    s, t = f"round({north_sql(str(y + 1), n)}-{b},10)", f"round({north_sql(str(y), n)}+{b},10)"
    return (f"SELECT '{source}' AS source, {hexed('cell_id')} AS h3id, value, n FROM (SELECT *, {lng_of('cell_id', 7)} AS lng, "
            f"{lat_of('cell_id', 7)} AS lat FROM ({_metric_sql(7, where)})) WHERE lng BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {t}")


@query("T8_stored_tile", f"WITH occ AS ({OCCURRENCES}) " + _deep_sql("cells", "true") + " UNION ALL "
       + _deep_sql("years", "date_year BETWEEN 1996 AND 1998"))
def stored_tiles(spark: SparkSession, sf: str) -> DataFrame:
    base = _built(spark, sf)
    parts = [stored_tile(spark, base, "sp", S.LATTICE, 3, 2, 3, res=8, **f).select(F.lit(name).alias("source"), "h3id", "value", "n")
             for name, f in (("cells", {}), ("years", {"years": (1996, 1998)}))]
    return parts[0].unionByName(parts[1])
