"""Environmental tables derived from the supplied business tables.

The supplied tables carry no coordinates or taxa. These functions give every customer a
place and read orders as observations, parts as species and brand/type as models, by
fixed integer formulas, so that results can be checked in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexatlas.functions.systems import Lattice, whole_quotient

LATTICE = Lattice()
FINEST = 7

# Half-degree grid: 720 columns from 180 W, 360 rows from 90 N, ids from 1.
GRID_STEP_M = 500
GRID_COLUMNS = 720
GRID_ROWS = 360
# Side of a store folder in grid cells: 18 x 9 folders.
GRID_BLOCK = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lng_m(k: Column) -> Column:
    """Longitude in milli-degrees of customer ``k``."""
    return (k * 137507) % 360000 - 180000


def lat_m(k: Column) -> Column:
    return (k * 61803) % 160000 - 80000


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def cell_of_customer(k: Column, res: int) -> Column:
    return LATTICE.cell_at(lng_m(k), lat_m(k), res)


def grid_row(k: Column) -> Column:
    return whole_quotient(F.lit(90000) - lat_m(k), GRID_STEP_M)


def grid_col(k: Column) -> Column:
    return whole_quotient(lng_m(k) + 180000, GRID_STEP_M)


def grid_cell(k: Column) -> Column:
    return grid_row(k) * GRID_COLUMNS + grid_col(k) + 1


def order_layer(spark: SparkSession, sf_dir: str, res: int) -> DataFrame:
    """Mean order price and order count per cell: the layer used throughout the checks."""
    priced = F.sum(cents(F.col("o_totalprice"))).cast("double")
    return (table(spark, sf_dir, "orders")
            .groupBy(cell_of_customer(F.col("o_custkey"), res).alias("cell_id"))
            .agg((priced / F.count(F.lit(1)) / 100).alias("value"),
                 F.count(F.lit(1)).alias("n")))


def grid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a row ``cell_id, value, seq`` of the half-degree grid, with repeats."""
    return table(spark, sf_dir, "orders").select(
        grid_cell(F.col("o_custkey")).alias("cell_id"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))


def occurrences(spark: SparkSession, sf_dir: str, res: int = FINEST,
                taxonomy: bool = True) -> DataFrame:
    """Line items as occurrence records: species = part, class = type, order = brand."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("aphiaid"),
        F.year("l_shipdate").alias("date_year"))
    placed = lines.join(
        table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            cell_of_customer(F.col("o_custkey"), res).alias("cell_id")),
        "l_orderkey").drop("l_orderkey")
    if not taxonomy:
        return placed
    taxa = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("aphiaid"), F.lit("part").alias("phylum"),
        F.col("p_type").alias("class"), F.col("p_brand").alias("order"))
    return placed.join(taxa, "aphiaid")


def type_node(p_type: Column) -> Column:
    """Node id of a part type; negative, so it cannot meet a part key."""
    return (F.ascii(p_type) * 100 + F.length(p_type)).cast("bigint") * -1000


def brand_node(p_type: Column, p_brand: Column) -> Column:
    return type_node(p_type) - F.substring(p_brand, 7, 10).cast("bigint")


ROOT_NODE = -1


def taxon_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, types, (type, brand) pairs and parts as ``taxonID, parentNameUsageID``."""
    part = table(spark, sf_dir, "part")
    kind, brand = F.col("p_type"), F.col("p_brand")
    parts = part.select(F.col("p_partkey").alias("taxonID"),
                        brand_node(kind, brand).alias("parentNameUsageID"))
    brands = part.select(brand_node(kind, brand).alias("taxonID"),
                         type_node(kind).alias("parentNameUsageID")).distinct()
    types = part.select(type_node(kind).alias("taxonID"),
                        F.lit(ROOT_NODE).cast("bigint").alias("parentNameUsageID")).distinct()
    root = spark.range(1).select(F.lit(ROOT_NODE).cast("bigint").alias("taxonID"),
                                 F.lit(None).cast("bigint").alias("parentNameUsageID"))
    return parts.unionByName(brands).unionByName(types).unionByName(root)


def model_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mdl_key, cell_id, val``: quantity sold per brand|type and half-degree cell.

    Quantities are summed per part and cell before the part attributes are joined.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    placed = lines.join(
        table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            grid_cell(F.col("o_custkey")).alias("cell_id")),
        "l_orderkey")
    per_part = placed.groupBy("l_partkey", "cell_id").agg(F.sum("l_quantity").alias("val"))
    keyed = per_part.join(
        table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.concat_ws("|", "p_brand", "p_type").alias("mdl_key")),
        "l_partkey")
    return keyed.groupBy("mdl_key", "cell_id").agg(F.sum("val").alias("val"))


def grid_centroid(df: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Centre of a half-degree cell, by arithmetic on its id."""
    zero_based = F.col(cell) - 1
    return df.withColumns({
        "lng": (zero_based % GRID_COLUMNS + 0.5) * 0.5 - 180.0,
        "lat": 90.0 - (whole_quotient(zero_based, GRID_COLUMNS) + 0.5) * 0.5,
    })


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels ``row, col, cell_id`` of the half-degree cells that have customers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        grid_row(k).alias("row"), grid_col(k).alias("col"),
        grid_cell(k).alias("cell_id")).distinct()
