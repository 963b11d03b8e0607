"""Differences between result sets and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.operators.compare import list_diff, result_diff
from hexatlas.plans import standins as S
from hexatlas.suite.base import MEAN_PRICE, cell_sql, layer_sql, query

_CELL = cell_sql("o_custkey", 5)
# the second result set: open orders left out, so some cells change, some disappear
_OTHER = (f"SELECT {_CELL} AS cell_id, {MEAN_PRICE} AS value, count(*) AS n FROM orders "
          "WHERE o_orderpriority<>'5-LOW' GROUP BY 1")


@query("J6_result_diff", f"""
    WITH a AS ({layer_sql(5)}), b AS ({_OTHER}),
    j AS (SELECT coalesce(a.cell_id,b.cell_id) AS cell_id, a.cell_id IS NULL AS no_a, b.cell_id IS NULL AS no_b,
      a.value AS av, b.value AS bv, a.n AS an, b.n AS bn FROM a FULL JOIN b ON a.cell_id=b.cell_id)
    SELECT cell_id, '' AS field, CASE WHEN no_a THEN 'missing_left' ELSE 'missing_right' END AS kind FROM j WHERE no_a OR no_b
    UNION ALL SELECT cell_id, 'value', 'value' FROM j WHERE NOT no_a AND NOT no_b AND abs(av-bv)>1e-9
    UNION ALL SELECT cell_id, 'n', 'value' FROM j WHERE NOT no_a AND NOT no_b AND an<>bn""")
def results(spark: SparkSession, sf: str) -> DataFrame:
    other = (S.table(spark, sf, "orders").where(F.col("o_orderpriority") != "5-LOW")
             .groupBy(S.cell_of_customer(F.col("o_custkey"), 5).alias("cell_id"))
             .agg((F.sum(S.cents(F.col("o_totalprice"))).cast("double") / F.count(F.lit(1)) / 100).alias("value"),
                  F.count(F.lit(1)).alias("n")))
    return result_diff(S.order_layer(spark, sf, 5), other, ["cell_id"], unique_keys=True).select("cell_id", "field", "kind")


@query("J6_parity_of_copies", "SELECT 2*count(*) AS compared, 0::BIGINT AS differences FROM orders")
def copies(spark: SparkSession, sf: str) -> DataFrame:
    # order rows twice on each side, values shifted by less than the tolerance
    rows = S.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    left = rows.unionByName(rows)
    right = left.withColumn("value", F.col("value") + 1e-10)
    found = result_diff(left, right, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("c")).scalar()
    return left.agg(F.count(F.lit(1)).alias("compared")).withColumn("differences", found)


_NAMES_A = "SELECT p_name FROM part WHERE p_type<>'SMALL'"
_NAMES_B = "SELECT p_name FROM part WHERE p_brand<>'Brand#7'"


@query("J7_list_diff", f"""
    SELECT p_name, 'left' AS side, count(*) AS copies FROM ({_NAMES_A} EXCEPT ALL {_NAMES_B}) GROUP BY 1
    UNION ALL SELECT p_name, 'right', count(*) FROM ({_NAMES_B} EXCEPT ALL {_NAMES_A}) GROUP BY 1""")
def names(spark: SparkSession, sf: str) -> DataFrame:
    part = S.table(spark, sf, "part")
    return list_diff(part.where(F.col("p_type") != "SMALL").select("p_name"),
                     part.where(F.col("p_brand") != "Brand#7").select("p_name"))
