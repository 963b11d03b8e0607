"""The layer contract and layer summaries.

A layer is a DataFrame with ``cell_id``, ``value`` and optionally ``n``, one resolution
at a time. Everything a layer goes through before tiling is a narrow projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexatlas.functions.keys import BBOX_SLOT, RES_SLOT
from hexatlas.functions.values import finite, json_safe
from hexatlas.operators.ranking import exact_percentiles

REQUIRED = {"cell_id", "value"}
OPTIONAL = {"n"}

Layer = Callable[[int], DataFrame]


class LayerContractError(ValueError):
    """The columns of a layer are not exactly ``cell_id, value[, n]``."""


def check_contract(df: DataFrame) -> bool:
    """Check the analysed columns (so ``*`` needs no special rule); True when ``n`` is there.

    A layer has one of two shapes, compared as a whole and whatever the order of columns.
    """
    shape = sorted(c.lower() for c in df.columns)
    for with_n in (False, True):
        if shape == sorted(REQUIRED | (OPTIONAL if with_n else set())):
            return with_n
    raise LayerContractError(f"a layer is (cell_id, value) with or without n, not ({', '.join(shape)})")


def typed(df: DataFrame) -> DataFrame:
    """``cell_id BIGINT, value DOUBLE, n BIGINT`` (NULL ``n`` when absent or not a number)."""
    has_n = check_contract(df)
    n = F.col("n").try_cast("bigint") if has_n else F.lit(None).cast("bigint")
    return df.select(F.col("cell_id").cast("bigint").alias("cell_id"),
                     F.col("value").cast("double").alias("value"), n.alias("n"))


def hex_layer(df: DataFrame) -> DataFrame:
    """Contract, types and the finite-value filter of the hexagon service."""
    return typed(df).where(finite(F.col("value")))


def grid_layer(df: DataFrame) -> DataFrame:
    """Contract and filter of the grid service: finite values on positive cell ids."""
    return (typed(df).select("cell_id", "value")
            .where(finite(F.col("value")) & (F.col("cell_id") > 0)))


def res_column(res: int) -> Column:
    """The id column for one resolution of a table that carries all ten."""
    return F.col(f"hex_h3res{res}")


def with_res_columns(df: DataFrame, finest: Column, parent: Callable[[Column, int], Column],
                     resolutions: range = range(1, 11)) -> DataFrame:
    """Add one id column per resolution, ``hex_h3res1`` .. ``hex_h3res10``."""
    return df.withColumns({f"hex_h3res{r}": parent(finest, r) for r in resolutions})


def sql_text(template: str, res: int) -> str:
    """Fill the resolution slots of a query text and drop the retired box slot."""
    if not template:
        raise ValueError("empty query text")
    return re.sub(BBOX_SLOT, "", re.sub(RES_SLOT, str(int(res)), template))


def sql_layer(spark: SparkSession, template: str, **views: DataFrame) -> Layer:
    """A layer from query text over registered views; Spark parses and rejects.

    ``views`` are registered as temporary views first, under their keyword names. The text
    is wrapped as a subquery, so a command (which has none) fails to parse and is not run.

    A recursion may give any number of rows: the session's limit of a million, an error beyond
    it, is lifted. Endless ones still end with an error at the limit of levels.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return lambda res: spark.sql(f"SELECT * FROM (\n{sql_text(template, res)}\n)")


def cell_aggregate(rows: DataFrame, cell: Column, value: Column, how: str = "avg",
                   where: Column | None = None) -> DataFrame:
    """Per-cell ``avg``, ``sum`` or ``count`` of an observation table, with the row count."""
    picked = rows if where is None else rows.where(where)
    makers = {"avg": F.avg, "sum": F.sum, "count": F.count}
    return picked.groupBy(cell.alias("cell_id")).agg(
        makers[how](value).alias("value"), F.count(F.lit(1)).alias("n"))


def exact_mean(cents: Column) -> Column:
    """Mean of integer cents in units: one exact sum, one division each by n and 100."""
    return F.sum(cents).cast("double") / F.count(cents) / 100


def hex_summary(layer: DataFrame, exact: bool = False, accuracy: int = 10000) -> DataFrame:
    """One row ``min, max, p02, p98, n`` over the finite values of a layer.

    The default quantiles are a mergeable sketch, one pass; ``exact`` ranks the values.
    """
    rows = hex_layer(layer)
    v = F.col("value")
    basic = [F.min(v).alias("min"), F.max(v).alias("max")]
    if not exact:
        both = F.percentile_approx(v, [0.02, 0.98], accuracy).alias("_q")
        return rows.agg(*basic, both, F.count(F.lit(1)).alias("n")).select(
            "min", "max", F.get("_q", F.lit(0)).alias("p02"), F.get("_q", F.lit(1)).alias("p98"), "n")
    return _beside(rows.agg(*basic, F.count(F.lit(1)).alias("n")),
                   exact_percentiles(rows, "value", {"p02": 0.02, "p98": 0.98}),
                   ["min", "max", "p02", "p98", "n"])


def grid_summary(value_map: DataFrame) -> DataFrame:
    """One row ``n, min, max, mean, std, p2, p50, p98``; population deviation, exact ranks."""
    v = F.col("value")
    basic = value_map.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("min"),
                          F.max(v).alias("max"), F.avg(v).alias("mean"),
                          F.stddev_pop(v).alias("std"))
    ranks = exact_percentiles(value_map, "value", {"p2": 0.02, "p50": 0.5, "p98": 0.98})
    return _beside(basic, ranks, ["n", "min", "max", "mean", "std", "p2", "p50", "p98"])


def _beside(one: DataFrame, other: DataFrame, order: list[str]) -> DataFrame:
    """Put two one-row results side by side through a scalar subquery."""
    packed = other.select(F.struct(*other.columns).alias("s")).scalar()
    return (one.withColumn("_s", packed)
            .select(*one.columns, *[F.col(f"_s.{c}").alias(c) for c in other.columns])
            .select(*order))


def json_safe_row(summary: DataFrame) -> DataFrame:
    """Every double of a summary as JSON-safe text; other columns unchanged."""
    doubles = {n for n, t in summary.dtypes if t == "double"}
    return summary.select(*[
        json_safe(F.col(c)).alias(c) if c in doubles else F.col(c) for c in summary.columns])
