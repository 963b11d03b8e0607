"""The release registry: which releases exist, and which are restricted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ENTRY = T.StructType([T.StructField(c, T.StringType())
                      for c in ("ver", "title", "status", "released", "access")])
WRAPPED = T.StructType([T.StructField("versions", T.ArrayType(ENTRY)), *ENTRY.fields])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of ``{"versions": [...]}`` or of a bare array, whichever the file holds."""
    raw = spark.read.schema(WRAPPED).json(path, multiLine=True)
    own = F.struct(*[F.col(c) for c in ENTRY.names])
    entries = F.coalesce(F.col("versions"), F.array(own))
    return (raw.select(F.explode(entries).alias("e")).select("e.*")
            .where(F.coalesce(*[F.col(c) for c in ENTRY.names]).isNotNull()))


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def release_view(registry: DataFrame) -> DataFrame:
    """Entries with their effective access, latest first; empty text counts as absent."""
    access = F.coalesce(
        _given("access"),
        F.when(F.col("status") == "prerelease", "restricted").otherwise("public"))
    dated = F.coalesce(_given("released"), F.col("ver"))
    return registry.withColumn("access", access).orderBy(dated.desc(), F.col("ver").desc())


def with_access(view: DataFrame, access: str) -> DataFrame:
    return view.where(F.col("access") == access)
