"""Named datasets, their tables, and what the tables can do."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.functions.cells import MAX_RES, MIN_RES, ZOOM_BREAKS

PRUNE_COLUMN = "hex_prune"


def checked_registry(entries: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Dataset paths by name, from ``(name, path)`` entries; all faults are told at once."""
    listed = [(str(n or "").strip(), str(p or "").strip()) for n, p in entries]
    often = Counter(n for n, _ in listed)
    faults = {
        "unnamed": [p for n, p in listed if not n],
        "without a path": [n for n, p in listed if n and not p],
        "repeated": [n for n, k in often.items() if n and k > 1],
    }
    told = [f"{what}: {', '.join(map(repr, which))}" for what, which in faults.items() if which]
    if told or not listed:
        raise ValueError("; ".join(told) or "an empty registry")
    return dict(listed)


def discover(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """Names of the tables of a dataset: what its folder lists, through Hadoop's file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(n.removesuffix(suffix) for n in names if n.endswith(suffix))


def attach(spark: SparkSession, path: str, tables: list[str], suffix: str = ".parquet") -> list[str]:
    """Register tables of a dataset as read-only views over their files."""
    for name in tables:
        spark.read.parquet(f"{path}/{name}{suffix}").createOrReplaceTempView(name)
    return sorted(tables)


def table_list(spark: SparkSession, only: list[str] | None = None) -> DataFrame:
    """Attached tables in name order with their column counts and prune column if any.

    This is catalogue metadata, one row per table; no table is read.
    """
    names = sorted(t.name for t in spark.catalog.listTables() if only is None or t.name in only)
    rows = []
    for name in names:
        columns = spark.table(name).columns
        prune = next((c for c in columns if c.lower() == PRUNE_COLUMN), None)
        rows.append((name, len(columns), prune))
    return spark.createDataFrame(rows, "name string, n_columns int, prune_column string")


def prune_tables(spark: SparkSession, only: list[str] | None = None) -> dict[str, str]:
    """Lower-cased names of the tables that carry the prune column."""
    listed = table_list(spark, only).where(F.col("prune_column").isNotNull()).collect()
    return {r["name"].lower(): PRUNE_COLUMN for r in listed}


def describe(spark: SparkSession, registry: Mapping[str, str], dataset: str, tables: list[str] | None = None) -> dict:
    """What a client can ask for: tables, resolution columns, zoom breaks, datasets.

    ``tables`` are the dataset's own, as :func:`attach` returns them; without it every view of
    the session is listed, scratch tables never.
    """
    listed = [r["name"] for r in table_list(spark, tables).collect()]
    views = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    return {
        "dataset": dataset,
        "tables": [t for t in listed if t in views],
        "res_columns": [f"hex_h3res{r}" for r in range(MIN_RES, MAX_RES + 1)],
        "zoom_breaks": ZOOM_BREAKS,
        "datasets": sorted(registry),
    }


def described(spark: SparkSession, registry: Mapping[str, str], dataset: str, tables: list[str] | None = None) -> DataFrame:
    """:func:`describe` as rows ``kind, place, item``, places counted from 1."""
    info = describe(spark, registry, dataset, tables)
    rows = [(kind, i + 1, item if isinstance(item, str) else f"{item:g}") for kind in ("tables", "res_columns", "zoom_breaks", "datasets")
            for i, item in enumerate(info[kind])]
    return spark.createDataFrame(rows, "kind string, place int, item string")


def item_collections(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Items of several collections as one table with the collection id as a column."""
    parts = [spark.read.parquet(p).withColumn("collection", F.lit(c)) for c, p in paths.items()]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part, allowMissingColumns=True)
    return joined


def occurrence_files(spark: SparkSession, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """Occurrence records from every Parquet file that matches the pattern."""
    read = spark.read.parquet(pattern)
    return read if columns is None else read.select(*columns)


def csv_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headed CSV lookup table with a declared schema: no inference pass over the file."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")
