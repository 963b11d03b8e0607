"""The diversity store: built in one job, then served as layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.functions.systems import CellSystem
from hexatlas.operators import diversity as D
from hexatlas.operators.layers import Layer
from hexatlas.session import written
from hexatlas.sources import stores

METRICS = ["n", "sp", "shannon", "simpson", "es"]
TABLES = ["occ_h3", "idx_h3", "idx_h3_taxon"]


def build(occurrences: DataFrame, system: CellSystem, base: str, finest: int = 7,
          one_lineage: bool = False) -> None:
    """Write ``occ_h3``, ``idx_h3`` and ``idx_h3_taxon`` below ``base``.

    The records are scanned and counted once; the counted table is written to the shared
    folder, so the three stores start from files and not from the whole lineage.
    """
    keys = [k for k in D.TAXONOMY if k in occurrences.columns] + ["date_year"]
    counts = written(D.occurrence_counts(occurrences, keys), "counts")
    ranks = [r for r in D.INDEX_RANKS if r in keys]
    stores.write_occurrence_store(D.occurrence_store(counts, system, finest), f"{base}/occ_h3", system)
    stores.write_cell_index(D.cell_index(counts, system, finest), f"{base}/idx_h3", system)
    taxa = D.taxon_index(counts, system, finest, ranks=ranks, one_lineage=one_lineage)
    stores.write_taxon_index(D.with_prune_column(taxa, system, D.INDEX_RESOLUTIONS), f"{base}/idx_h3_taxon", system)


def layer(spark: SparkSession, base: str, metric: str, system: CellSystem | None = None,
          taxon: tuple[str, str] | None = None, taxa: DataFrame | None = None,
          years: tuple[int, int] | None = None,
          scan: Callable[[DataFrame], DataFrame] = lambda df: df) -> Layer:
    """A metric as a layer, from the cheapest table that can answer.

    No filter reads the precomputed cells; one ``(rank, taxon)`` of a precomputed rank
    reads its rows of the taxon table; a taxon set, a finer rank or a year range is
    computed live from the occurrence store. ``scan`` may narrow the table that is read.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")

    def as_layer(df: DataFrame) -> DataFrame:
        return df.select("cell_id", F.col(metric).cast("double").alias("value"), "n")

    def at(res: int) -> DataFrame:
        r = min(res, max(D.INDEX_RESOLUTIONS))
        if taxa is None and years is None and taxon is None:
            return as_layer(scan(spark.read.parquet(f"{base}/idx_h3")).where(F.col("res") == r))
        if taxa is None and years is None and taxon[0] in D.INDEX_RANKS:
            rank, name = taxon
            rows = scan(spark.read.parquet(f"{base}/idx_h3_taxon")).where(
                (F.col("rank") == rank) & (F.col("res") == r) & (F.col("taxon") == name))
            return as_layer(rows)
        where = None if taxon is None else F.col(taxon[0]) == taxon[1]
        store = scan(spark.read.parquet(f"{base}/occ_h3"))
        return as_layer(D.live_index(store, r, taxa, years, where, system))

    return at
