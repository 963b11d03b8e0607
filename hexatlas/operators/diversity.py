"""Occurrence store, per-cell diversity indices, and taxonomic selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hexatlas.functions.diversity import SAMPLE, expected_species_sql, shannon, simpson
from hexatlas.functions.systems import CellSystem
from hexatlas.operators.tiling import PRUNE_RES
from hexatlas.session import written

# Resolution tiers of the occurrence store, of the indices, and the ranks
# that have precomputed indices.
STORE_TIERS = [3, 5, 7]
INDEX_RESOLUTIONS = [1, 2, 3, 4, 5, 6, 7]
INDEX_RANKS = ["phylum", "class", "order"]
TAXONOMY = ["aphiaid", "phylum", "class", "order", "family", "genus", "species"]


def roll_up(counts: DataFrame, system: CellSystem, finest: int, tiers: list[int],
            keys: list[str], measure: str) -> DataFrame:
    """A measure counted per finest cell and key, summed at each coarser resolution.

    Rows are dealt once, by key and coarsest ancestor: a key's cells of any resolution below one
    ancestor are then in one task, so no resolution is shuffled, and a key with a third of all
    rows is spread over the ancestors. The finest is passed through as it is.
    """
    def at(res: int) -> Column:
        return F.col("cell_id") if res == finest else system.parent(F.col("cell_id"), finest, res)

    dealt = counts.select(at(min(tiers)).alias("_top"), "cell_id", *keys, measure).repartition("_top", *keys)
    parts = []
    for res in sorted(tiers, reverse=True):
        rows = dealt if res == finest else dealt.select("_top", at(res).alias("cell_id"), *keys, measure).groupBy(
            "_top", "cell_id", *keys).agg(F.sum(measure).alias(measure))
        parts.append(rows.select(F.lit(res).alias("res"), "cell_id", *keys, measure))
    return reduce(DataFrame.unionByName, parts)


def occurrence_counts(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """Records per finest cell and key; repeated records combine before the shuffle.

    Input that is already counted (it has ``records``) is summed instead, so every store
    can be built from one counted table.
    """
    records = F.sum("records") if "records" in occurrences.columns else F.count(F.lit(1))
    return occurrences.groupBy("cell_id", *keys).agg(records.alias("records"))


def occurrence_store(occurrences: DataFrame, system: CellSystem, finest: int = 7,
                     tiers: list[int] = STORE_TIERS) -> DataFrame:
    """Records per resolution tier, cell, taxonomy and year, with the prune column."""
    keys = [k for k in TAXONOMY if k in occurrences.columns] + ["date_year"]
    counts = occurrence_counts(occurrences, keys)
    return with_prune_column(roll_up(counts, system, finest, tiers, keys, "records"), system, tiers)


def with_prune_column(store: DataFrame, system: CellSystem, tiers: list[int],
                      prune_res: int = PRUNE_RES) -> DataFrame:
    """Add ``hex_prune``, the coarse ancestor; NULL on rows coarser than it."""
    parent = F.lit(None).cast("bigint")
    for r in sorted(tiers):
        if r >= prune_res:
            at = F.col("cell_id") if r == prune_res else \
                system.parent(F.col("cell_id"), r, prune_res)
            parent = F.when(F.col("res") == r, at).otherwise(parent)
    return store.withColumn("hex_prune", parent)


def indices(species_counts: DataFrame, group: list[str], species: str = "aphiaid",
            count: str = "records", sample: int = SAMPLE) -> DataFrame:
    """``n, sp, shannon, simpson, es`` per group from counts per group and species.

    Species with equal counts contribute equally, so rows are first folded to one per
    (group, count). A group of N records has at most sqrt(2N) different counts: even a
    group with a third of a very large table folds to a few hundred thousand pairs, and
    each pair's sampling product is computed once.
    """
    folded = (species_counts.where(F.col(species).isNotNull())
              .groupBy(*group, F.col(count).alias("_n"))
              .agg(F.count(F.lit(1)).alias("_s")))
    return _from_pairs(folded, group, sample)


def _from_pairs(folded: DataFrame, group: list[str], sample: int) -> DataFrame:
    sums = folded.groupBy(*group).agg(
        F.expr("sum(_n * _s) as n"), F.expr("sum(_s) as sp"),
        F.expr("sum(_s * cast(_n as double) * ln(_n)) as _nlnn"),
        F.expr("sum(_s * cast(_n as double) * _n) as _nn"),
        F.expr("collect_list(struct(_n, _s)) as _pairs"))
    total = F.col("n").cast("double")
    expected = F.expr(expected_species_sql("_pairs", "cast(n as double)", sample))
    return sums.select(
        *group, "n", "sp",
        shannon(total, F.col("_nlnn")).alias("shannon"),
        simpson(total, F.col("_nn")).alias("simpson"),
        F.when(F.col("n") >= sample, expected).alias("es"))


def cell_index(occurrences: DataFrame, system: CellSystem, finest: int = 7,
               resolutions: list[int] = INDEX_RESOLUTIONS) -> DataFrame:
    """All-taxa indices per resolution and cell."""
    counts = occurrence_counts(occurrences, ["aphiaid"])
    per_res = roll_up(counts, system, finest, resolutions, ["aphiaid"], "records")
    return with_prune_column(indices(per_res, ["res", "cell_id"]), system, resolutions)


def taxon_index(occurrences: DataFrame, system: CellSystem, finest: int = 7,
                resolutions: list[int] = INDEX_RESOLUTIONS,
                ranks: list[str] = INDEX_RANKS, one_lineage: bool = False) -> DataFrame:
    """Indices per rank, taxon, resolution and cell.

    Ranks are unfolded after the roll-up, on rows already summed per cell and species.
    Records of one species may disagree on its higher taxa, so counts are summed again per
    taxon; say ``one_lineage`` when the taxonomy comes from a lookup with one row per
    species, and that shuffle of every species row is left out.
    """
    keys = ["aphiaid", *ranks]
    per_res = roll_up(occurrence_counts(occurrences, keys), system, finest, resolutions,
                      keys, "records")
    group = ["rank", "taxon", "res", "cell_id"]
    listed = ", ".join(f"struct('{r}' as rank, `{r}` as taxon)" for r in ranks)
    unfolded = (per_res.withColumn("_t", F.expr(f"explode(array({listed}))"))
                .where("_t.taxon IS NOT NULL")
                .select("_t.rank", "_t.taxon", "res", "cell_id", "aphiaid", "records"))
    if not one_lineage:
        unfolded = unfolded.groupBy(*group, "aphiaid").agg(F.sum("records").alias("records"))
    return indices(unfolded, group)


def tier_for(res: int, tiers: list[int] = STORE_TIERS) -> int:
    """Coarsest store tier that still resolves ``res``; the finest tier beyond that."""
    return min((t for t in tiers if t >= res), default=max(tiers))


def live_index(store: DataFrame, res: int, taxa: DataFrame | None = None,
               years: tuple[int, int] | None = None, where: Column | None = None,
               system: CellSystem | None = None) -> DataFrame:
    """Indices from the occurrence store for any taxon set and year range.

    A resolution between the tiers is rolled up from the next finer one (give ``system``).
    """
    tier = tier_for(res)
    rows = store.where(F.col("res") == tier)
    if years is not None:
        rows = rows.where(F.col("date_year").between(*years))
    if where is not None:
        rows = rows.where(where)
    if taxa is not None:
        rows = of_taxa(rows, taxa)
    cell = F.col("cell_id")
    if res < tier:
        if system is None:
            raise ValueError(f"resolution {res} is between tiers: a cell system is needed")
        cell = system.parent(cell, tier, res)
    per_species = rows.groupBy(cell.alias("cell_id"), "aphiaid").agg(
        F.sum("records").alias("records"))
    return indices(per_species, ["cell_id"])


def of_taxa(rows: DataFrame, taxa: DataFrame, key: str = "aphiaid") -> DataFrame:
    """Rows whose taxon is in ``taxa(taxonID)``; a semi join, so repeats do not multiply."""
    ids = taxa.select(F.col("taxonID").alias(key))
    return rows.join(ids, key, "left_semi")


def descendants(taxon: DataFrame, roots: DataFrame) -> DataFrame:
    """All taxa below the roots, the roots included, to any depth.

    ``taxon(taxonID, parentNameUsageID)``, ``roots(taxonID)``. Each step takes the children
    of the taxa found last that were not found before, until there are none; steps are
    tables in the shared folder, so a step is never worked out again and a cycle ends.
    """
    pairs = taxon.select("taxonID", "parentNameUsageID")
    edge = written(pairs.join(roots.select("taxonID").distinct(), "taxonID", "left_semi"), "descendants")
    found = edge
    while not edge.isEmpty():
        below = pairs.join(edge.select(F.col("taxonID").alias("parentNameUsageID")).distinct(), "parentNameUsageID", "left_semi")
        edge = written(below.join(found.select("taxonID"), "taxonID", "left_anti"), "descendants")
        found = found.unionByName(edge)
    return found
