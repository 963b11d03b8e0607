"""Occurrence store, diversity indices, taxonomic recursion and semi join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.operators import diversity as D
from hexatlas.plans import standins as S
from hexatlas.suite.base import OCCURRENCES, cell_sql, query

FINEST = S.FINEST


def _tiers_sql(tiers: list[int]) -> str:
    return " UNION ALL ".join(
        f"SELECT {r} AS res, {cell_sql('k', r)} AS cell_id, "
        + (f"{cell_sql('k', 3)}" if r >= 3 else "CAST(NULL AS BIGINT)")
        + " AS hex_prune, * FROM occ" for r in tiers)


def _log_gamma_es(total: str, n: str) -> str:
    return (f"(1 - CASE WHEN {total}-{n} < 50 THEN 0 ELSE exp(lgamma({total}-{n}+1) - "
            f"lgamma({total}-{n}-49) - lgamma({total}+1) + lgamma({total}-49)) END)")


def _indices_sql(src: str, group: str) -> str:
    """Indices the long way round: totals joined to species counts, log-gamma for es."""
    return (f"WITH occ AS ({OCCURRENCES}), t AS ({src}), "
            f"s AS (SELECT {group}, aphiaid, sum(w)::DOUBLE AS ni FROM t GROUP BY ALL), "
            f"a AS (SELECT *, sum(ni) OVER (PARTITION BY {group}) AS tot FROM s) "
            f"SELECT {group}, CAST(sum(ni) AS BIGINT) AS n, count(*) AS sp, "
            "round(-sum(ni/tot*ln(ni/tot)),6) AS shannon, sum(ni*ni)/(any_value(tot)*any_value(tot)) AS simpson, "
            f"CASE WHEN any_value(tot) >= 50 THEN round(sum(CASE WHEN tot>=50 THEN {_log_gamma_es('tot', 'ni')} END),5) END AS es "
            f"FROM a GROUP BY {group}")


def rounded(df: DataFrame) -> DataFrame:
    # a single species gives -0.0 or 0.0, or a trace of rounding: adding zero settles it
    # simpson is a ratio of whole numbers and must agree to the last bit
    return df.withColumns({"shannon": F.round("shannon", 6) + 0.0, "es": F.round("es", 5)})


@query("A4_occurrence_store",
       f"WITH occ AS ({OCCURRENCES}) SELECT res, cell_id, hex_prune, aphiaid, phylum, class, \"order\", "
       f"date_year, count(*) AS records FROM ({_tiers_sql([3, 5, 7])}) GROUP BY ALL")
def store(spark: SparkSession, sf: str) -> DataFrame:
    return D.occurrence_store(S.occurrences(spark, sf), S.LATTICE, FINEST)


@query("A5_cell_index",
       _indices_sql(f"SELECT res, cell_id, aphiaid, 1 AS w FROM ({_tiers_sql(list(range(1, 8)))})",
                    "res, cell_id"))
def all_taxa(spark: SparkSession, sf: str) -> DataFrame:
    occ = S.occurrences(spark, sf, taxonomy=False)
    return rounded(D.cell_index(occ, S.LATTICE, FINEST).drop("hex_prune"))


@query("A6_taxon_index", _indices_sql(
    " UNION ALL ".join(
        f"SELECT '{rank}' AS rank, \"{rank}\" AS taxon, res, cell_id, aphiaid, 1 AS w "
        f"FROM ({_tiers_sql(list(range(1, 8)))})" for rank in ("phylum", "class", "order")),
    "rank, taxon, res, cell_id"))
def per_taxon(spark: SparkSession, sf: str) -> DataFrame:
    # taxonomy is joined from part, one row per species
    return rounded(D.taxon_index(S.occurrences(spark, sf), S.LATTICE, FINEST, one_lineage=True))


# the taxa below one part type, and the ids in its tree
_ECONOMY = "p_type='ECONOMY'"


def economy_tree(spark: SparkSession, sf: str) -> DataFrame:
    roots = spark.range(1).select(S.type_node(F.lit("ECONOMY")).alias("taxonID"))
    return D.descendants(S.taxon_tree(spark, sf), roots)


_TYPE = "(-1000*(ascii(p_type)*100+length(p_type)))::BIGINT"
_BRAND = f"({_TYPE}-CAST(substr(p_brand,7) AS BIGINT))"


@query("J4_taxon_descendants", f"""
    WITH RECURSIVE taxon AS (
      SELECT p_partkey AS taxonID, {_BRAND} AS parentNameUsageID FROM part
      UNION ALL SELECT DISTINCT {_BRAND}, {_TYPE} FROM part
      UNION ALL SELECT DISTINCT {_TYPE}, -1::BIGINT FROM part
      UNION ALL SELECT -1::BIGINT, NULL),
    tree AS (SELECT taxonID, parentNameUsageID FROM taxon WHERE taxonID=-1
      UNION ALL SELECT t.taxonID, t.parentNameUsageID FROM taxon t JOIN tree p
        ON t.parentNameUsageID=p.taxonID)
    SELECT taxonID, parentNameUsageID FROM tree""")
def whole_tree(spark: SparkSession, sf: str) -> DataFrame:
    roots = spark.range(1).select(F.lit(S.ROOT_NODE).cast("bigint").alias("taxonID"))
    return D.descendants(S.taxon_tree(spark, sf), roots)


@query("J3_taxon_semi_join",
       f"WITH occ AS ({OCCURRENCES}) SELECT {cell_sql('k', 5)} AS cell_id, count(*) AS records "
       "FROM occ WHERE class='ECONOMY' GROUP BY 1")
def economy_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.of_taxa(S.occurrences(spark, sf, res=5, taxonomy=False), economy_tree(spark, sf))
    return rows.groupBy("cell_id").agg(F.count(F.lit(1)).alias("records"))


@query("A7_live_index", _indices_sql(
    f"SELECT {cell_sql('k', 5)} AS cell_id, aphiaid, 1 AS w FROM occ "
    "WHERE class='ECONOMY' AND date_year BETWEEN 1996 AND 1999", "cell_id"))
def live(spark: SparkSession, sf: str) -> DataFrame:
    kept = D.occurrence_store(S.occurrences(spark, sf), S.LATTICE, FINEST)
    return rounded(D.live_index(kept, 5, taxa=economy_tree(spark, sf), years=(1996, 1999)))


@query("A7_live_index_between_tiers", _indices_sql(
    f"SELECT {cell_sql('k', 4)} AS cell_id, aphiaid, 1 AS w FROM occ WHERE class='SMALL'", "cell_id"))
def live_between(spark: SparkSession, sf: str) -> DataFrame:
    kept = D.occurrence_store(S.occurrences(spark, sf), S.LATTICE, FINEST)
    return rounded(D.live_index(kept, 4, where=F.col("class") == "SMALL", system=S.LATTICE))
