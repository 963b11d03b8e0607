"""Indices against direct formulas, roll-up, recursion and semi join."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hexatlas.functions.systems import Lattice
from hexatlas.operators import diversity as D

LAT = Lattice()


def direct(counts):
    n = sum(counts)
    p = [c / n for c in counts]
    es = sum(1 - math.comb(n - c, 50) / math.comb(n, 50) for c in counts) if n >= 50 else None
    return n, len(counts), -sum(x * math.log(x) for x in p), sum(x * x for x in p), es


@pytest.mark.parametrize("counts", [
    [1], [49], [50], [60], [1] * 49, [1] * 50, [1] * 200, [100, 1], [30, 25, 3], [5] * 12 + [40, 1, 1],
    [1000, 10, 10, 10, 1], [2, 3, 5, 7, 11, 13, 17, 19]])
def test_indices_equal_the_formulas(spark, counts):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate(counts)], "g string, aphiaid int, records bigint")
    got = D.indices(df, ["g"]).select("n", "sp", "shannon", "simpson", "es").head()
    want = direct(counts)
    assert tuple(got)[:4] == pytest.approx(want[:4], rel=1e-9, abs=1e-12)
    assert (got["es"] is None) == (want[4] is None)
    if want[4] is not None:
        assert got["es"] == pytest.approx(want[4], rel=1e-9)


def test_sampling_stays_exact_for_very_large_cells(spark):
    # ten equally common species of a hundred million records each: none is missed
    df = spark.createDataFrame([("g", i, 100_000_000) for i in range(10)], "g string, aphiaid int, records bigint")
    es = D.indices(df, ["g"]).head()["es"]
    # with replacement the chance to miss one species is 0.9^50
    assert es == pytest.approx(10 * (1 - 0.9 ** 50), abs=1e-5)


def occurrences(spark):
    rows = []
    for i in range(4000):
        k = (i * i) % 37
        sp = 1 if i % 3 == 0 else i % 23 + 2      # a third of all records is one species
        rows.append((LAT_AT(k), sp, "Chordata", f"class{sp % 3}", f"order{sp % 5}" if sp % 7 else None, 2000 + i % 5))
    return spark.createDataFrame(rows, "cell_id bigint, aphiaid int, phylum string, class string, order string, date_year int")


def LAT_AT(k):
    n = LAT.side(7)
    return (7 << 52) | ((k * 53 % n) << 26) | (k * 101 % n)


def parent(cell, res):
    gap = 7 - res
    x, y = (cell >> 26) & ((1 << 26) - 1), cell & ((1 << 26) - 1)
    return (res << 52) | ((x >> gap) << 26) | (y >> gap)


def test_cell_index(spark):
    rows = occurrences(spark).collect()
    want = defaultdict(Counter)
    for r in rows:
        for res in range(1, 8):
            want[res, parent(r["cell_id"], res)][r["aphiaid"]] += 1
    got = D.cell_index(occurrences(spark), LAT).collect()
    assert {(r["res"], r["cell_id"]) for r in got} == set(want)
    for r in got:
        w = direct(list(want[r["res"], r["cell_id"]].values()))
        assert (r["n"], r["sp"]) == w[:2]
        assert (r["shannon"], r["simpson"]) == pytest.approx(w[2:4], abs=1e-9)
        assert r["es"] == (None if w[4] is None else pytest.approx(w[4], abs=1e-9))
        assert r["hex_prune"] == (parent(r["cell_id"] | 0, 3) if r["res"] == 7 else r["hex_prune"])
        assert (r["hex_prune"] is None) == (r["res"] < 3)


@pytest.mark.parametrize("one_lineage", [True, False])
def test_taxon_index(spark, one_lineage):
    rows = occurrences(spark).collect()
    want = defaultdict(Counter)
    for r in rows:
        for rank in ("phylum", "class", "order"):
            if r[rank] is not None:
                for res in (2, 7):
                    want[rank, r[rank], res, parent(r["cell_id"], res)][r["aphiaid"]] += 1
    got = D.taxon_index(occurrences(spark), LAT, resolutions=[2, 7], one_lineage=one_lineage).collect()
    assert {(r["rank"], r["taxon"], r["res"], r["cell_id"]): (r["n"], r["sp"]) for r in got} == \
        {k: (sum(c.values()), len(c)) for k, c in want.items()}


def test_species_with_two_lineages_count_once_per_taxon(spark):
    df = spark.createDataFrame([(LAT_AT(1), 5, "P", "A", "x"), (LAT_AT(1), 5, "P", "A", "y")],
                               "cell_id bigint, aphiaid int, phylum string, class string, order string")
    got = {(r["rank"], r["taxon"]): (r["n"], r["sp"]) for r in D.taxon_index(df, LAT, resolutions=[7]).collect()}
    assert got[("class", "A")] == (2, 1) and got[("order", "x")] == (1, 1)


def test_store_and_live_index(spark):
    store = D.occurrence_store(occurrences(spark), LAT)
    assert {r["res"] for r in store.select("res").distinct().collect()} == {3, 5, 7}
    assert store.groupBy("res").agg(F.sum("records").alias("s")).where("s <> 4000").count() == 0
    assert store.where("hex_prune IS NULL").count() == 0
    taxa = spark.createDataFrame([(1,), (2,), (2,)], "taxonID int")
    got = {r["cell_id"]: r["n"] for r in D.live_index(store, 5, taxa, years=(2001, 2002)).collect()}
    want = Counter(parent(r["cell_id"], 5) for r in occurrences(spark).collect()
                   if r["aphiaid"] in (1, 2) and r["date_year"] in (2001, 2002))
    assert got == dict(want)


def test_descendants(spark):
    taxon = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (9, None), (10, 9)],
                                  "taxonID int, parentNameUsageID int")
    roots = spark.createDataFrame([(2,), (9,)], "taxonID int")
    assert sorted(r["taxonID"] for r in D.descendants(taxon, roots).collect()) == [2, 4, 5, 9, 10]
    deep = spark.range(1, 61).selectExpr("id taxonID", "nullif(id - 1, 0) parentNameUsageID")
    assert D.descendants(deep, spark.range(1, 2).selectExpr("id taxonID")).count() == 60


def test_a_roll_up_shuffles_once_for_all_resolutions(spark):
    system = Lattice()
    rows = spark.range(400).selectExpr("id % 90 as k", "id % 3 as aphiaid", "1L as records").select(
        system.cell_at(F.col("k") * 3700 - 170000, F.col("k") * 1700 - 80000, 7).alias("cell_id"), "aphiaid", "records")
    counts = rows.groupBy("cell_id", "aphiaid").agg(F.sum("records").alias("records"))
    found = D.roll_up(counts, system, 7, [1, 4, 7], ["aphiaid"], "records")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # by cell only where the rows are first counted, once in each of the three resolutions' plans
    assert plan.count("hashpartitioning(cell_id") == 3 and plan.count("hashpartitioning(_top") == 3
    want = rows.groupBy(system.parent(F.col("cell_id"), 7, 4).alias("cell_id"), "aphiaid").agg(F.sum("records").alias("records"))
    got = found.where("res = 4").select("cell_id", "aphiaid", "records")
    assert sorted(got.collect()) == sorted(want.collect())
