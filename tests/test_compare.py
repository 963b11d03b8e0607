"""Differences between result sets and lists."""

from pyspark.sql import functions as F

from hexatlas.operators import compare
from hexatlas.operators.compare import list_diff, result_diff, type_mismatches

SCHEMA = "k string, value double, n bigint"


def diffs(a, b, keys=("k",), **more):
    return sorted((tuple(r) for r in result_diff(a, b, list(keys), **more).collect()), key=str)


def test_parity_within_tolerance(spark):
    a = spark.createDataFrame([("a", 1.0, 1), ("b", float("nan"), None)], SCHEMA)
    b = spark.createDataFrame([("a", 1.0 + 5e-10, 1), ("b", float("nan"), None)], SCHEMA)
    assert diffs(a, b) == []
    assert diffs(a, a.selectExpr("k", "value", "cast(n as int) n")) == []      # two numeric types


def test_every_kind_of_difference(spark):
    a = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2), ("c", 3.0, None), ("d", 4.0, 4)], SCHEMA)
    b = spark.createDataFrame([("a", 1.1, 1), ("c", 3.0, 7), ("d", 4.0, 4), ("d", 4.0, 4), ("e", 5.0, 5)], SCHEMA)
    got = diffs(a, b)
    unrepeated = b.where("k <> 'd'").unionByName(b.where("k = 'd'").selectExpr("'f' k", "value", "n").limit(1))
    assert diffs(a, unrepeated) == diffs(a, unrepeated, unique_keys=True) != []
    assert [(g[0], g[1], g[2]) for g in got] == [
        ("a", "value", "value"), ("b", "", "missing_right"), ("c", "n", "value"), ("d", "", "missing_left"), ("e", "", "missing_left")]


def test_unequal_repeats_and_null_keys(spark):
    a = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 1), (None, 5.0, 1)], SCHEMA)
    b = spark.createDataFrame([("x", 9.0, 1), (None, 6.0, 1)], SCHEMA)
    got = diffs(a, b)
    assert [(g[0], g[1], g[2]) for g in got] == [("x", "", "count"), (None, "value", "value")]


def test_repeats_are_paired_in_order(spark):
    a = spark.createDataFrame([("x", 1.0, 1)] * 3 + [("x", 2.0, 1)], SCHEMA)
    b = spark.createDataFrame([("x", 1.0 + i * 1e-10, 1) for i in range(3)] + [("x", 2.5, 1)], SCHEMA)
    assert [(g[1], g[3], g[4]) for g in diffs(a, b)] == [("value", "2.0", "2.5")]


def test_shape_differences(spark):
    a = spark.createDataFrame([("a", 1.0, "x")], "k string, value double, t string")
    b = spark.createDataFrame([("a", 1.0, 5, 6)], "k string, value double, t int, extra int")
    assert type_mismatches(a, b, ["k"]) == ["t"]
    assert [(g[1], g[2]) for g in diffs(a, b)] == [("extra", "missing_left"), ("t", "type")]


def test_a_third_of_all_rows_under_one_key(spark):
    hot = spark.range(60_000).selectExpr("'hot' k", "1D value", "id n")
    rest = spark.range(100_000).selectExpr("cast(id as string) k", "1D value", "id n")
    a = hot.unionByName(rest)
    b = a.where("k <> '77'").unionByName(spark.createDataFrame([("hot", 1.0, -1)], SCHEMA))
    assert [(g[0], g[2]) for g in diffs(a, b)] == [("77", "missing_right"), ("hot", "missing_left")]


def test_lists(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "line string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "line string")
    got = {tuple(r) for r in list_diff(a, b).collect()}
    assert got == {("x", "left", 1), ("y", "left", 1), ("z", "right", 1)}


def test_a_hot_key_that_differs_everywhere_is_paired_in_order(spark):
    # twenty thousand copies and as many distinct values under one key, all shifted on the right
    a = spark.range(20_000).selectExpr("'hot' k", "id * 1D value", "1L n").unionByName(
        spark.range(20_000).selectExpr("'hot' k", "7.5D value", "1L n"))
    b = a.withColumn("value", F.col("value") + 0.25)
    found = result_diff(a, b, ["k"])
    assert found.count() == 40_000
    gap = F.col("b").cast("double") - F.col("a").cast("double")
    assert found.where((gap < 0.24) | (gap > 0.26)).count() == 0
    assert result_diff(a, a.withColumn("value", F.col("value") + 1e-10), ["k"]).count() == 0


def test_pairing_deals_its_rows_over_tasks_by_their_number(spark, monkeypatch):
    # left to the size in bytes, all of these well compressed rows are one task
    monkeypatch.setattr(compare, "TASK_ROWS", 5_000)
    monkeypatch.setattr(compare, "HOT_COPIES", 50)
    rows = spark.range(20_000).selectExpr("id k", "id * 1D value")
    hot = spark.range(100).selectExpr("-1L k", "id * 1D value")
    a = rows.unionByName(rows).unionByName(hot)
    b = a.withColumn("value", F.col("value") + F.when(F.col("k") % 1_000 == -1, 0.5).when(F.col("k") == 7, 0.25).otherwise(1e-10))
    found = result_diff(a, b, ["k"])
    assert {(r["k"], r["n"]) for r in found.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()} == {(-1, 100), (7, 2)}
    even = result_diff(rows.unionByName(rows), rows.unionByName(rows).withColumn("value", F.col("value") + 0.5), ["k"])
    assert even.count() == 40_000 and even.rdd.getNumPartitions() >= 16
