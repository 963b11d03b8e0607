"""Layer contract, requests, keys, summaries and ranking."""

import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexatlas.functions import keys
from hexatlas.functions.values import clamp_res, finite, json_safe
from hexatlas.operators import layers as L
from hexatlas.operators.ranking import dense_ids, exact_percentiles

NAN, INF = float("nan"), float("inf")


def test_contract(spark):
    df = spark.range(1).selectExpr("id CELL_ID", "1 Value", "2 n")
    assert L.check_contract(df) is True
    assert L.check_contract(df.drop("n")) is False
    for bad in (df.drop("CELL_ID"), df.drop("Value"), df.withColumn("extra", F.lit(1)),
                df.selectExpr("*", "1 + 1"), df.selectExpr("*", "n AS N")):
        with pytest.raises(L.LayerContractError):
            L.check_contract(bad)


def test_types_and_finite_values(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "7"), (2, None, "1"), (3, NAN, "1"), (4, INF, "1"), (5, -INF, "1"), (-6, 2.0, "x"), (0, 3.0, None)],
        "cell_id int, value double, n string")
    assert [tuple(r) for r in L.hex_layer(df).orderBy("cell_id").collect()] == [
        (-6, 2.0, None), (0, 3.0, None), (1, 1.5, 7)]
    assert [tuple(r) for r in L.grid_layer(df).collect()] == [(1, 1.5)]
    assert dict(L.typed(df.drop("n")).dtypes) == {"cell_id": "bigint", "value": "double", "n": "bigint"}
    assert df.where(~finite(F.col("value"))).count() == 4


def test_json_safe_and_clamp(spark):
    df = spark.createDataFrame([(NAN,), (INF,), (-INF,), (1.5,), (None,)], "v double")
    assert [r[0] for r in df.select(json_safe(F.col("v"))).collect()] == ["NaN", "Infinity", "-Infinity", "1.5", None]
    assert [r[0] for r in spark.range(5, 10).select(clamp_res(F.col("id").cast("int"))).collect()] == [5, 6, 7, 7, 7]


def test_query_text():
    assert L.sql_text("SELECT hex_h3res{{res}}, a FROM t WHERE b = hex_h3res{{ res }} {{bbox}}", 7) == \
        "SELECT hex_h3res7, a FROM t WHERE b = hex_h3res7 "
    with pytest.raises(ValueError):
        L.sql_text("", 5)
    assert len(L.sql_text("x" * (16 * 1024 + 1), 5)) == 16 * 1024 + 1


def test_sql_layers(spark):
    obs = spark.createDataFrame([(1, 10, 2.0, 42), (1, 10, 4.0, 42), (2, 20, 9.0, 7)],
                                "hex_h3res5 bigint, hex_h3res4 bigint, depth double, gear int")
    text = "SELECT hex_h3res{{res}} AS cell_id, avg(depth) AS value, count(1) AS n FROM hauls WHERE gear = 42 GROUP BY 1"
    layer = L.sql_layer(spark, text, hauls=obs)
    assert [tuple(r) for r in L.hex_layer(layer(5)).collect()] == [(1, 3.0, 2)]
    assert [tuple(r) for r in L.hex_layer(layer(4)).collect()] == [(10, 3.0, 2)]
    literal = L.sql_layer(spark, "SELECT * FROM VALUES (11::BIGINT, 0.25, 3), (12::BIGINT, 0.75, 1) AS v(cell_id, value, n)")
    assert L.hex_layer(literal(5)).count() == 2
    with pytest.raises(L.LayerContractError):
        L.hex_layer(L.sql_layer(spark, "SELECT 1 AS cell_id, 2 AS v")(5))


FORMS = {
    "cte": "WITH h AS (SELECT cell, depth FROM hauls) SELECT cell AS cell_id, max(depth) AS value FROM h GROUP BY cell",
    "recursive": "WITH RECURSIVE up(cell) AS (SELECT 3 UNION ALL SELECT cell + 1 FROM up WHERE cell < 5) SELECT cell AS cell_id, 1.0 AS value FROM up",
    "union": "SELECT cell AS cell_id, depth AS value FROM hauls UNION ALL SELECT 9, 1.5",
    "values": "SELECT h.cell AS cell_id, v.w AS value FROM hauls h JOIN (VALUES (4, 0.5)) AS v(cell, w) ON h.cell = v.cell",
    "in": "SELECT cell AS cell_id, depth AS value FROM hauls WHERE cell IN (SELECT cell FROM hauls WHERE depth > 2)",
}
WANT = {"cte": [(4, 2.0), (5, 3.0)], "recursive": [(3, 1.0), (4, 1.0), (5, 1.0)], "union": [(4, 2.0), (5, 3.0), (9, 1.5)],
        "values": [(4, 0.5)], "in": [(5, 3.0)]}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_forms_of_sql_layers(spark, form):
    hauls = spark.createDataFrame([(4, 2.0), (5, 3.0)], "cell int, depth double")
    rows = L.hex_layer(L.sql_layer(spark, FORMS[form], hauls=hauls)(5)).collect()
    assert sorted((r["cell_id"], r["value"]) for r in rows) == WANT[form]


def test_a_recursion_of_more_than_a_million_rows(spark):
    below = spark.range(1_050_000).selectExpr("id + 1 as id", "0L as parent")
    text = ("WITH RECURSIVE t(id, depth) AS (SELECT 0L, 0 UNION ALL SELECT b.id, t.depth + 1 FROM below b JOIN t ON b.parent = t.id) "
            "SELECT id AS cell_id, depth AS value FROM t")
    assert L.typed(L.sql_layer(spark, text, below=below)(5)).agg(F.count("cell_id"), F.sum("value")).head() == (1_050_001, 1_050_000.0)
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT_EXCEEDED"):
        L.sql_layer(spark, "WITH RECURSIVE t(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM t) SELECT i AS cell_id, 1 AS value FROM t")(5).count()


def test_commands_are_refused_before_they_run(spark):
    with pytest.raises(Exception, match="PARSE"):
        L.sql_layer(spark, "CREATE TEMPORARY VIEW made_by_a_layer AS SELECT 1 AS cell_id")(5)
    assert not spark.catalog.tableExists("made_by_a_layer")


def test_cell_aggregates(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (1, 4.0, "a"), (2, 5.0, "b")], "c int, v double, k string")
    for how, want in (("avg", 3.0), ("sum", 6.0), ("count", 2)):
        got = L.cell_aggregate(df, F.col("c"), F.col("v"), how, F.col("k") == "a").collect()
        assert [tuple(r) for r in got] == [(1, want, 2)]


@pytest.mark.parametrize("text,ok", [("SELECT 1 -- ünîcødé", True), ("a", True), ("ab", True), ("abc", True)])
def test_decoding_round_trip(spark, text, ok):
    q = base64.b64encode(text.encode()).decode()
    u = base64.urlsafe_b64encode(text.encode()).decode()
    df = spark.createDataFrame([(q, u, u.rstrip("="))], "q string, u string, bare string")
    row = df.select(keys.decode_strict(F.col("q")), keys.decode_urlsafe(F.col("u")), keys.decode_urlsafe(F.col("bare"))).head()
    assert tuple(row) == (text, text, text)


def test_bad_requests_are_null(spark):
    bad = [None, "", "!!!", "not-base64", "YWJj\n", "YW Jj", "YWJ", "YQ", "=", "====", "YQ=", base64.b64encode(b"\xff\xfe").decode()]
    df = spark.createDataFrame([(b,) for b in bad], "q string")
    assert df.where(keys.decode_strict(F.col("q")).isNotNull()).count() == 0


def test_a_long_request_is_decoded_whole(spark):
    text = "SELECT '" + "x" * 300_000 + "'"
    df = spark.createDataFrame([(base64.b64encode(text.encode()).decode(),)], "q string")
    row = df.select(keys.decode_strict(F.col("q")).alias("t")).select("t", keys.too_large(F.col("t")).alias("b")).head()
    assert row["t"] == text and row["b"] is True


def test_keys(spark):
    df = spark.createDataFrame([("main", "text", 4, 9, 6, 3, None, "17.25")],
                               "db string, q string, z int, x int, y int, r int, rel string, m string")
    c = F.col
    tile = df.select(keys.tile_key(c("db"), c("q"), c("z"), c("x"), c("y"), c("r"), c("rel"), c("m"))).head()[0]
    stats = df.select(keys.summary_key(c("db"), c("q"), c("rel"), c("m"))).head()[0]
    other = df.select(keys.summary_key(c("db"), c("q"), c("rel"), c("m"), c("r"))).head()[0]
    assert tile == hashlib.sha256(b"main|text|4|9|6|3||17.25").hexdigest()
    assert stats == hashlib.sha256(b"stats|main|text||17.25").hexdigest() and other != stats


def test_canonical_urls(spark):
    df = spark.createDataFrame([("/a?b=2&a=1",), ("/a?a=1&b=2",), ("/a",), ("/a?",)], "u string")
    assert [r[0] for r in df.select(keys.canonical_url(F.col("u"))).collect()] == ["/a?a=1&b=2", "/a?a=1&b=2", "/a", "/a?"]


def test_percentiles_are_linear(spark):
    row = exact_percentiles(spark.range(1, 101).selectExpr("cast(id as double) v"), "v",
                            {"a": 0.02, "b": 0.5, "c": 0.98, "d": 0.0, "e": 1.0}).head()
    assert tuple(row) == pytest.approx((2.98, 50.5, 98.02, 1.0, 100.0))


@pytest.mark.parametrize("rows", [3, 500, 10_000])
def test_percentiles_of_skewed_values(spark, rows):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(3000, 7.25), rng.normal(0, 100, 4000), [7.25, 7.25, -1e9, 1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = {f"p{i}": p for i, p in enumerate((0.0, 0.01, 0.25, 0.4999, 0.5, 0.77, 0.98, 1.0))}
    got = exact_percentiles(df, "v", probs, rows).head()
    assert tuple(got) == pytest.approx(tuple(np.percentile(values, [100 * p for p in probs.values()])))


def test_percentiles_of_little_or_nothing(spark):
    one = spark.createDataFrame([(4.0,)], "v double")
    assert tuple(exact_percentiles(one, "v", {"a": 0.02, "b": 0.98}).head()) == (4.0, 4.0)
    assert tuple(exact_percentiles(one.where("v > 9"), "v", {"a": 0.5}).head()) == (None,)


def test_summaries(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)] + [(0, NAN), (101, INF), (102, None)],
                               "cell_id int, value double")
    assert tuple(L.hex_summary(df, exact=True).head()) == pytest.approx((1.0, 100.0, 2.98, 98.02, 100))
    assert tuple(L.hex_summary(df).head()) == (1.0, 100.0, 2.0, 98.0, 100)
    grid = L.grid_summary(L.grid_layer(df)).head()
    assert tuple(grid) == pytest.approx((100, 1.0, 100.0, 50.5, float(np.std(range(1, 101))), 2.98, 50.5, 98.02))
    empty = L.json_safe_row(L.hex_summary(df.where("cell_id > 100"), exact=True)).head()
    assert tuple(empty) == (None, None, None, None, 0)


@pytest.mark.parametrize("rows", [9, 400, 10_000])
def test_dense_ids(spark, rows):
    names = [f"model|{(i * 7919) % 1000:04d}" for i in range(700)] * 3 + [None]
    df = spark.createDataFrame([(n,) for n in names], "k string")
    got = {r["k"]: r["i"] for r in dense_ids(df, "k", "i", rows=rows).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted({n for n in names if n}))}


def test_rank_plans_have_no_single_partition_window(spark):
    for df in (dense_ids(spark.range(1000).selectExpr("id k"), "k", "i", rows=100),
               exact_percentiles(spark.range(1000).selectExpr("id * 1D v"), "v", {"a": 0.5}, rows=100)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        after = [line for line in plan.splitlines() if "Window [" in line]
        assert after and all("_bucket" in line for line in after)


def test_buckets_stay_even_with_a_million_values_and_a_hot_key(spark):
    from hexatlas.operators import compare
    from hexatlas.operators.ranking import ranged

    df = spark.range(1_000_000).selectExpr("id * 7919 % 1000003 v")
    sizes = [r["count"] for r in ranged(df, ["v"], rows=50_000).groupBy("_bucket").count().collect()]
    assert sum(sizes) == 1_000_000 and 18 <= len(sizes) <= 20 and max(sizes) < 100_000
    # half of all records have one key: the ranges go on inside it
    keyed = df.selectExpr("named_struct('k', if(v % 2 = 0, 0, v)) _k", "true _is_left", "named_struct('v', v) _rec")
    sizes = [r["count"] for r in ranged(keyed, ["_k", "_is_left", "_rec"], rows=50_000).groupBy("_bucket").count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 100_000
    got = exact_percentiles(df, "v", {"a": 0.25, "b": 0.5, "c": 1.0}, rows=1000).head()
    values = np.sort(np.arange(1_000_000) * 7919 % 1000003)
    assert tuple(got) == pytest.approx(tuple(np.percentile(values, [25, 50, 100])))
    few = spark.createDataFrame([(1, True, r, c) for r, c in (("b", 2), ("a", 1), ("c", 3))], "_k int, _is_left boolean, _rec string, _c long")
    for rows in (1, 100):
        assert sorted((r["_i"], r["_rec"]) for r in compare._positions(few, rows).collect()) == list(enumerate("abbccc"))


def test_nothing_is_lost_to_rounding_in_exact_means(spark):
    df = spark.createDataFrame([(10,), (20,), (33,)], "c bigint")
    assert math.isclose(df.agg(L.exact_mean(F.col("c"))).head()[0], 0.21)
