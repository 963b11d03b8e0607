"""Layer contract, filters, requests, keys and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.functions import cells, keys
from hexatlas.functions.values import clamp_res, json_safe
from hexatlas.operators import layers as L
from hexatlas.operators.raster import value_map
from hexatlas.operators.requests import decoded_requests, request_counts
from hexatlas.plans import standins as S
from hexatlas.suite.base import (
    MEAN_PRICE, cell_sql, grid_cell_sql, hexed, layer_sql, query)


@query("P1_P3_P10_sql_layer", layer_sql(5))
def sql_layer(spark: SparkSession, sf: str) -> DataFrame:
    orders = S.table(spark, sf, "orders")
    finest = S.cell_of_customer(F.col("o_custkey"), 10)
    wide = L.with_res_columns(
        orders.select("o_custkey", S.cents(F.col("o_totalprice")).alias("cents")),
        finest, lambda c, r: S.LATTICE.parent(c, 10, r))
    text = ("SELECT hex_h3res{{ res }} AS cell_id, "
            "CAST(SUM(cents) AS DOUBLE)/COUNT(*)/100 AS value, COUNT(*) AS n "
            "FROM order_obs GROUP BY 1 {{bbox}}")
    return L.typed(L.sql_layer(spark, text, order_obs=wide)(5))


# the forms of a layer's text: what is asked of Spark, and the same for the other engine
_FORMS = {
    "cte": ("WITH big AS (SELECT * FROM order_obs WHERE cents > 10000000) "
            "SELECT cell{{res}} AS cell_id, SUM(cents) / 1 AS value, COUNT(*) AS n FROM big GROUP BY 1"),
    "recursive": ("WITH RECURSIVE below(id, depth) AS (SELECT taxonID, 0 FROM taxon WHERE parentNameUsageID IS NULL "
                  "UNION ALL SELECT t.taxonID, b.depth + 1 FROM taxon t JOIN below b ON t.parentNameUsageID = b.id) "
                  "SELECT id AS cell_id, depth AS value, CAST(NULL AS BIGINT) AS n FROM below"),
    "union": ("SELECT cell{{ res }} AS cell_id, 1 AS value, COUNT(*) AS n FROM order_obs WHERE o_orderstatus = 'F' GROUP BY 1 "
              "UNION ALL SELECT cell{{ res }}, 2, COUNT(*) FROM order_obs WHERE o_orderstatus <> 'F' GROUP BY 1"),
    "values": "SELECT * FROM (VALUES (17, 0.5, 3), (18, -1.25, 4)) AS v(cell_id, value, n) {{bbox}}",
    "in": ("SELECT o_custkey AS cell_id, MAX(cents) AS value, COUNT(*) AS n FROM order_obs "
           "WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) GROUP BY 1"),
}
_VIEWS = f"""order_obs AS (SELECT o_custkey, o_orderstatus, {cell_sql('o_custkey', 4)} AS cell4,
      CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders),
    taxon AS (SELECT p_partkey+1 AS taxonID, -length(p_type) AS parentNameUsageID FROM part
      UNION ALL SELECT DISTINCT -length(p_type), 0 FROM part UNION ALL SELECT 0, NULL)"""


def _form_sql(name: str, text: str) -> str:
    plain = text.replace("{{res}}", "4").replace("{{ res }}", "4").replace("{{bbox}}", "")
    inner = f"SELECT '{name}' AS form, CAST(cell_id AS BIGINT) AS cell_id, CAST(value AS DOUBLE) AS value, CAST(n AS BIGINT) AS n FROM ({plain})"
    return f"SELECT * FROM (WITH {_VIEWS} {inner})"


@query("P10_sql_forms", " UNION ALL ".join(_form_sql(n, t) for n, t in _FORMS.items()))
def sql_forms(spark: SparkSession, sf: str) -> DataFrame:
    orders, part = S.table(spark, sf, "orders"), S.table(spark, sf, "part")
    k, kind = F.col("o_custkey"), (-F.length("p_type")).cast("bigint")
    views = {
        "order_obs": orders.select("o_custkey", "o_orderstatus", S.cell_of_customer(k, 4).alias("cell4"), S.cents(F.col("o_totalprice")).alias("cents")),
        "taxon": part.select((F.col("p_partkey") + 1).cast("bigint").alias("taxonID"), kind.alias("parentNameUsageID")).union(
            part.select(kind, F.lit(0).cast("bigint")).distinct()).union(spark.range(1).selectExpr("id", "cast(null as bigint)")),
        "customer": S.table(spark, sf, "customer"),
    }
    parts = [L.typed(L.sql_layer(spark, text, **views)(4)).select(F.lit(name).alias("form"), "cell_id", "value", "n")
             for name, text in _FORMS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("P2_clamped_resolution",
       f"SELECT cell_id, count(*) AS n FROM (SELECT {cell_sql('o_custkey', 7)} AS cell_id FROM orders) GROUP BY 1")
def clamped(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey")
    long_form = S.table(spark, sf, "orders").select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("res"), S.cell_of_customer(k, r).alias("cell_id"))
        for r in (5, 6, 7)])).alias("a")).select("a.*")
    return (long_form.where(F.col("res") == clamp_res(9))
            .groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")))


@query("P4_P5_typed_layer",
       "SELECT event_id AS cell_id, value, TRY_CAST(CASE WHEN event_type='error' THEN 'x' "
       "ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS n FROM events")
def typed_layer(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("event_type") == "error", "x").otherwise(F.col("user_id").cast("string"))
    return L.typed(S.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("CELL_ID"), F.col("value").alias("Value"),
        n.alias("n")))


# values that are missing in four ways, decided by the event's type
_ODD = ("CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'NaN'::DOUBLE "
        "WHEN 'view' THEN 'Infinity'::DOUBLE WHEN 'signup' THEN '-Infinity'::DOUBLE "
        "ELSE value END")


def odd_values(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    odd = (F.when(t == "error", F.lit(None).cast("double"))
           .when(t == "click", F.lit(float("nan"))).when(t == "view", F.lit(float("inf")))
           .when(t == "signup", F.lit(float("-inf"))).otherwise(F.col("value")))
    return S.table(spark, sf, "events").select(
        (F.col("event_id") - 100).alias("cell_id"), odd.alias("value"), "event_type")


@query("P6_finite_filter",
       f"SELECT event_id-100 AS cell_id, {_ODD} AS value FROM events WHERE isfinite({_ODD})")
def finite_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.hex_layer(odd_values(spark, sf).select("cell_id", "value")).select("cell_id", "value")


@query("P7_grid_filter",
       f"SELECT event_id-100 AS cell_id, {_ODD} AS value FROM events "
       f"WHERE isfinite({_ODD}) AND event_id-100>0")
def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.grid_layer(odd_values(spark, sf).select("cell_id", "value"))


@query("P8_cell_hex",
       f"SELECT c_custkey, {hexed(cell_sql('c_custkey', 7))} AS h3id FROM customer")
def hex_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return S.table(spark, sf, "customer").select(
        k, cells.cell_hex(S.cell_of_customer(k, 7)).alias("h3id"))


@query("P9_request_decoding", """
    WITH r AS (SELECT doc_id, replace(text, chr(0), '') || ' {{res}} {{ res }}{{bbox}}' AS t,
                      source FROM documents)
    SELECT doc_id, source <> 'src0' AS ok,
      CASE WHEN source<>'src0' THEN sha256(regexp_replace(regexp_replace(t,
        '\\{\\{\\s*bbox\\s*\\}\\}','','g'), '\\{\\{\\s*res\\s*\\}\\}', '5', 'g')) END AS text_sha,
      CASE WHEN source<>'src0' THEN strlen(regexp_replace(regexp_replace(t,
        '\\{\\{\\s*bbox\\s*\\}\\}','','g'), '\\{\\{\\s*res\\s*\\}\\}', '5', 'g'))>16384 END AS too_large
    FROM r""")
def request_decoding(spark: SparkSession, sf: str) -> DataFrame:
    # documents as request texts; those of one source arrive damaged
    text = F.concat(F.regexp_replace("text", "\\x00", ""), F.lit(" {{res}} {{ res }}{{bbox}}"))
    # the encoder breaks long output into lines, which the strict form refuses
    sent = F.regexp_replace(F.base64(text.cast("binary")), r"\s", "")
    sent = F.when(F.col("source") == "src0", F.concat(sent, F.lit("!"))).otherwise(sent)
    requests = S.table(spark, sf, "documents").select("doc_id", sent.alias("q"))
    out = decoded_requests(requests, res=F.lit(5))
    return out.select("doc_id", F.col("text").isNotNull().alias("ok"),
                      F.sha2("text", 256).alias("text_sha"), "too_large")


@query("P9_urlsafe_decoding", """
    SELECT page_id, page_id%4<>0 AS ok, CASE WHEN page_id%4<>0 THEN sha256(html) END AS text_sha FROM pages""")
def urlsafe_decoding(spark: SparkSession, sf: str) -> DataFrame:
    # unpadded url-safe form of whole pages; every fourth has a character outside its alphabet
    plain = F.regexp_replace(F.base64(F.col("html").cast("binary")), r"\s", "")
    sent = F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))
    sent = F.when(F.col("page_id") % 4 == 0, F.concat(sent, F.lit("*"))).otherwise(sent)
    out = decoded_requests(S.table(spark, sf, "pages").select("page_id", sent.alias("q")), urlsafe=True)
    return out.select("page_id", F.col("text").isNotNull().alias("ok"), F.sha2("text", 256).alias("text_sha"))


@query("P11_json_safe",
       f"SELECT event_id-100 AS cell_id, CASE WHEN event_type='error' THEN NULL WHEN isnan({_ODD}) THEN 'NaN' WHEN isinf({_ODD}) "
       f"THEN CASE WHEN {_ODD}>0 THEN 'Infinity' ELSE '-Infinity' END "
       f"ELSE CAST(value AS VARCHAR) END AS text FROM events")
def json_text(spark: SparkSession, sf: str) -> DataFrame:
    return odd_values(spark, sf).select("cell_id", json_safe(F.col("value")).alias("text"))


_SUMMARY = ("SELECT min(value) AS min, max(value) AS max, "
            "round(quantile_cont(value,0.02),6) AS p02, round(quantile_cont(value,0.98),6) AS p98, "
            "count(*) AS n FROM ({layer})")


@query("A1_hex_summary_exact", _SUMMARY.format(layer=layer_sql(7)))
def summary_exact(spark: SparkSession, sf: str) -> DataFrame:
    s = L.hex_summary(S.order_layer(spark, sf, 7), exact=True)
    return s.withColumns({"p02": F.round("p02", 6), "p98": F.round("p98", 6)})


@query("A1_hex_summary_sketch", f"""
    WITH l AS ({layer_sql(7)}), s AS (SELECT min(value) AS min, max(value) AS max,
      quantile_cont(value,0.01) AS a, quantile_cont(value,0.03) AS b,
      quantile_cont(value,0.97) AS c, quantile_cont(value,0.99) AS d, count(*) AS n FROM l)
    SELECT min, max, true AS p02_near, true AS p98_near, n FROM s""")
def summary_sketch(spark: SparkSession, sf: str) -> DataFrame:
    # sketches differ between engines: checked to lie within one percentile of the rank
    layer = S.order_layer(spark, sf, 7)
    s = L.hex_summary(layer)
    bounds = L.exact_percentiles(L.hex_layer(layer), "value",
                                 {"a": 0.01, "b": 0.03, "c": 0.97, "d": 0.99})
    s = s.withColumn("_b", bounds.select(F.struct("a", "b", "c", "d").alias("s")).scalar())
    return s.select("min", "max",
                    F.col("p02").between(F.col("_b.a"), F.col("_b.b")).alias("p02_near"),
                    F.col("p98").between(F.col("_b.c"), F.col("_b.d")).alias("p98_near"), "n")


# the order with the greatest key speaks for a grid cell
_MAP = (f"SELECT {grid_cell_sql('o_custkey')} AS cell_id, "
        "arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")


@query("J1_value_map", _MAP)
def last_values(spark: SparkSession, sf: str) -> DataFrame:
    return value_map(S.grid_values(spark, sf), order="seq", unique_order=True)


@query("A2_grid_summary",
       "SELECT count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value),6) AS mean, "
       "round(stddev_pop(value),4) AS std, round(quantile_cont(value,0.02),6) AS p2, "
       "round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.98),6) AS p98 "
       f"FROM ({_MAP})")
def map_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = L.grid_summary(value_map(S.grid_values(spark, sf), order="seq", unique_order=True))
    return s.select("n", "min", "max", F.round("mean", 6).alias("mean"),
                    F.round("std", 4).alias("std"),
                    *[F.round(c, 6).alias(c) for c in ("p2", "p50", "p98")])


@query("A3_cell_aggregate",
       f"SELECT {cell_sql('o_custkey', 6)} AS cell_id, {MEAN_PRICE} AS value, count(*) AS n "
       "FROM orders WHERE o_orderstatus='F' GROUP BY 1")
def filtered_mean(spark: SparkSession, sf: str) -> DataFrame:
    orders = S.table(spark, sf, "orders").withColumn("cents", S.cents(F.col("o_totalprice")))
    totals = L.cell_aggregate(orders, S.cell_of_customer(F.col("o_custkey"), 6), F.col("cents"),
                              how="sum", where=F.col("o_orderstatus") == "F")
    return totals.select("cell_id", (F.col("value").cast("double") / F.col("n") / 100).alias("value"), "n")


@query("K1_content_keys",
       "SELECT o_orderkey, sha256('main|'||o_orderpriority||'|4|'||CAST(o_orderkey%16 AS VARCHAR)||'|'"
       "||CAST(o_custkey%16 AS VARCHAR)||'|3||12.500000') AS tile_key, "
       "sha256('stats|main|'||o_orderpriority||'|v1|12.500000') AS stats_key FROM orders")
def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    o = S.table(spark, sf, "orders")
    db, q, mtime = F.lit("main"), F.col("o_orderpriority"), F.lit("12.500000")
    return o.select(
        "o_orderkey",
        keys.tile_key(db, q, F.lit(4), F.col("o_orderkey") % 16, F.col("o_custkey") % 16,
                      F.lit(3), F.lit(None).cast("string"), mtime).alias("tile_key"),
        keys.summary_key(db, q, F.lit("v1"), mtime).alias("stats_key"))


@query("K2_request_counts", """
    WITH u AS (SELECT CASE WHEN contains(url,'?')
      THEN split_part(url,'?',1)||'?'||array_to_string(list_sort(string_split(substr(url, strpos(url,'?')+1),'&')),'&')
      ELSE url END AS request FROM pages)
    SELECT request, count(*) AS hits FROM u GROUP BY 1""")
def canonical_requests(spark: SparkSession, sf: str) -> DataFrame:
    return request_counts(S.table(spark, sf, "pages"), "url")
