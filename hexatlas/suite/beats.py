"""Heartbeats: source, latest, status, silences in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.plans import standins as S
from hexatlas.session import scratch_path
from hexatlas.streaming import heartbeat as H
from hexatlas.suite.base import query

_BEATS = ("SELECT CAST(user_id AS VARCHAR) AS hostname, date_trunc('second', ts) AS t, "
          "strftime(ts,'%Y-%m-%dT%H:%M:%SZ') AS timestamp, event_type FROM events")


def beats(spark: SparkSession, sf: str) -> DataFrame:
    """Events as heartbeat records: host = user, service state = event type."""
    return S.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("user_id").cast("string").alias("hostname"),
        F.lit(None).cast("string").alias("uptime_since"), F.lit("1T").alias("disk_free"),
        F.lit("8G").alias("mem_free"),
        F.create_map(F.lit("web"), F.col("event_type")).alias("services"))


def last_instant(rows: DataFrame):
    return rows.agg(F.max(H.beat_time(F.col("timestamp"))).alias("m")).scalar()


def _files(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "heartbeats")
    beats(spark, sf).write.json(path)
    return path


@query("S13_heartbeat_files",
       f"SELECT hostname, timestamp, event_type AS web, count(*) AS n FROM ({_BEATS}) GROUP BY ALL")
def source(spark: SparkSession, sf: str) -> DataFrame:
    read = H.read_beats(spark, _files(spark, sf))
    return read.groupBy("hostname", "timestamp", F.col("services")["web"].alias("web")).agg(
        F.count(F.lit(1)).alias("n"))


_LATEST = (f"SELECT hostname, max(timestamp) AS timestamp, max((timestamp, event_type))[2] AS web "
           f"FROM ({_BEATS}) GROUP BY 1")


@query("HB1_latest_beats", _LATEST)
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return H.latest_beats(beats(spark, sf)).select(
        "hostname", "timestamp", F.col("services")["web"].alias("web"))


# customers are the expected hosts; every seventh record of a host set has no readable time
@query("HB2_host_status", f"""
    WITH b AS (SELECT hostname, CASE WHEN CAST(hostname AS BIGINT)%7=0 THEN NULL ELSE t END AS t,
        CASE WHEN CAST(hostname AS BIGINT)%7=0 THEN NULL ELSE event_type END AS event_type FROM ({_BEATS})),
    l AS (SELECT hostname, max(t) AS t, max(CASE WHEN t IS NOT NULL THEN (t, event_type) END)[2] AS web, count(*) AS c FROM b GROUP BY 1),
    n AS (SELECT max(t) AS as_of FROM b),
    s AS (SELECT CAST(c_custkey AS VARCHAR) AS hostname, c, web,
        CAST(floor(date_diff('second', t, as_of)/60.0) AS BIGINT) AS age_min
      FROM customer LEFT JOIN l ON l.hostname=CAST(c_custkey AS VARCHAR), n)
    SELECT hostname, CASE WHEN c IS NULL THEN 'MISSING' WHEN age_min IS NULL THEN 'PARSE ERROR'
      WHEN age_min>15 THEN 'DOWN' ELSE 'OK' END AS status, age_min,
      CASE WHEN age_min>15 THEN web END AS web FROM s""")
def status(spark: SparkSession, sf: str) -> DataFrame:
    damaged = beats(spark, sf).withColumn(
        "timestamp", F.when(F.col("hostname").cast("bigint") % 7 == 0, "soon").otherwise(F.col("timestamp")))
    hosts = S.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("hostname"))
    found = H.host_status(H.latest_beats(damaged), hosts, last_instant(damaged))
    return found.select("hostname", "status", "age_min", F.col("services")["web"].alias("web"))


_SILENT = f"""
    WITH b AS (SELECT hostname, t, lead(t) OVER (PARTITION BY hostname ORDER BY t) AS nxt FROM ({_BEATS})),
    n AS (SELECT max(t) AS as_of FROM b)"""
_TEXT = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)


@query("HB3_silences", _SILENT + f"""
    SELECT hostname, {_TEXT.format('t')} AS last_beat, {_TEXT.format("t + INTERVAL 960 SECOND")} AS alert_at,
      {_TEXT.format('nxt')} AS back_at FROM b, n WHERE coalesce(nxt, as_of) >= t + INTERVAL 960 SECOND""")
def quiet(spark: SparkSession, sf: str) -> DataFrame:
    rows = beats(spark, sf)
    found = H.silences(rows, last_instant(rows))
    return found.select("hostname", _text("last_beat"), _text("alert_at"), _text("back_at"))


@query("HB3_stream_alerts", _SILENT + f"""
    SELECT hostname, {_TEXT.format('t')} AS last_beat, {_TEXT.format("t + INTERVAL 960 SECOND")} AS alert_at
    FROM b, n WHERE coalesce(nxt, 'infinity'::TIMESTAMP) >= t + INTERVAL 960 SECOND
      AND t + INTERVAL 960 SECOND <= as_of - INTERVAL 10 MINUTE""")
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "alerts")
    H.run_watch(H.watch(H.stream_beats(spark, _files(spark, sf))), out, scratch_path(spark, "alerts_state"))
    schema = "hostname string, last_beat timestamp, alert_at timestamp, beats bigint"
    return spark.read.schema(schema).parquet(out).select("hostname", _text("last_beat"), _text("alert_at"))


# with a clock that has reached the last instant, the stream has said what the batch says then
@query("HB3_clocked_alerts", _SILENT + f"""
    SELECT hostname, {_TEXT.format('t')} AS last_beat, {_TEXT.format("t + INTERVAL 960 SECOND")} AS alert_at
    FROM b, n WHERE coalesce(nxt, as_of) >= t + INTERVAL 960 SECOND""")
def clocked_alerts(spark: SparkSession, sf: str) -> DataFrame:
    ticks, out = scratch_path(spark, "ticks"), scratch_path(spark, "alerts")
    late = F.make_dt_interval(mins=F.lit(10))
    beats(spark, sf).agg((F.max(H.beat_time(F.col("timestamp"))) + late).alias("t")).write.parquet(ticks)
    clock = spark.readStream.schema("t timestamp").parquet(ticks)
    H.run_watch(H.watch(H.stream_beats(spark, _files(spark, sf)), clock=clock), out, scratch_path(spark, "alerts_state"))
    schema = "hostname string, last_beat timestamp, alert_at timestamp, beats bigint"
    return spark.read.schema(schema).parquet(out).select("hostname", _text("last_beat"), _text("alert_at"))
