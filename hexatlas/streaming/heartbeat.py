"""Heartbeats: latest record, status at an instant, and silences, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# A host is down when its last beat is more than this many whole minutes old.
STALE_MINUTES = 15
# the first age that counts as more than 15 whole minutes
SILENT_SECONDS = (STALE_MINUTES + 1) * 60
# Spark joins sessions that touch: beats as far apart as the limit, or farther, are two runs
SESSION_GAP = f"{SILENT_SECONDS - 1} seconds 999 milliseconds 999 microseconds"

SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("uptime_since", T.StringType()),
    T.StructField("disk_free", T.StringType()),
    T.StructField("mem_free", T.StringType()),
    T.StructField("services", T.MapType(T.StringType(), T.StringType())),
])


def read_beats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def stream_beats(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def beat_time(text: Column) -> Column:
    """Instant of a beat; NULL when the text is absent, empty or no timestamp."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def latest_beats(beats: DataFrame) -> DataFrame:
    """The last record of each host. A host with most of the records combines map-side.

    Records without a readable time sort first, so they stand only for a host that has
    no other.
    """
    rest = [c for c in beats.columns if c not in ("hostname", "services")]
    services = F.sort_array(F.map_entries("services"))
    order = F.struct(beat_time(F.col("timestamp")).alias("t"), *rest, services.alias("s"))
    record = F.struct(*[c for c in beats.columns if c != "hostname"])
    return (beats.where(F.col("hostname").isNotNull())
            .groupBy("hostname").agg(F.max_by(record, order).alias("r"))
            .select("hostname", "r.*"))


def host_status(latest: DataFrame, expected: DataFrame, as_of: Column) -> DataFrame:
    """``hostname, status, age_min, services`` of every expected host at one instant.

    MISSING without any record, PARSE ERROR without a readable time, DOWN above the
    stale limit (with the last service states), else OK. Age is in whole minutes.
    """
    joined = (expected.select("hostname").distinct()
              .join(latest.withColumn("_seen", F.lit(True)), "hostname", "left")
              .withColumn("_as_of", as_of))
    seconds = F.unix_seconds("_as_of") - F.unix_seconds(beat_time(F.col("timestamp")))
    age = F.floor(seconds / 60)
    status = (F.when(F.col("_seen").isNull(), "MISSING").when(age.isNull(), "PARSE ERROR")
              .when(age > STALE_MINUTES, "DOWN").otherwise("OK"))
    return joined.select(
        "hostname", status.alias("status"), age.alias("age_min"),
        F.when(status == "DOWN", F.col("services")).alias("services"))


def silences(beats: DataFrame, as_of: Column) -> DataFrame:
    """Every silence up to ``as_of``: ``hostname, last_beat, alert_at, back_at``.

    Beats are first reduced to one row per host and time slot as long as the limit: beats
    within a slot are closer than the limit, so no silence is lost, and a host has at most
    one row per slot however often it beats.
    """
    at = beat_time(F.col("timestamp"))
    slots = (beats.select("hostname", at.alias("t")).where(F.col("t").isNotNull())
             .withColumn("_slot", F.floor(F.unix_seconds("t") / SILENT_SECONDS))
             .groupBy("hostname", "_slot")
             .agg(F.min("t").alias("first"), F.max("t").alias("last")))
    following = F.lead("first").over(Window.partitionBy("hostname").orderBy("_slot"))
    limit = F.make_dt_interval(secs=F.lit(SILENT_SECONDS))
    ahead = slots.withColumns({"back_at": following, "_as_of": as_of})
    return (ahead.where(F.coalesce("back_at", "_as_of") >= F.col("last") + limit)
            .select("hostname", F.col("last").alias("last_beat"),
                    (F.col("last") + limit).alias("alert_at"), "back_at"))


def ticking(spark: SparkSession) -> DataFrame:
    """A clock for :func:`watch`: the wall time, once a second, as ``t``."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("timestamp").alias("t"))


def watch(beats: DataFrame, lateness: str = "10 minutes", clock: DataFrame | None = None) -> DataFrame:
    """Streaming alerts: one row per silence, once time has passed its limit.

    A run of beats closer than the limit is one session; it ends a microsecond before the last
    beat plus the limit, which is when the alert falls due. Out-of-order beats within ``lateness``
    join or merge sessions; later ones are dropped and cannot revive a host.

    Without a ``clock``, time moves with the beats of all hosts, so nothing is said while all are
    silent. A clock is a second stream with a timestamp ``t``, such as :func:`ticking`: its ticks
    join the beats before the watermark is taken and move it on by themselves. They belong to
    no host; their one session is never shown.
    """
    timed = beats.where(F.col("hostname").isNotNull()).select("hostname", beat_time(F.col("timestamp")).alias("t"))
    if clock is not None:
        timed = timed.unionByName(clock.select(F.lit(None).cast("string").alias("hostname"), "t"))
    return (timed.withWatermark("t", lateness)
            .groupBy("hostname", F.session_window("t", SESSION_GAP).alias("w"))
            .agg(F.max("t").alias("last_beat"), F.count("hostname").alias("beats"))
            # on the count, not on the key: that filter would be pushed below the watermark
            .where(F.col("beats") > 0)
            .select("hostname", "last_beat",
                    (F.col("last_beat") + F.make_dt_interval(secs=F.lit(SILENT_SECONDS))).alias("alert_at"), "beats"))


def run_watch(alerts: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; alerts are appended as Parquet, exactly once."""
    query = (alerts.writeStream.outputMode("append").format("parquet")
             .option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
