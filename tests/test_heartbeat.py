"""Latest beats, status, silences, and the stream with late and out-of-order beats."""

import json

import pytest
from pyspark.sql import functions as F

from hexatlas.streaming import heartbeat as H


def at(minute, second=0):
    return f"2024-03-01T{minute // 60:02d}:{minute % 60:02d}:{second:02d}Z"


def beat(host, ts, web="up"):
    return {"timestamp": ts, "hostname": host, "uptime_since": "x", "disk_free": "1T", "mem_free": "8G",
            "services": {"web": web, "apps": "up"}}


def frame(spark, beats):
    return spark.createDataFrame([tuple(b[c] for c in H.SCHEMA.names) for b in beats], H.SCHEMA)


def instant(text):
    return F.lit(text).cast("timestamp")


def test_latest(spark):
    df = frame(spark, [beat("a", at(5)), beat("a", at(9), "last"), beat("a", at(7)), beat("a", "junk"), beat("b", None)])
    got = {r["hostname"]: (r["timestamp"], r["services"]["web"]) for r in H.latest_beats(df).collect()}
    assert got == {"a": (at(9), "last"), "b": (None, "up")}


@pytest.mark.parametrize("now,want", [(at(25, 59), "OK"), (at(26), "DOWN"), (at(10), "OK"), (at(300), "DOWN")])
def test_age_is_in_whole_minutes(spark, now, want):
    df = H.latest_beats(frame(spark, [beat("a", at(10))]))
    assert H.host_status(df, df.select("hostname"), instant(now)).head()["status"] == want


def test_status_kinds(spark):
    df = frame(spark, [beat("ok", at(60)), beat("down", at(10), "exited"), beat("empty", ""), beat("none", None), beat("junk", "soon")])
    hosts = spark.createDataFrame([(h,) for h in ("ok", "down", "empty", "none", "junk", "gone")], "hostname string")
    rows = {r["hostname"]: r for r in H.host_status(H.latest_beats(df), hosts, instant(at(62))).collect()}
    assert {h: r["status"] for h, r in rows.items()} == {
        "ok": "OK", "down": "DOWN", "empty": "PARSE ERROR", "none": "PARSE ERROR", "junk": "PARSE ERROR", "gone": "MISSING"}
    assert rows["down"]["services"] == {"web": "exited", "apps": "up"} and rows["ok"]["services"] is None
    assert rows["down"]["age_min"] == 52


def test_silences(spark):
    times = [0, 5, 10, 25, 41, 46, 90]      # 10 -> 25 is fifteen minutes, 25 -> 41 sixteen
    df = frame(spark, [beat("a", at(m)) for m in times] + [beat("b", at(88))])
    rows = H.silences(df, instant(at(95))).select(
        "hostname", F.date_format("last_beat", "HH:mm").alias("l"), F.date_format("alert_at", "HH:mm").alias("a"),
        F.date_format("back_at", "HH:mm").alias("b")).collect()
    assert sorted(map(tuple, rows)) == [("a", "00:25", "00:41", "00:41"), ("a", "00:46", "01:02", "01:30")]
    open_ended = H.silences(df, instant(at(104))).where("back_at IS NULL")
    assert [r["hostname"] for r in open_ended.collect()] == ["b"]


def test_silences_equal_a_plain_scan(spark):
    import random
    rng = random.Random(4)
    secs = {h: sorted(rng.randrange(0, 80000) for _ in range(120)) for h in "abc"}
    df = spark.createDataFrame([(h, s) for h, v in secs.items() for s in v], "hostname string, s int").withColumn(
        "timestamp", F.date_format(F.timestamp_seconds(F.col("s") + 1700000000), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    want = {(h, a) for h, v in secs.items() for a, b in zip(v, v[1:] + [80000]) if b - a >= 960}
    got = H.silences(df, F.timestamp_seconds(F.lit(1700080000))).select(
        "hostname", (F.unix_seconds("last_beat") - 1700000000).alias("l")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def drop(folder, name, beats):
    (folder / name).write_text("\n".join(json.dumps(b) for b in beats))


def run(spark, folder, out, state):
    H.run_watch(H.watch(H.stream_beats(spark, str(folder)), "10 minutes"), str(out), str(state))
    rows = spark.read.schema("hostname string, last_beat timestamp, alert_at timestamp, beats bigint").parquet(str(out))
    return sorted((r["hostname"], r["l"], r["beats"]) for r in rows.select(
        "hostname", F.date_format("last_beat", "HH:mm").alias("l"), "beats").collect())


def test_stream_with_out_of_order_and_late_beats(spark, tmp_path):
    src, out, state = (tmp_path / n for n in ("in", "out", "state"))
    src.mkdir()
    drop(src, "1.json", [beat("a", at(0)), beat("b", at(0)), beat("b", at(10))])
    assert run(spark, src, out, state) == []
    # out of order within the allowance: 12 joins a's first run although 20 came with it
    drop(src, "2.json", [beat("a", at(20)), beat("a", at(12)), beat("b", at(20))])
    assert run(spark, src, out, state) == []
    # b goes on, a does not; event time passes a's limit (36) plus the allowance
    drop(src, "3.json", [beat("b", at(m)) for m in (30, 40, 50)])
    assert run(spark, src, out, state) == [("a", "00:20", 3)]
    # a beat of a from long ago arrives now: dropped, it neither revives nor repeats a
    drop(src, "4.json", [beat("a", at(22)), beat("b", at(60))])
    assert run(spark, src, out, state) == [("a", "00:20", 3)]
    # a really comes back, then falls silent again
    drop(src, "5.json", [beat("a", at(65)), beat("b", at(70)), beat("b", at(80)), beat("b", at(95)), beat("b", at(110))])
    assert run(spark, src, out, state) == [("a", "00:20", 3), ("a", "01:05", 1)]


def test_the_stream_says_a_silence_of_exactly_the_limit(spark, tmp_path):
    src, out, state = (tmp_path / n for n in ("in", "out", "state"))
    src.mkdir()
    # sixteen minutes are a silence, a second less is none, as in the batch
    beats = [beat("a", at(0)), beat("a", at(16)), beat("b", at(0)), beat("b", at(15, 59)), beat("c", at(90))]
    drop(src, "1.json", beats)
    assert run(spark, src, out, state) == [("a", "00:00", 1), ("a", "00:16", 1), ("b", "00:15", 2)]
    quiet = H.silences(frame(spark, beats), instant(at(80))).select("hostname", F.date_format("last_beat", "HH:mm"), "alert_at")
    said = spark.read.schema("hostname string, last_beat timestamp, alert_at timestamp").parquet(str(out))
    assert sorted(quiet.collect()) == sorted(said.select("hostname", F.date_format("last_beat", "HH:mm"), "alert_at").collect())


def test_a_clock_tells_when_every_host_is_silent(spark, tmp_path):
    src, ticks, out, state = (tmp_path / n for n in ("in", "ticks", "out", "state"))
    src.mkdir()

    def tick(minute):
        spark.createDataFrame([(at(minute),)], "t string").selectExpr("cast(t as timestamp) t").write.mode("append").parquet(str(ticks))

    def run_clocked():
        clock = spark.readStream.schema("t timestamp").parquet(str(ticks))
        H.run_watch(H.watch(H.stream_beats(spark, str(src)), "10 minutes", clock), str(out), str(state))
        rows = spark.read.schema("hostname string, last_beat timestamp, alert_at timestamp, beats bigint").parquet(str(out))
        return sorted((r["hostname"], r["l"], r["beats"]) for r in rows.select(
            "hostname", F.date_format("last_beat", "HH:mm").alias("l"), "beats").collect())

    drop(src, "1.json", [beat("a", at(0)), beat("a", at(10)), beat("b", at(3)), beat(None, at(4))])
    tick(11)
    assert run_clocked() == []
    # nobody beats any more; the clock passes b's limit (19) plus the allowance, then a's (26)
    tick(30)
    assert run_clocked() == [("b", "00:03", 1)]
    tick(37)
    assert run_clocked() == [("a", "00:10", 2), ("b", "00:03", 1)]
    # a beat from before the limit arrives too late to revive b; a real one starts a new run
    drop(src, "2.json", [beat("b", at(5)), beat("b", at(40))])
    tick(50)
    assert run_clocked() == [("a", "00:10", 2), ("b", "00:03", 1)]
    tick(80)
    assert run_clocked() == [("a", "00:10", 2), ("b", "00:03", 1), ("b", "00:40", 1)]
    assert H.ticking(spark).isStreaming and H.ticking(spark).dtypes == [("t", "timestamp")]


def test_stream_needs_no_python_worker(spark, tmp_path):
    (tmp_path / "x").mkdir()
    text = H.watch(H.stream_beats(spark, str(tmp_path / "x")))._jdf.queryExecution().analyzed().toString()
    assert "Python" not in text and "session_window" in text.lower()
