"""Exact ranks over whole tables without a single-partition window.

A global rank is made of two parts: how many rows lie in earlier buckets, and the rank
inside the row's own bucket. Buckets are ranges of the keys, as many as the row count asks for,
so a task ranks about ``BUCKET_ROWS`` rows whatever the size of the table; only their totals,
one number a bucket, meet on the driver. Inputs are written once, so the jobs that count,
split and rank see the same rows and a lost executor recomputes none of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexatlas.session import written

BUCKET_ROWS = 1_000_000
# split points of one round of a selection
SPLITS = 127


def ranged(df: DataFrame, keys: list[str], rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows with a ``_bucket``: ranges of ``keys`` of about ``rows`` rows, numbered in key order.

    All keys count, so a first key that a third of all rows share is many buckets.
    """
    stored = written(df, "ranked")
    parts = -(-stored.count() // rows)
    if parts <= 1:
        return stored.withColumn("_bucket", F.lit(0))
    # the bucket is the task that holds the range; written, as it is none any more after a shuffle
    return written(stored.repartitionByRange(parts, *keys).withColumn("_bucket", F.spark_partition_id()), "ranked")


def dense_ids(df: DataFrame, key: str, id_name: str, start: int = 1, rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per distinct ``key`` with a gap-free BIGINT id in key order."""
    bucketed = ranged(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], rows)
    offsets, before = [], start - 1
    for r in sorted(bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["_bucket"], before))
        before += r["n"]
    # 12 bytes for every BUCKET_ROWS keys
    table = df.sparkSession.createDataFrame(offsets, "_bucket int, _from long")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    placed = bucketed.join(F.broadcast(table), "_bucket")
    return placed.select(key, (F.col("_from") + inside).cast("long").alias(id_name))


@dataclass
class _Span:
    """Values from ``low`` (None: the least) to below ``high`` (None: the greatest)."""
    low: Any
    high: Any
    before: int
    rows: int
    ranks: list[int]

    def holds(self, kind: str) -> Column:
        v, inside = F.col("_v"), F.lit(True)
        if self.low is not None:
            inside = inside & (v >= F.lit(self.low).cast(kind))
        if self.high is not None:
            inside = inside & (v < F.lit(self.high).cast(kind))
        return inside


def _narrowed(hist: DataFrame, span: _Span, kind: str) -> list[_Span]:
    """The parts of a span that hold its ranks, after a count between split points.

    Split points are the values of smallest hash: a bounded, repeatable, uniform sample.
    """
    part = hist.where(span.holds(kind))
    picked = sorted(r["_v"] for r in part.select("_v").orderBy(F.xxhash64("_v"), "_v").limit(SPLITS).collect())
    splits = F.array(*[F.lit(s).cast(kind) for s in picked])
    counts = part.select("_c", F.size(F.filter(splits, lambda s: s <= F.col("_v"))).alias("_b")).groupBy("_b").agg(
        F.sum("_c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    edges, before, found = [span.low, *picked, span.high], span.before, []
    for r in sorted(counts):
        ranks = [k for k in span.ranks if before <= k < before + r["c"]]
        if ranks:
            found.append(_Span(edges[r["_b"]], edges[r["_b"] + 1], before, r["n"], ranks))
        before += r["c"]
    return found


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of exact percentiles with linear interpolation, one column per name.

    Equal values collapse to one counted row, written once. While a range that holds a wanted
    rank has more than ``rows`` values, it is narrowed by counting between 127 split points,
    so a thousand million values take three rounds; then only those ranges are sorted. The
    built-in ``percentile`` keeps every distinct value of the table in one task's memory.
    """
    kind = dict(df.select(F.col(value).alias("_v")).dtypes)["_v"]
    hist = written(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")), "histogram")
    size = hist.agg(F.count(F.lit(1)).alias("n"), F.sum("_c").alias("total")).first()
    if not size["n"]:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in probs])
    places = {}
    for name, p in probs.items():
        exact = (size["total"] - 1) * float(p)
        places[name] = (int(exact // 1), int(-(-exact // 1)), exact - exact // 1)
    spans = [_Span(None, None, 0, size["n"], sorted({r for lo, hi, _ in places.values() for r in (lo, hi)}))]
    while any(s.rows > rows for s in spans):
        spans = [n for s in spans for n in (_narrowed(hist, s, kind) if s.rows > rows else [s])]

    bucket = F.lit(None).cast("int")
    before = F.lit(None).cast("long")
    for i, s in enumerate(spans):
        bucket = F.when(s.holds(kind), i).otherwise(bucket)
        before = F.when(s.holds(kind), F.lit(s.before).cast("long")).otherwise(before)
    running = F.sum("_c").over(Window.partitionBy("_bucket").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    ranked = hist.withColumns({"_bucket": bucket, "_from": before}).where(F.col("_bucket").isNotNull()).withColumn(
        "_upto", F.col("_from") + running)
    found = ranked.agg(*[F.min(F.when(F.col("_upto") > r, F.col("_v"))).alias(f"{name}_{end}")
                         for name, (lo, hi, _) in places.items() for end, r in (("lo", lo), ("hi", hi))])
    return found.select(*[
        (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.lit(part)).alias(n)
        for n, (_, _, part) in places.items()])
