"""Comparison of two result sets, two lists, and two tile sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hexatlas.operators.ranking import BUCKET_ROWS, ranged
from hexatlas.session import written

TOLERANCE = 1e-9
# a key of more copies on a side is spread over tasks; all others are paired, about TASK_ROWS in a task
HOT_COPIES = 100_000
TASK_ROWS = 500_000
# copies of one record are written out this many at a time
CHUNK = 1_000_000
_NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def _is_number(kind: str) -> bool:
    return kind in _NUMERIC or kind.startswith("decimal")


def type_mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> list[str]:
    """Compared columns whose types differ, two numeric types excepted."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    shared = [c for c in left.columns if c in b and c not in keys]
    return [c for c in shared if a[c] != b[c] and not (_is_number(a[c]) and _is_number(b[c]))]


def _positions(records: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per copy of ``_k, _is_left, _rec, _c`` with its place ``_i`` within key and side.

    Places follow record order. Distinct records are cut into ranges by key, side and record, as
    many as there are rows for, and ranked by weight inside (key, side, range); a key with a
    third of all rows is many ranges. Copies take consecutive places and are only written out afterwards, in
    chunks, so a record repeated a billion times is ranked as one row.
    """
    within = ["_k", "_is_left", "_bucket"]
    bucketed = ranged(records, ["_k", "_is_left", "_rec"], rows)
    # at most one row per bucket for each key and side
    earlier = (Window.partitionBy("_k", "_is_left").orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (bucketed.groupBy(*within).agg(F.sum("_c").alias("_w"))
               .select(*within, F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before")))
    upto = F.sum("_c").over(Window.partitionBy(*within).orderBy("_rec")
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (bucketed.join(offsets, within)
              .withColumn("_first", F.col("_before") + upto - F.col("_c")))
    return _copied(placed)


def _positions_by_key(records: DataFrame) -> DataFrame:
    """The same for keys of few copies, each ranked in the one task that has the key."""
    upto = F.sum("_c").over(Window.partitionBy("_k", "_is_left").orderBy("_rec")
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _copied(records.withColumn("_first", upto - F.col("_c")))


def _copied(placed: DataFrame) -> DataFrame:
    """One row per copy, from the place ``_first`` of each record's first one."""
    return (placed
            .withColumn("_start", F.expr(f"explode(sequence(0L, _c - 1L, {CHUNK}L))"))
            .withColumn("_j", F.expr(f"explode(sequence(_start, least(_start + {CHUNK}L, _c) - 1L))"))
            .select("_k", "_is_left", "_rec", (F.col("_first") + F.col("_j")).alias("_i")))


def result_diff(left: DataFrame, right: DataFrame, keys: list[str],
                tolerance: float = TOLERANCE, unique_keys: bool = False) -> DataFrame:
    """Differences between two result sets as ``keys..., field, kind, a, b``; empty = parity.

    ``kind`` is ``missing_left``, ``missing_right`` (a record or a whole column on one side
    only), ``count`` (a key repeated unequally often), ``type`` or ``value``. Rows equal on
    both sides cancel in one aggregation that combines before its shuffle, however often
    they repeat. What is left is written once and compared by key, and repeats of a key by
    position, in as many tasks as its copies ask for; a hot key is many tasks. Say
    ``unique_keys`` when no side repeats a key, and nothing needs a position.
    """
    a_types, b_types = dict(left.dtypes), dict(right.dtypes)
    fields = [c for c in left.columns if c in b_types and c not in keys]
    mistyped = set(type_mismatches(left, right, keys))
    compared = [c for c in fields if c not in mistyped]

    def kind_of(c: str) -> str:
        return a_types[c] if a_types[c] == b_types[c] else "double"

    # keys travel as one struct, which is never NULL even when a key is
    record = F.struct(*[F.col(c).cast(kind_of(c)).alias(c) for c in compared]) if compared \
        else F.struct(F.lit(0).alias("_none"))

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(F.struct(*keys).alias("_k"), record.alias("_rec"), F.lit(sign).alias("_sign"))

    excess = written((side(left, 1).unionByName(side(right, -1))
              .groupBy("_k", "_rec").agg(F.sum("_sign").alias("_net"))
              .where(F.col("_net") != 0)
              .select("_k", "_rec", (F.col("_net") > 0).alias("_is_left"), F.abs("_net").alias("_c"))), "excess")
    sizes = written(excess.groupBy("_k").agg(
        F.sum(F.when(F.col("_is_left"), F.col("_c")).otherwise(0)).alias("_na"),
        F.sum(F.when(F.col("_is_left"), 0).otherwise(F.col("_c"))).alias("_nb")), "excess-sizes")

    one_sided = F.when(F.col("_na") == 0, "missing_left").when(F.col("_nb") == 0, "missing_right") \
        .otherwise("count")
    uneven = sizes.where("_na <> _nb").select(
        "_k", F.lit("").alias("field"), one_sided.alias("kind"),
        F.col("_na").cast("string").alias("a"), F.col("_nb").cast("string").alias("b"))

    # written, as a small table is then known to be one and the rest stays where it is
    apart = (F.col("_na") != F.col("_nb")) if unique_keys else (F.col("_na") != F.col("_nb")) | (F.col("_na") > HOT_COPIES)
    aside = written(sizes.where(apart), "excess-aside")
    copies = sizes.where(~apart).agg(F.sum(F.col("_na") + F.col("_nb"))).first()[0] or 0
    few = excess.join(aside.select("_k"), "_k", "left_anti").repartition(-(-copies // TASK_ROWS) or 1, "_k")

    def pairs(placed: DataFrame) -> DataFrame:
        return placed.groupBy("_k", "_i").agg(
            F.max(F.when(F.col("_is_left"), F.col("_rec"))).alias("_a"),
            F.max(F.when(~F.col("_is_left"), F.col("_rec"))).alias("_b"))

    paired = pairs(few.withColumn("_i", F.lit(0)) if unique_keys else _positions_by_key(few))
    hot = aside.where("_na = _nb").select("_k")
    if not unique_keys and not hot.isEmpty():
        paired = paired.unionByName(pairs(_positions(excess.join(hot, "_k", "left_semi"))))
    found = []
    for c in compared:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        same = x.eqNullSafe(y)
        if kind_of(c) in ("double", "float"):
            same = same | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        found.append(F.when(~same, F.struct(
            F.lit(c).alias("field"), F.lit("value").alias("kind"),
            x.cast("string").alias("a"), y.cast("string").alias("b"))))
    rows = uneven
    if found:
        valued = paired.select("_k", F.explode(F.array_compact(F.array(*found))).alias("d"))
        rows = uneven.unionByName(valued.select("_k", "d.field", "d.kind", "d.a", "d.b"))
    rows = rows.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "field", "kind", "a", "b")

    # differences of shape hold for the whole table: one row each, with empty keys
    shape = [(c, "missing_right", a_types[c], None) for c in left.columns if c not in b_types] + \
            [(c, "missing_left", None, b_types[c]) for c in right.columns if c not in a_types] + \
            [(c, "type", a_types[c], b_types[c]) for c in sorted(mistyped)]
    if not shape:
        return rows
    extra = left.sparkSession.createDataFrame(
        shape, "field string, kind string, a string, b string")
    types = dict(rows.dtypes)
    return rows.unionByName(extra.select(
        *[F.lit(None).cast(types[k]).alias(k) for k in keys], "field", "kind", "a", "b"))


def list_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, as multisets: the row, ``side`` and ``copies`` in excess.

    One aggregation over both sides; equal rows cancel before they are shuffled.
    """
    columns = left.columns
    net = (left.withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(-1)))
           .groupBy(*columns).agg(F.sum("_s").alias("_net")).where(F.col("_net") != 0))
    return net.select(*columns, F.when(F.col("_net") > 0, "left").otherwise("right").alias("side"),
                      F.abs("_net").alias("copies"))


def tile_parity(left: DataFrame, right: DataFrame, bands: list[str],
                tile: tuple[str, ...] = ("z", "x", "y"),
                pixel: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """Per tile: pixels compared and pixels that differ in any band or are on one side only.

    A pixel is the same where both sides have the same rows for it, however many these are.
    Equal rows cancel in one aggregation; no pixel is paired with another.
    """
    on = [*tile, *pixel]
    both = left.select(*on, *bands, F.lit(1).alias("_s")).unionByName(right.select(*on, *bands, F.lit(-1).alias("_s")))
    net = both.groupBy(*on, *bands).agg(F.sum("_s").alias("_net"))
    per_pixel = net.groupBy(*on).agg(F.max((F.col("_net") != 0).cast("long")).alias("_differs"))
    return per_pixel.groupBy(*tile).agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("_differs").alias("differing"))


def parity_totals(per_tile: DataFrame) -> DataFrame:
    """Tiles compared, tiles identical, and the largest difference of any tile."""
    return per_tile.agg(
        F.count(F.lit(1)).alias("tiles"),
        F.sum((F.col("differing") == 0).cast("long")).alias("identical"),
        F.max("differing").alias("worst"))
