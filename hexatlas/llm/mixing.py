"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key ``-ln(u) / weight`` with a ``u`` that depends on its id
alone, so reruns agree. A source whose target is several times its size is taken whole that
often; the rest of its target is filled with its documents in the order of their keys, and the
document at the end of the budget gives the words that are left.

No source is ever sorted as a whole. Word counts are summed per key bucket (two levels of 1024
buckets each), which leaves one bucket per source to sort: about a millionth of its documents.
The result of that search is one row per source, the key at which the source is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hexatlas.llm.base import aside, query, table, word_count
from hexatlas.session import written

BUCKETS = 1024
SALTS = 64


def uniform(ids: Column, seed: str) -> Column:
    """A number in (0, 1) from the id: 52 bits of the digest of ``seed:id``."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ids.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """Target words per source from ``source, source_size`` (one row per source, null last).

    Sources in code-point order get ``weights`` in turn. A source stops at ``most`` times its
    size and the excess goes to the others by weight, until none is above: the water level at
    which capped and uncapped sources part is found in one pass over the sources in the order
    of ``cap / weight``. Both windows see one row per source, never documents.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    capped = (ranked.withColumn("_w", weight)
              .withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the first source, in this order, whose cap is above the level is the first uncapped one
    seen = capped.withColumn("_level", level)
    open_level = F.min_by(F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.col("_level")),
                          F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.col("_cap") / F.col("_w"))).over(everyone)
    bound = seen.withColumn("_open", open_level)
    target = F.when(F.col("_cap") > F.col("_open") * F.col("_w"), F.col("_open") * F.col("_w")).otherwise(F.col("_cap"))
    return bound.select("source", "source_size", target.alias("target"))


def _edge(sums: DataFrame, keep: list[str], bucket: str) -> DataFrame:
    """The bucket of each source in which its budget runs out, and the budget left there."""
    w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (sums.withColumn("_before", F.coalesce(F.sum("_words").over(w), F.lit(0)))
            .where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_words")))
            .select("source", *keep, F.col(bucket), (F.col("_left") - F.col("_before")).alias("_left")))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", size: str = "size",
        weight: str | None = None, share: float = 1.5, most: float = 2.0,
        source_weights: tuple[int, ...] = (5, 2, 1), seed: str = "mix") -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``taken`` (words that the mix takes).

    ``size`` is a column of word counts (null: 0), ``weight`` one of quality weights (null or
    not above zero: 1). A null source is a source. Documents of equal key are ordered by id;
    rows that repeat an id are one document of several copies, and share what the budget
    leaves at the cut equally, rounded down. An empty table gives an empty one. Columns of
    ``docs`` named like the three results are replaced, others are kept, whatever their names.
    """
    used = [doc_id, source, size] + ([] if weight is None else [weight])
    return aside(docs, used, lambda plain: _mix(plain, doc_id, source, size, weight, share, most, source_weights, seed))


def _mix(docs: DataFrame, doc_id: str, source: str, size: str, weight: str | None, share: float, most: float,
         source_weights: tuple[int, ...], seed: str) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.lit(1.0))
    key = -F.log(uniform(F.col(doc_id), seed)) / w.cast("double")
    # key -> (0, 1) without changing its order, then two digits of it
    part = F.least(F.floor((F.lit(1.0) - F.exp(-key)) * BUCKETS * BUCKETS), F.lit(BUCKETS * BUCKETS - 1))
    kept = docs.columns
    keyed = docs.select(*kept, key.alias("_key"), part.cast("int").alias("_part"),
                        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    small = written(keyed.select(F.col(source).alias("source"), F.col(doc_id).alias("_id"), "_key", "_part", "_size"),
                    "mix-keys")
    goals = targets(small.groupBy("source").agg(F.sum("_size").alias("source_size")), share, most, source_weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = written(goals.withColumn("_epochs", whole.cast("long"))
                    .withColumn("_left", F.round(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size")),
                    "mix-goals")

    def met(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
        """Equality with one row per source; the hot source is dealt over ``SALTS`` keys."""
        a = left.withColumn("_salt", F.pmod(F.hash("_key"), F.lit(SALTS)))
        b = (right.withColumnsRenamed({"source": "_src", **{c: "_at" + c for c in also}})
             .withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        on = a["source"].eqNullSafe(b["_src"]) & (a["_salt"] == b["_to"])
        for c in also:
            on = on & (a[c] == b["_at" + c])
        return a.join(b, on).drop("_salt", "_to", "_src", *["_at" + c for c in also])

    coarse = small.withColumn("_b1", F.floor(F.col("_part") / BUCKETS).cast("int")) \
        .withColumn("_b2", F.pmod("_part", F.lit(BUCKETS)))
    sums = coarse.groupBy("source", "_b1").agg(F.sum("_size").alias("_words"), F.min("_key").alias("_key"))
    edge1 = _edge(met(sums, goals.select("source", "_left")), [], "_b1")
    inner = met(coarse, edge1, "_b1").groupBy("source", "_b1", "_b2", "_left").agg(F.sum("_size").alias("_words"))
    edge2 = _edge(inner, ["_b1"], "_b2")
    last = met(coarse, edge2, "_b1", "_b2").groupBy("source", "_left", "_key", "_id").agg(
        F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy("source").orderBy("_key", F.col("_id").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    cut = (last.withColumn("_before", F.coalesce(F.sum("_words").over(order), F.lit(0)))
           .where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_words")))
           .select(F.col("source").alias("_cs"), F.col("_key").alias("_ck"), F.col("_id").alias("_ci"),
                   F.floor((F.col("_left") - F.col("_before")) / F.col("_rows")).alias("_rest")))
    per_source = written(
        goals.join(cut, F.col("source").eqNullSafe(F.col("_cs")), "left")
        .select("source", "source_size", "target", "_epochs", "_left", "_ck", "_ci", "_rest"), "mix-cuts")

    as_source = keyed if source == "source" else keyed.withColumn("source", F.col(source))
    mixed = met(as_source, per_source)
    here = F.struct(F.col("_key"), F.col(doc_id))
    at = F.struct(F.col("_ck"), F.col("_ci"))
    # no cut and words left over: rounding took the whole source
    part_taken = (F.when(F.col("_ck").isNull(), F.when(F.col("_left") >= F.col("source_size"), F.col("_size")).otherwise(F.lit(0)))
                  .when(here < at, F.col("_size")).when(here.eqNullSafe(at), F.col("_rest")).otherwise(F.lit(0)))
    taken = F.col("_epochs") * F.col("_size") + part_taken
    return mixed.select(*kept, "source_size", "target", taken.cast("long").alias("taken"))


def quality_weighted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``weight``: 2 where a label says good, 1/2 where one says bad, else 1.

    A column of ``docs`` of that name is replaced.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    weight = F.when(F.col("_quality") >= 1, F.lit(2.0)).when(F.col("_quality") < 1, F.lit(0.5)).otherwise(F.lit(1.0))
    return aside(docs, ["doc_id"], lambda plain: plain.join(known, "doc_id", "left").withColumn("weight", weight).drop("_quality"))


_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / CASE WHEN q >= 1 THEN 2.0 WHEN q < 1 THEN 0.5 ELSE 1.0 END AS k
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY 1),
c AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (r - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM c),
o AS (SELECT min_by(lev, cap / w) FILTER (WHERE cap > lev * w) AS lev FROM l),
g AS (SELECT source, source_size, CASE WHEN cap > o.lev * w THEN o.lev * w ELSE cap END AS target FROM l, o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n FROM g),
p AS (SELECT doc_id, size, source_size, target, n, CAST(round(target) AS BIGINT) - n * source_size AS budget,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id) - size AS BIGINT) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(n * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM p"""


@query("op1_mixing", _SQL)
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    weighted = quality_weighted(docs, table(spark, sf_dir, "labels"))
    return mix(weighted, weight="weight").select("doc_id", "size", "source_size", "target", "taken")
