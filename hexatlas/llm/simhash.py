"""SimHash near-duplicates: fingerprints within two differing bits, linked exactly.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in two
bits at most, one of the segments differs in one bit at most, so the two share one of that
segment's 32 one-wildcard variants. Every fingerprint is indexed under its 64 variants; an
equality join on them proposes pairs and the whole fingerprints verify them.

A variant shared by more than ``FEW`` fingerprints proposes no pairs. Its members are indexed
instead under two wildcards (of the whole fingerprint), as often as that variant's pairs can
differ: fingerprints that share such a key are within two bits of each other by construction,
so they are linked in a star to the least of them. That way is exact too and grows in
proportion to the group, never with its square.

Only distinct fingerprints are compared: copies are one row here, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexatlas.llm.base import query, table
from hexatlas.llm.components import components
from hexatlas.session import written

SEED = 42
SHINGLE = 3
FEW = 256
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text as an unsigned number; a text without words has 0.

    Words are taken from the UTF-8 bytes: lower-casing bytes changes A-Z alone, and splitting
    bytes cuts at space, tab, line feed, vertical tab, form feed and return.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at:at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (fp as a signed long) for every row; null text is a text without words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b["text"]), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def _segment(value: Column, low: bool) -> Column:
    mask = 0xFFFFFFFF if low else 0xFFFFFFFF << 32
    return value.bitwiseAND(F.lit(np.uint64(mask).astype(np.int64).item()))


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot)


def variants(fps: DataFrame) -> DataFrame:
    """``slot, key, fp``: the 64 one-wildcard segment variants of each fingerprint.

    Slot names the bit left out, and with it the segment.
    """
    each = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
    segment = F.when(F.col("slot") < 32, _segment(F.col("fp"), True)).otherwise(_segment(F.col("fp"), False))
    return each.select("slot", segment.bitwiseAND(F.bitwise_not(_bit(F.col("slot")))).alias("key"), "fp")


def _members(fps: DataFrame, groups: DataFrame) -> DataFrame:
    """``slot, key, n, fp``: the fingerprints of some variants (``slot, key, n``).

    A variant stands for two values of its segment, so fingerprints are met by their two
    segments instead of by their 64 variants again.
    """
    both = groups.select("slot", "key", "n", (F.col("slot") < 32).alias("low"), F.explode(
        F.array("key", F.col("key").bitwiseOR(_bit(F.col("slot"))))).alias("segment"))
    own = fps.select("fp", F.lit(True).alias("low"), _segment(F.col("fp"), True).alias("segment")).union(
        fps.select("fp", F.lit(False).alias("low"), _segment(F.col("fp"), False).alias("segment")))
    return own.join(both, ["low", "segment"]).select("slot", "key", "n", "fp")


def _two_wildcards(members: DataFrame) -> DataFrame:
    """Star links of the members (``slot, fp``) of large variants.

    Where the segment of the slot agrees but for the slot's bit, the rest may differ in one bit
    (keys: the slot and any bit of the other segment) or, if the slot's bit agrees as well, in
    two bits of the other segment.
    """
    other = F.when(F.col("low"), F.lit(32)).otherwise(F.lit(0))
    sided = members.select("fp", "slot", (F.col("slot") < 32).alias("low"))
    crossed = sided.select("fp", F.col("slot").alias("i"), F.explode(F.sequence(other, other + 31)).alias("j"))
    inner = sided.select("fp", "low").distinct().select(
        "fp", "low", F.explode(F.sequence(other, other + 30)).alias("i")).select(
        "fp", "i", F.explode(F.sequence(F.col("i") + 1, other + 31)).alias("j"))
    keyed = crossed.union(inner).select(
        F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("fp").bitwiseAND(
            F.bitwise_not(_bit(F.col("i")).bitwiseOR(_bit(F.col("j"))))).alias("key"), "fp")
    least = keyed.groupBy("i", "j", "key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")) \
        .where(F.col("least") < F.col("most")).drop("most")
    return keyed.join(least, ["i", "j", "key"]).where(F.col("fp") != F.col("least")).select(
        F.col("fp").alias("a"), F.col("least").alias("b"))


def links(fps: DataFrame, few: int = FEW) -> DataFrame:
    """``a, b``: links that connect just the fingerprints within two bits of each other.

    ``fps`` has one distinct non-null ``fp`` a row. Groups of up to ``few`` give every pair
    within two bits; larger ones give stars of such pairs with the same components. A link may be
    given more than once.
    """
    # variants are 64 times as many: dealt out first, so that a task counts a small part of them
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = written(variants(fps.repartition(parts, "fp")).groupBy("slot", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("b"), F.max("fp").alias("a")).where(F.col("n") > 1),
        "simhash-groups")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    two = shared.where(F.col("n") == 2).select("a", "b").where(near)
    members = written(_members(fps, shared.where(F.col("n") > 2).select("slot", "key", "n")), "simhash-members")
    left = members.where(F.col("n") <= few).select("slot", "key", F.col("fp").alias("a"))
    right = left.withColumnRenamed("a", "b")
    several = left.join(right, ["slot", "key"]).where(F.col("a") > F.col("b")).where(near).select("a", "b")
    large = members.where(F.col("n") > few).select("slot", "fp")
    return two.union(several).union(_two_wildcards(large))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", few: int = FEW) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id among the documents reachable over links of at most two
    differing bits. Equal texts are linked; a text without words has fingerprint 0 and is linked
    like any other. A null id keeps its row and never names a component that has other ids;
    repeated rows are returned as often as they come. An empty table gives an empty one.
    """
    rows = written(with_fingerprint(docs, id_column), "simhash")
    least = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(least.select("fp"), few), "simhash-links")
    joined = least.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    first = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(first, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def kept(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id.

    Rows that repeat the kept id are one document and stay; rows of a null id stay only where
    their whole group has no id.
    """
    found = near_duplicates(docs.select(F.col(id_column).alias("doc_id"), "text"))
    named = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_keep")).distinct()
    return docs.join(named, F.col(id_column).eqNullSafe(F.col("_keep")), "left_semi")


@query("op6_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
