"""Connected components of an edge table, in the shared folder rather than on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hexatlas.session import written


#: Links that make a task of a round worth while: fewer are not spread over more tasks.
ROWS = 20_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): root is the least node reachable.

    Alternating large-star and small-star rounds: each links the larger (smaller) neighbours of
    every node to its least one, until every edge points at a root. The number of rounds grows
    with the logarithm of the longest path. Every round is written to the shared folder, so
    lost executors cost one round at most. The least neighbour is a partial aggregate and joined
    back, so a node with a third of all edges is never one group in memory. Rounds over few links
    are done in few tasks. Loops and repeated edges change nothing; no edges give no rows.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = written(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        tasks = 1 + now.count() // ROWS

        def few(df: DataFrame) -> DataFrame:
            return df.coalesce(tasks) if tasks < parts else df

        now = few(now)
        # an edge's larger node goes to the least node around its smaller one
        around = _both_ways(now).groupBy("a").agg(F.min("b").alias("_m")).select(
            F.col("a").alias("_n"), F.least("_n", "_m").alias("_m"))
        large = few(few(now.join(around, F.col("b") == F.col("_n")).select("a", F.col("_m").alias("b"))).distinct())
        # small star: a node's smaller neighbours and itself go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_n")
        joined = few(large.join(least, F.col("a") == F.col("_n")))
        small = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(
            few(least).select(F.col("_n").alias("a"), F.col("_m").alias("b")))
        now = few(written(few(small.where(F.col("a") != F.col("b")).distinct()), label))
        # done when no node is both below a root and a root, and none has two roots
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
            now.select("b", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where(
            F.col("below") + F.col("above") > 1)
        if open_.isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
