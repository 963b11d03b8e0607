"""Nearest vectors by cosine: vantage-point trees per shard, pruned by the triangle inequality.

On unit vectors the straight-line distance is a metric and ``2 - 2 * cosine`` its square, so the
nearest vectors are those of the largest cosine. A vantage point splits vectors at the median of
their distances to it; a branch whose vectors are all farther from a query than ``bound`` need not
be visited where ``factor * bound`` exceeds the query's k-th distance so far. Factor one prunes
only what cannot hold a nearer vector, so the search is exact; a larger factor prunes more.

1. Copies of a vector are one row with the ``k + 1`` least of their ids.
2. A tree over a sample of at most some ``SAMPLE`` vectors cuts the space into regions; every
   vector is filed in its region. Regions above ``SHARD_ROWS`` are dealt out over several shards.
3. Each query vector is searched in its own region, which gives it a first k-th distance, and then
   in all regions that the relaxed bounds leave. Each shard builds its own tree and answers blocks
   of at most ``QUERY_ROWS`` queries.
4. A query's lists meet; every score is computed from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hexatlas.llm.base import query, table
from hexatlas.llm.vectors import finite, matrix, width_of
from hexatlas.session import written

K = 5
#: Pruning of the registered query; 1 is exact. Measured recall: README.
FACTOR = 1.5
SAMPLE = 16_384
REGIONS = 4_096
SHARD_ROWS = 8_192
QUERY_ROWS = 32_768
LEAF = 128
#: Entries held beyond the k + 1 wanted, so that rounding of distances settles no tie.
SPARE = 8
SLACK = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by a power of two so that no square overflows."""
    scaled = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision, summed in component order."""
    a, b = (np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0.0))[1][:, None]) for m in (a, b))
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for i in range(a.shape[1]):
        dot, aa, bb = dot + a[:, i] * b[:, i], aa + a[:, i] * a[:, i], bb + b[:, i] * b[:, i]
    return dot / np.sqrt(aa * bb)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class VantageTree:
    """A vantage-point tree over unit vectors.

    ``tight`` keeps the range of distances seen in each branch; without it a branch is known by
    the split alone, which also holds for vectors that were not there when the tree was built.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, tight: bool = True):
        self.points, self.leaf, self.tight = points, max(1, leaf), tight
        self.leaves: list[np.ndarray] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) > self.leaf:
            vantage = self._vantage(rows)
            d = distances(self.points[rows], self.points[vantage][None])[:, 0]
            radius = float(np.median(d))
            inside = d <= radius
            if not inside.all():
                near, far = ((float(s.min()), float(s.max())) for s in (d[inside], d[~inside])) \
                    if self.tight else ((0.0, radius), (radius, 2.0))
                return ("split", vantage, radius, near, far, self._build(rows[inside]), self._build(rows[~inside]))
        self.leaves.append(rows)
        return ("leaf", len(self.leaves) - 1)

    def _vantage(self, rows: np.ndarray) -> int:
        """Of a few spread rows the one whose distances to others differ most."""
        some = rows[np.linspace(0, len(rows) - 1, min(len(rows), 8)).astype(int)]
        others = rows[np.linspace(0, len(rows) - 1, min(len(rows), 64)).astype(int)]
        return int(some[distances(self.points[some], self.points[others]).std(axis=1).argmax()])

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row belongs to."""
        out = np.zeros(len(rows), np.int32)
        pending = [(self.root, np.arange(len(rows)))]
        while pending:
            node, at = pending.pop()
            if node[0] == "leaf":
                out[at] = node[1]
            elif len(at):
                inside = distances(rows[at], self.points[node[1]][None])[:, 0] <= node[2]
                pending += [(node[5], at[inside]), (node[6], at[~inside])]
        return out

    def _bounds(self, node: tuple, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.maximum(0.0, np.maximum(low - d, d - high)) for low, high in node[3:5])

    def reach(self, rows: np.ndarray, limit: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` pairs that the relaxed bounds leave for each row's limit."""
        found = []
        pending = [(self.root, np.arange(len(rows)))]
        while pending:
            node, at = pending.pop()
            if node[0] == "leaf":
                found.append((at, np.full(len(at), node[1], np.int32)))
            elif len(at):
                d = distances(rows[at], self.points[node[1]][None])[:, 0]
                for bound, child in zip(self._bounds(node, d), node[5:7]):
                    pending.append((child, at[factor * bound <= limit[at] + SLACK]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def nearest(self, rows: np.ndarray, k: int, factor: float = 1.0, limit: np.ndarray | None = None,
                spare: int = SPARE) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest points of each row and up to ``spare`` more, with their distances.

        Missing entries have index -1. ``limit`` is a distance beyond which nothing is wanted.
        """
        held = k + spare
        best = np.full((len(rows), held), np.inf)
        index = np.full((len(rows), held), -1, np.int64)
        limit = np.full(len(rows), np.inf) if limit is None else limit.copy()

        def visit(node: tuple, at: np.ndarray, bound: np.ndarray) -> None:
            live = factor * bound <= limit[at] + SLACK
            at, bound = at[live], bound[live]
            if not len(at):
                return
            if node[0] == "leaf":
                members = self.leaves[node[1]]
                d = np.concatenate([best[at], distances(rows[at], self.points[members])], axis=1)
                i = np.concatenate([index[at], np.broadcast_to(members, (len(at), len(members)))], axis=1)
                first = np.argpartition(d, held - 1, axis=1)[:, :held]
                d, i = np.take_along_axis(d, first, 1), np.take_along_axis(i, first, 1)
                order = np.argsort(d, axis=1, kind="stable")
                best[at], index[at] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
                limit[at] = np.minimum(limit[at], best[at, k - 1])
                return
            d = distances(rows[at], self.points[node[1]][None])[:, 0]
            near, far = (np.maximum(bound, b) for b in self._bounds(node, d))
            first = d <= node[2]
            # each row visits the branch it lies in first: that lowers its limit for the other
            visit(node[5], at[first], near[first])
            visit(node[6], at[~first], far[~first])
            visit(node[6], at[first], far[first])
            visit(node[5], at[~first], near[~first])

        if len(rows) and len(self.points):
            visit(self.root, np.arange(len(rows)), np.zeros(len(rows)))
        return best, index


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``k1, k2, vector, ids``: each vector once, with the ``keep`` least ids that have it.

    Copies are cut to ``keep`` before they are shuffled to their vector, so a vector that a third
    of all rows share is no large group. A vector is known by a 128-bit hash.
    """
    once = rows.groupBy("k1", "k2", "vec_id").agg(F.any_value("vector").alias("vector"))
    first = once.withColumn("_at", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(
        F.col("_at") <= keep)
    return first.groupBy("k1", "k2").agg(F.any_value("vector").alias("vector"), F.sort_array(
        F.collect_list("vec_id")).alias("ids"))


def _filed(vectors: DataFrame, tree: VantageTree, width: int) -> DataFrame:
    """Vectors with the region that they belong to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region = tree.route(unit(matrix(b.column("vector"), width)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region)], names=[*b.schema.names, "region"])

    return vectors.mapInArrow(run, "k1 long, k2 long, vector array<double>, ids array<long>, region int")


def _reached(asked: DataFrame, tree: VantageTree, width: int, factor: float) -> DataFrame:
    """A row per query vector and other region that may hold a nearer vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = b.column("region").to_numpy(zero_copy_only=False)
            limit = b.column("reach").to_numpy(zero_copy_only=False)
            at, region = tree.reach(unit(matrix(b.column("vector"), width)), limit, factor)
            other = region != home[at]
            rows = b.take(pa.array(at[other]))
            yield rows.set_column(rows.schema.get_field_index("region"), "region", pa.array(region[other]))

    return asked.mapInArrow(run, asked.schema)


_ANSWER = "k1 long, k2 long, vec_id long, same boolean, score double"


def _searched(filed: DataFrame, asked: DataFrame, parts: dict[int, int], width: int, k: int, factor: float,
              shard_rows: int, query_rows: int) -> DataFrame:
    """The ``k`` best rows of every shard for each query vector sent to its region.

    ``parts`` has each region's number of vectors. Vectors are repeated for a further block of
    queries only where a region is asked more than ``query_rows`` times.
    """
    spark = filed.sparkSession
    blocks = {r["region"]: -(-r["n"] // query_rows) for r in asked.groupBy("region").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    # one row a region: REGIONS bounds them
    plan = F.broadcast(spark.createDataFrame(
        [(r, max(1, -(-parts.get(r, 0) // shard_rows)), n) for r, n in blocks.items()],
        "region int, shards int, blocks int"))
    shards = filed.join(plan, "region").select(
        "region", F.pmod("k1", F.col("shards")).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "k1", "k2", "vector", "ids")
    queries = asked.join(plan, "region").select(
        "region", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod("k2", F.col("blocks")).cast("int").alias("block"), "k1", "k2", "vector", "reach")

    def answer(points: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["k1", "k2", "vec_id", "same", "score"]
        if not len(points) or not len(wanted):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64())], names)
        have, ask = matrix(points["vector"], width), matrix(wanted["vector"], width)
        _, index = VantageTree(unit(have)).nearest(unit(ask), k, factor, wanted["reach"].to_numpy())
        q, at = np.nonzero(index >= 0)
        v = index[q, at]
        score = cosine(ask[q], have[v])
        ids = points["ids"].combine_chunks()
        count, flat = ids.value_lengths().to_numpy()[v], ids.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])[v]
        each = np.repeat(np.arange(len(q)), count)
        vec_id = flat[starts[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)]
        order = np.lexsort((vec_id, -score[each], q[each]))
        sorted_q = q[each][order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
        order = order[rank < k]
        pick, query_at = v[each][order], q[each][order]
        keys = [wanted[c].to_numpy() for c in ("k1", "k2")]
        same = np.logical_and(*(points[c].to_numpy()[pick] == key[query_at] for c, key in zip(("k1", "k2"), keys)))
        return pa.table([pa.array(x) for x in (*(key[query_at] for key in keys), vec_id[order], same, score[each][order])], names)

    key = ["region", "shard", "block"]
    return shards.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(answer, _ANSWER)


def _lists(answers: DataFrame, k: int) -> DataFrame:
    """``k1, k2, best``: the best ``k`` answers of each query vector, nearest first."""
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    first = answers.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k)
    return first.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(
        F.struct("_at", "vec_id", "same", "score"))).alias("best"))


def search(vectors: DataFrame, k: int = K, factor: float = FACTOR, every: int = 50, id_column: str = "vec_id",
           vector_column: str = "embedding", sample: int = SAMPLE, shard_rows: int = SHARD_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the
    query's own. Ties go to the smaller id. All candidates are returned where there are fewer.

    Vectors that are null, zero or hold a null or non-finite component take no part, and rows
    of a null id neither, as there is nothing to name them by. Repeated rows (equal id and
    vector) count once; other vectors of an id are rows of their own. A shorter vector counts
    as filled up with zeros. Other columns are ignored; an empty table gives an empty one.
    """
    if factor < 1 or k < 1:
        raise ValueError("the factor is one at least, and so is the number of neighbours")
    vector = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda c: c != 0.0))
    rows = rows.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")})
    known = written(distinct_vectors(rows, k + 1), "vantage-vectors")
    width, total = width_of(known, "vector"), known.count()
    share = min(1.0, sample / max(1, total))
    sampled = known.where(F.pmod("k2", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) or 1)).select("k1", "vector")
    seen = sampled.orderBy("k1").toArrow()
    points = unit(matrix(seen["vector"], width)) if len(seen) else np.zeros((0, width))
    regions = min(REGIONS, max(1, -(-total // shard_rows)))
    tree = VantageTree(points, leaf=-(-len(points) // regions), tight=False)
    filed = written(_filed(known, tree, width), "vantage-regions")
    parts = {r["region"]: r["n"] for r in filed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}

    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", "k1", "k2").distinct()
    asked = written(filed.join(asking.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select(
        "region", "k1", "k2", "vector", F.lit(float("inf")).alias("reach")), "vantage-queries")
    args = (parts, width, k + 1, float(factor), shard_rows, query_rows)
    answers = written(_searched(filed, asked, *args), "vantage-home")
    if len(tree.leaves) > 1:
        square = 2.0 - 2.0 * F.get("best", F.lit(k))["score"]
        known_reach = _lists(answers, k + 1).select(
            "k1", "k2", F.sqrt(F.when(square > 0.0, square).when(square <= 0.0, 0.0)).alias("_reach"))
        limited = asked.drop("reach").join(known_reach, ["k1", "k2"], "left").select(
            "region", "k1", "k2", "vector", F.coalesce("_reach", F.lit(float("inf"))).alias("reach"))
        further = written(_reached(limited, tree, width, float(factor)), "vantage-further")
        answers = answers.unionByName(written(_searched(filed, further, *args), "vantage-others"))
    best = _lists(answers, k + 1)
    own = asking.join(best, ["k1", "k2"]).select(
        F.col("vec_id").alias("query_id"),
        F.expr(f"slice(filter(best, b -> not (b.same and b.vec_id = vec_id)), 1, {int(k)})").alias("best"))
    return own.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")


#: The same nearest rows by brute force.
NEAREST_SQL = f"""
WITH ok AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id OR q.v <> c.v WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""


@query("op11_vantage", NEAREST_SQL)
def vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
