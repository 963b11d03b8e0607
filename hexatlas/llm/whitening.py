"""Embedding whitening: blockwise QR of the centred rows, then a bidiagonal qd solver.

Components become whole numbers (``floor(256 * c)``), so counts and sums are exact. The fit list
is each distinct whole vector once. Tasks reduce their centred rows to triangles block by block;
triangles meet in rounds of ``FAN``, so no task holds more than ``FAN`` of them and the covariance
is never formed. The driver gets one triangle of width x width, whose singular values and right
vectors (:mod:`hexatlas.llm.qd`) are those of all centred rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.llm.base import query, table
from hexatlas.llm.qd import EPS, right_singular
from hexatlas.llm.vectors import finite, matrix, width_of
from hexatlas.session import written

COMPONENTS = 4
STEP = 256
FAN = 32


@dataclass
class Whitening:
    """A fitted whitening: ``directions`` (width x components) are unit eigenvectors."""
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    trace: float
    directions: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) @ self.directions / np.sqrt(self.eigenvalues)


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, x``: the rows that remain, with whole components of equal number."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"),
                          F.col(vector_column).cast("array<double>").alias("v")).where(finite(F.col("v")))
    whole = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(STEP)))).alias("x"))
    width = width_of(whole, "x")
    return whole.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), width, np.int64)
            if np.abs(x.astype(np.float64)).max(initial=0.0) * len(x) >= 2.0 ** 62:
                x = x.astype(object)
            total = [Decimal(int(s)) for s in x.sum(axis=0)]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(-1, width), pa.int32()),
                pa.array([Decimal(len(x)), *total], pa.decimal128(38, 0))], names=["at", "s"])

    found = {r["at"]: int(r["s"]) for r in fit.select("x").mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(
        F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangle(fit: DataFrame, mean: np.ndarray, fan: int = FAN) -> np.ndarray:
    """R of the centred rows, with as many rows as columns."""
    width = len(mean)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            r = _triangle(np.concatenate([r, matrix(b.column("x"), width) - mean]))
        if len(r):
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.reshape(-1)])], names=["part", "r"])

    def merged(t: pa.Table) -> pa.Table:
        r = _triangle(t.column("r").combine_chunks().flatten().to_numpy().reshape(-1, width))
        return pa.table({"part": pa.array([t["part"][0].as_py() // fan], pa.int32()), "r": pa.array([r.reshape(-1)])})

    schema = "part int, r array<double>"
    now = written(fit.select("x").mapInArrow(blocks, schema), "whitening-triangles")
    last = now.agg(F.max("part")).first()[0]
    while last:
        now = written(now.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merged, schema), "whitening-triangles")
        last //= fan
    r = np.array(now.first()["r"]).reshape(-1, width)
    return np.concatenate([r, np.zeros((width - len(r), width))])


def fitted(fit: DataFrame, components: int = COMPONENTS, fan: int = FAN) -> Whitening | None:
    """Whitening of distinct whole vectors ``x``; None where there is nothing to fit.

    Directions without variance (to rounding) are left out: they cannot be scaled to one.
    """
    width = width_of(fit, "x")
    n, sums = _sums(fit, width)
    if not n or not width:
        return None
    mean = np.array([s / n for s in sums])
    r = triangle(fit, mean, fan)
    values, directions = right_singular(r, min(components, width))
    used = int((values[:components] > width * EPS * max(values[0], np.abs(mean).max() * n ** 0.5)).sum())
    directions = directions[:, :used]
    # either sign will do: the largest entry is made positive
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(used)])
    model = Whitening(n, sums, values[:used] ** 2 / n, float((r * r).sum()) / n, directions)
    if used:
        model.identity_error = _identity_error(fit, model)
    return model


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    width, k = model.directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = model.apply(matrix(b.column("x"), width))
            sums = np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["at", "s"])

    found = {r["at"]: r["s"] for r in fit.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(
        F.sum("s").alias("s")).collect()}
    mean = np.array([found[i] for i in range(k)]) / model.n
    both = np.array([found[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(both - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component. ``deviation`` is null where a long cannot hold it."""
    width, k = model.directions.shape
    sums, explained = model.sums, model.eigenvalues / model.trace

    def deviation(x: np.ndarray) -> pa.Array:
        most = int(np.abs(x.astype(np.float64)).max(initial=0.0)) * model.n + max(map(abs, sums))
        whole = np.int64 if width * most * most < 2 ** 62 else object
        off = x.astype(whole) * model.n - np.array(sums, dtype=whole)
        total = (off * off).sum(axis=1)
        return pa.array([int(t) if t < 2 ** 63 else None for t in total], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), width, np.int64)
            m, each = len(x), pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), deviation(x).take(each),
                pa.array(model.apply(x.astype(np.float64)).reshape(-1)), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, model.identity_error))], names=_NAMES)

    return rows.select("vec_id", "x").mapInArrow(run, _SCHEMA)


_NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """Whitened coordinates of every row with a finite vector, up to ``components`` a row.

    Null vectors and those with a null or non-finite component are dropped; zero and empty
    vectors stay. A shorter vector counts as filled up with zeros; whole components saturate at
    the range of a long. Repeated rows and rows of a null id are returned as they come, and
    count once in the fit. Components without variance are not returned, so equal vectors and an
    empty table give no rows. Other columns are ignored.
    """
    rows = written(whole_vectors(vectors, id_column, vector_column), "whitening-rows")
    model = fitted(written(rows.select("x").distinct(), "whitening-fit"), components)
    if model is None or not model.directions.shape[1]:
        return rows.sparkSession.createDataFrame([], _SCHEMA)
    return whitened(rows, model)


@query("op13_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
