"""Quality by ordinal regression on graded ratings: one hashed-text score, ordered thresholds.

``P(grade > k) = sigmoid(w . x - t_k)`` with weights shared by all grades and ``t_0 < t_1 < ...``.
The features of a text are hashed into a fixed number of buckets: pairs of neighbouring bytes,
words, and how repetitive and how wordy the text is. Ratings of a bounded, documented sample of
documents are fitted on the driver (``SAMPLE`` rows of about 4 KB); every row is scored, in one
pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hexatlas.llm.base import aside, query, table

#: Rated documents that the model is fitted on at most.
SAMPLE = 8000
PAIRS, WORDS, TRAITS = 2048, 2048, 64
WIDTH = PAIRS + WORDS + TRAITS
_PIECE = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text; null is the empty text, which has traits alone."""
    raw = (text or "").encode("utf-8", "replace")
    x = np.zeros(WIDTH, dtype=np.float64)
    data = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, len(data) - 1, _PIECE):
        part = data[at:at + _PIECE + 1].astype(np.uint32)
        hashed = ((part[:-1] * np.uint32(256) + part[1:]) * np.uint32(2654435761)) >> np.uint32(21)
        x[:PAIRS] += np.bincount(hashed, minlength=PAIRS)
    words = raw.split()
    counts = Counter(words)
    for w, n in counts.items():
        x[PAIRS + zlib.crc32(w) % WORDS] += n
    for block in (slice(0, PAIRS), slice(PAIRS, PAIRS + WORDS)):
        total = x[block].sum()
        if total:
            x[block] = np.sqrt(x[block] / total)
    traits = PAIRS + WORDS
    n = len(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    x[traits + min(15, int(16 * repeats / max(1, n)))] = 1
    x[traits + 16 + min(15, int(16 * pairs / max(1, n - 1)))] = 1
    x[traits + 32 + min(15, int(np.log2(n + 1)))] = 1
    x[traits + 48 + min(15, int(len(raw) / max(1, n)))] = 1
    return x


@dataclass(frozen=True)
class Ordinal:
    """Weights, and thresholds in ascending order: one less than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for each row of ``x`` and each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -60, 60)))


def fit(x: np.ndarray, grades: np.ndarray, n_grades: int, ridge: float = 1e-4, steps: int = 300,
        rate: float = 0.1) -> Ordinal:
    """Maximum likelihood by full-batch Adam; the same input gives the same model.

    Without rows the model has zero weights and evenly spaced thresholds.
    """
    d, k = x.shape[1], n_grades - 1
    # thresholds are the first one and the logarithms of the gaps
    p = np.concatenate([np.zeros(d), [-(k - 1) / 2], np.zeros(k - 1)])
    if len(x):
        m, v, n = np.zeros_like(p), np.zeros_like(p), len(x)
        for step in range(1, steps + 1):
            t = p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1:]))])
            # products in the features' own precision: a float32 matrix is not copied at every step
            score = (x @ p[:d].astype(x.dtype)).astype(np.float64)
            tail = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -60, 60)))
            full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
            rows = np.arange(n)
            likely = np.maximum(full[rows, grades] - full[rows, grades + 1], 1e-9)
            slope = full * (1 - full)
            # of log P(grade) by the score and by each threshold
            by_score = (slope[rows, grades] - slope[rows, grades + 1]) / likely
            by_t = np.zeros((n, k))
            upper, lower = grades < k, grades > 0
            by_t[rows[upper], grades[upper]] += slope[rows[upper], grades[upper] + 1] / likely[upper]
            by_t[rows[lower], grades[lower] - 1] -= slope[rows[lower], grades[lower]] / likely[lower]
            down = by_t.sum(0) / n
            gaps = np.array([down[j + 1:].sum() * np.exp(p[d + 1 + j]) for j in range(k - 1)])
            g = -np.concatenate([(by_score.astype(x.dtype) @ x) / n - ridge * p[:d], [down.sum()], gaps])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Ordinal(p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1:]))]))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE) -> Ordinal:
    """Fit on the documents rated in ``ratings`` (``doc_id, grade`` from 0; the least if repeated).

    The sample is that of the ``sample`` smallest hashes of rated ids, so it depends on ids
    alone. Null ids and grades, and grades out of range, are not learned from.
    """
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("doc_id").agg(
        F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [np.nonzero(x)[0].astype(np.uint16).tobytes() + x[x != 0].astype(np.float32).tobytes()
                    for x in map(features, b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["grade"], "x": kept})

    got = rows.select("doc_id", "grade", "text").mapInPandas(run, "doc_id long, grade int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"], kind="stable").drop_duplicates("doc_id")
    x = np.zeros((len(got), WIDTH), dtype=np.float32)
    for i, packed in enumerate(got["x"]):
        n = len(packed) // 6
        x[i, np.frombuffer(packed, np.uint16, n)] = np.frombuffer(packed, np.float32, n, 2 * n)
    return fit(x, got["grade"].to_numpy(dtype=np.int64), n_grades)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tails`` (``P(grade > k)`` for each k from 0).

    Columns of these names are replaced; all others, the text included, go through as they are.
    """
    kept = [c for c in docs.columns if c not in ("expected_grade", "tails")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # one text at a time is decoded beside the batch
            tails = [model.tails(features(t.as_py())[None, :])[0] for t in b.column(kept.index("text"))]
            grades = pa.array([float(t.sum()) for t in tails], pa.float64())
            lists = pa.array([t.tolist() for t in tails], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, grades, lists], [*kept, "expected_grade", "tails"])

    out = T.StructType([*[docs.schema[c] for c in kept], T.StructField("expected_grade", T.DoubleType()),
                        T.StructField("tails", T.ArrayType(T.DoubleType()))])
    return docs.select(*kept).mapInArrow(run, out)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from two marks: 0 bad, 1 good but toxic, 2 good. A null mark counts as zero."""
    good, toxic = F.coalesce("quality", F.lit(0)) > 0, F.coalesce("toxic", F.lit(0)) > 0
    return labels.select("doc_id", F.when(~good, 0).when(toxic, 1).otherwise(2).alias("grade"))


GRADES = 3
#: A document is kept if its grade is more likely above the lowest than not.
KEEP = 0.5


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, expected_grade, p_above_0, p_above_1, keep`` for every row of ``docs``."""
    model = train(docs, ratings_of(labels), GRADES)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).drop("text")
    return scored.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_above_0"),
                         F.col("tails")[1].alias("p_above_1"), (F.col("tails")[0] >= KEEP).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose grade is more likely above the lowest than not, as they were."""
    model = train(docs, ratings_of(labels), GRADES)
    return aside(docs, ["text"], lambda plain: score(plain, model).where(F.col("tails")[0] >= KEEP).drop("expected_grade", "tails"))


@query("op9_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
