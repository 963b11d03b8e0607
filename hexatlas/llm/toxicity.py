"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic text.

The ordinary dictionary holds the segments that most ordinary documents have; the toxic one
holds these and, nearest to the text, the segments that toxic documents have significantly more
often (a likelihood-ratio test on document counts). A text is cut into windows of whole words.
A window's distance is what the toxic dictionary saves over the ordinary one, in compressed
bytes. The document's score is a logistic function of how its windows' distances lie, calibrated
on labelled documents set aside from the dictionaries' training, so that 0.5 is the likelier side.

Fitting uses a bounded sample of labelled documents (``SAMPLE`` of each kind); segments are
counted and windows measured on the executors, and only the dictionaries (20 KB) and six figures
a document reach the driver. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexatlas.llm.base import crc_fold, query, table
from hexatlas.session import written

#: Documents of each kind that the dictionaries and thresholds are learned from at most.
SAMPLE = 3000
WINDOW = 48
TOXIC_BYTES, ORDINARY_BYTES = 4096, 16384
LEVEL = 3
#: Least likelihood ratio (twice the logarithm) of a toxic segment, and the growths by toxic
#: document that are tried: a segment has to be typical of many, not only of some copies.
LEAST_RATIO, RATIOS_PER_DOCUMENT = 12.0, (1 / 15, 1 / 8, 1 / 5, 1 / 3)
#: One document of so many is set aside to choose that growth and to calibrate the score.
ASIDE = 3
SHORTEST, LONGEST, LONGEST_WORD = 4, 9, 24
#: Least bytes of the pieces of a longer run, as scripts without spaces have them.
PIECES = (6, 9)
FIGURES = 8


def _plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def pieces(run: bytes) -> set[bytes]:
    """The distinct pieces of a run of 6 and of 9 bytes, or the fewest more that end a character,
    from each of its characters on."""
    at = [i for i, c in enumerate(run) if c & 0xC0 != 0x80] + [len(run)]
    found = set()
    for least in PIECES:
        end = 0
        for begin in at[:-1]:
            while end < len(at) - 1 and at[end] < begin + least:
                end += 1
            if at[end] >= begin + least:
                found.add(run[begin:at[end]])
    return found


def segments(text: str | None) -> set[bytes]:
    """The distinct words of a text and their beginnings of 4 to 9 bytes, after a space.

    Of a run of more than 24 bytes without a space the first 24 are its word, and its pieces
    stand for the whole of it.
    """
    found = set()
    for w in set(_plain(text).split()):
        if len(w) > LONGEST_WORD:
            found |= pieces(w)
            w = w[:LONGEST_WORD]
        found.add(b" " + w)
        for k in range(SHORTEST, min(len(w), LONGEST + 1)):
            found.add(b" " + w[:k])
    return found


def windows(raw: bytes, width: int = WINDOW) -> list[bytes]:
    """Consecutive windows of whole words, of about ``width`` bytes, that cover the text.

    A run of more than twice the width without a space is cut where the width ends. The empty
    text is one empty window.
    """
    cut, at, n = [], 0, len(raw)
    while n - at > width:
        end = raw.find(b" ", at + width, at + 2 * width)
        end = end if end > 0 else min(at + 2 * width, n)
        cut.append(raw[at:end])
        at = end
    if at < n or not cut:
        cut.append(raw[at:])
    return cut


@dataclass
class Model:
    """The two dictionaries' contents and the calibrated weights of the figures."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FIGURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(FIGURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FIGURES + 1))

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def one(content: bytes) -> zstandard.ZstdCompressor:
            found = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            found.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_content_size=False,
                                            write_checksum=False, write_dict_id=False)
        return one(self.ordinary), one(self.ordinary + self.toxic)

    def score(self, figures: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((figures - self.mean) / self.spread) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def figures(text: str | None, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """How the distances of a text's windows lie: the largest ones, shares, mean and count."""
    cut = windows(_plain(text))
    a, b = ordinary.compress, toxic.compress
    d = np.fromiter((len(a(w)) - len(b(w)) for w in cut), dtype=np.float64, count=len(cut))
    top = np.zeros(3)
    best = np.sort(np.partition(d, -3)[-3:] if len(d) > 3 else d)[::-1]
    top[:len(best)] = best
    return np.array([top[0], top[1], top[2], top[0] / math.sqrt(len(d)), math.log(len(d)),
                     (d >= 2).mean(), (d >= 4).mean(), d.mean()])


def _ratio(a: Column, b: Column, na: int, nb: int) -> Column:
    """Twice the log likelihood ratio that a share of ``a`` of ``na`` exceeds ``b`` of ``nb``."""
    def ll(k: Column, n: int, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (F.lit(n) - k) * F.log(1 - p)).otherwise(0.0)

    pa, pb, p = a / F.lit(na), b / F.lit(nb), (a + b) / F.lit(na + nb)
    return F.when(pa > pb, 2 * (ll(a, na, pa) + ll(b, nb, pb) - ll(a, na, p) - ll(b, nb, p))).otherwise(0.0)


def _packed(ordered: list[bytes], size: int) -> bytes:
    """Segments, the first nearest to the text; one held by a longer one before it is left out."""
    chosen, held, total = [], b"", 0
    for s in ordered:
        if s in held:
            continue
        if total + len(s) > size:
            break
        chosen.append(s)
        held += s
        total += len(s)
    return b"".join(reversed(chosen))


def _counted(rows: DataFrame) -> DataFrame:
    """``segment, a, b``: toxic and ordinary documents that hold each segment."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at:at + 200]
                counts = (Counter(), Counter())
                for text, toxic in zip(part["text"], part["toxic"]):
                    counts[0 if toxic else 1].update(segments(text))
                keys = list(counts[0].keys() | counts[1].keys())
                yield pd.DataFrame({"segment": keys, "a": [counts[0][k] for k in keys], "b": [counts[1][k] for k in keys]})

    each = rows.select("text", "toxic").mapInPandas(run, "segment binary, a long, b long")
    return each.groupBy("segment").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _measured(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """``rows`` without their text, with ``figures``."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ordinary, toxic = model.compressors()
        for b in batches:
            yield b[kept].assign(figures=[figures(t, ordinary, toxic) for t in b["text"]])

    return rows.mapInPandas(run, keep + ", figures array<double>")


def _calibrated(model: Model, x: np.ndarray, y: np.ndarray, share: float) -> Model:
    """Weighted logistic regression by Newton's method; ``share``: of toxic rows among all labelled."""
    if not len(x) or y.min() == y.max():
        # one kind alone was seen: that is the likelier side for every text
        model.weights[0] = 0.0 if not len(x) else math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return model
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    a = np.concatenate([np.ones((len(x), 1)), (x - model.mean) / model.spread], axis=1)
    each = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, ridge = np.zeros(a.shape[1]), 1e-2 * np.eye(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        slope = a.T @ (each * (p - y)) + ridge @ w
        step = np.linalg.solve((a * (each * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, slope)
        w = w - np.clip(step, -3, 3)
    model.weights = w
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (``doc_id, toxic``; the greater mark if an id is marked twice).

    Of each kind the ``sample`` ids of the smallest hash are learned from. Null ids and marks
    teach nothing. Without toxic (or ordinary) documents the score is the same for all texts.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("toxic").orderBy(*order).limit(sample).union(marks.where("not toxic").orderBy(*order).limit(sample))
    rows = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id"), "toxicity")
    aside = F.pmod(F.hash("doc_id"), F.lit(ASIDE)) == 0
    learned, kept_aside = rows.where(~aside), rows.where(aside)
    count = {r["toxic"]: r["count"] for r in learned.groupBy("toxic").count().collect()}
    every = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    na, nb = count.get(True, 0), count.get(False, 0)
    if not na or not nb:
        return _calibrated(Model(b"", b""), np.zeros((na + nb, FIGURES)), np.array([1] * na + [0] * nb), 0.5)
    seen = written(_counted(learned).where((F.col("a") + F.col("b")) > 2), "toxicity-segments")
    rated = seen.withColumn("ratio", _ratio(F.col("a"), F.col("b"), na, nb)).where(F.col("ratio") >= LEAST_RATIO)
    # a segment takes five bytes at least, so these limits fill the dictionaries
    toxic = rated.orderBy(F.desc("ratio"), F.desc(F.octet_length("segment")), "segment").limit(TOXIC_BYTES).collect()
    ordinary = seen.where("b > 0").orderBy(F.desc("b"), "segment").limit(ORDINARY_BYTES).collect()
    common = _packed([bytes(r["segment"]) for r in ordinary], ORDINARY_BYTES)
    best = None
    for growth in RATIOS_PER_DOCUMENT:
        chosen = [bytes(r["segment"]) for r in toxic if r["ratio"] >= growth * na]
        got = _measured(kept_aside.select("toxic", "text"), Model(common, _packed(chosen, TOXIC_BYTES)), "toxic boolean").collect()
        x = np.array([r["figures"] for r in got]).reshape(-1, FIGURES)
        y = np.array([1 if r["toxic"] else 0 for r in got])
        model = _calibrated(Model(common, _packed(chosen, TOXIC_BYTES)), x, y, every[True] / (every[True] + every[False]))
        p = np.clip(model.score(x), 1e-6, 1 - 1e-6)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs`` (null text: empty); equal texts score alike."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ordinary, toxic = model.compressors()
        for b in batches:
            x = np.array([figures(t, ordinary, toxic) for t in b["text"]]).reshape(-1, FIGURES)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": model.score(x)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(run, "doc_id long, score double")


FOLDS = 5


@query("op8_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_fold(F.col("doc_id"), FOLDS) != 0))
    return score(docs, model).select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
