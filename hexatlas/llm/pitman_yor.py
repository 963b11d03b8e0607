"""Language-model scoring with a hierarchical Pitman-Yor model sampled by Gibbs.

Every word is a context with a restaurant of its own; all share one parent, the restaurant of
single words, whose parent is the uniform distribution over the known words and one unknown.
A customer is a training token. Tables of a context are customers of the parent. A sweep draws
the tables of each (context, word) by seating its customers one after the other, given
everything else; predictive probabilities are averaged over the sampled seatings.

Nothing of the model is ever in one place. Documents are packed into blocks, and a block keeps
its tokens as numbers into its own vocabulary. What a block knows of a pair or word (its count,
its tables) goes to the bucket of the pair's or word's hash, which adds up all blocks' shares and
answers each block in its own order. Hashes are uniform, so no frequent context is a hot bucket.
Of the blocks that hold a pair one is its owner and reports its tables to the parent. All blocks
draw a pair's tables from the same hash-driven numbers, so they need not tell each other.
Block and bucket sizes are bounded; the number of both grows with the corpus.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.llm.base import crc_fold, query, table
from hexatlas.session import scratch_path, written

FOLDS = 10
SWEEPS = 2
BLOCK_BYTES = 16 << 20
KEYS_PER_BUCKET = 2_000_000
STRENGTH = 1.0
#: Customers seated one by one; later ones are seated in runs that grow with their number.
SINGLY = 64
_U = np.uint64
_END = 0x5851F42D4C957F2D

MESSAGE = "block long, kind string, bucket int, a binary, b binary, n0 double, n1 double, n2 double"
_COLUMNS = [c.split()[0] for c in MESSAGE.split(", ")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _unit(keys: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys and salts alone."""
    salt = xxhash.xxh64_intdigest(repr(salts).encode())
    return ((_mix(keys ^ _U(salt)) >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _squeezed(a: np.ndarray) -> bytes:
    """An array as bytes: like bytes of all numbers side by side, under zstandard."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def _spread(b: bytes, kind: str) -> np.ndarray:
    dtype = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def _keys_to(sorted_keys: np.ndarray) -> bytes:
    return _squeezed(np.diff(sorted_keys, prepend=_U(0)))


def _keys_from(b: bytes) -> np.ndarray:
    return np.cumsum(_spread(b, "u8"), dtype=_U)


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The count at which a Poisson distribution of a small mean passes ``u``."""
    term = np.exp(-mean)
    below, drawn = term.copy(), np.zeros(len(mean))
    for k in range(1, 40):
        drawn += u > below
        term = term * mean / k
        below += term
    return drawn


def tables(keys: np.ndarray, counts: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float,
           strength: float, sweep: int) -> np.ndarray:
    """Tables that ``counts`` customers of one dish take, drawn by seating them one after another.

    ``others``: tables of the same restaurant that serve other dishes; ``parent``: the dish's
    probability in the parent. Customers after the first ``SINGLY`` are seated in runs of an
    eighth of those before them, with the number of new tables of a run drawn at once.
    """
    t = (counts > 0).astype(np.float64)
    live = np.flatnonzero(counts > 1)
    if not len(live):
        return t
    k, c, o, p = keys[live], counts[live], strength + discount * others[live], parent[live]
    seated, now = 1, t[live]
    while True:
        run = 1 if seated < SINGLY else seated // 8
        left = c > seated
        if not left.all():
            t[live] = now
            live, k, c, o, p, now = (x[left] for x in (live, k, c, o, p, now))
        if not len(live):
            return t
        new = (o + discount * now) * p
        share = new / (new + np.maximum(seated + (run - 1) / 2 - discount * now, 1e-12))
        u = _unit(k, sweep, seated)
        if run == 1:
            now = now + (u < share)
        else:
            many = np.minimum(run, c - seated)
            mean = many * share
            drawn = np.where(mean < 5, _poisson(mean, u), np.rint(
                mean + np.sqrt(mean * (1 - share)) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _unit(k, sweep, seated, 1))))
            now = now + np.clip(drawn, 0, many)
        seated += run


@dataclass(frozen=True)
class Totals:
    """Figures of the whole model that every block needs; a handful of numbers."""

    tokens: float = 0.0
    words: float = 0.0
    discount: float = 0.5
    root_discount: float = 0.5
    customers: float = 0.0
    root_tables: float = 0.0

    @property
    def uniform(self) -> float:
        return 1.0 / (self.words + 1.0)

    def parent(self, customers: np.ndarray, root_tables: np.ndarray) -> np.ndarray:
        """Predictive probability of words in the restaurant of single words."""
        new = (STRENGTH + self.root_discount * self.root_tables) * self.uniform
        return (np.maximum(customers - self.root_discount * root_tables, 0) + new) / (STRENGTH + self.customers)


def _discount(once: float, twice: float) -> float:
    """The discount at which as many dishes are seen once and twice as were, kept off 0 and 1."""
    return float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.05, 0.95))


class Block:
    """A block's documents: tokens as numbers into its words, number 0 being the end of a text."""

    def __init__(self, payload: bytes):
        (self.ids, self.held, self.lengths, sequence, self.hashes) = pickle.loads(
            zstandard.ZstdDecompressor().decompress(payload))
        self.sequence = sequence.astype(np.int64)
        ends = np.cumsum(self.lengths)
        self.doc = np.repeat(np.arange(len(ends)), self.lengths)
        self.before = np.concatenate([[0], self.sequence[:-1]]) if len(self.sequence) else self.sequence
        self.trains = ~self.held[self.doc]
        # the token before a text's first one is the end of another text: number 0 as well
        codes, self.pair = np.unique((self.before << 32) | self.sequence, return_inverse=True)
        self.context, self.word = codes >> 32, codes & 0xFFFFFFFF
        keys = _mix(_mix(self.hashes[self.context]) * _U(0x9E3779B97F4A7C15) + self.hashes[self.word])
        self.pair_order = np.argsort(keys)
        self.pair_keys = keys
        self.word_order = np.argsort(self.hashes)

    def messages(self, block: int, kind: str, bits: int, values: list[np.ndarray]) -> Iterator[tuple]:
        """Keys and values of all pairs (``b``) or words, to the buckets of the keys' first bits."""
        keys, order = (self.pair_keys, self.pair_order) if kind == "b" else (self.hashes, self.word_order)
        keys = keys[order]
        bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
        at = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        for i in range(1 << bits):
            if at[i] < at[i + 1]:
                part = order[at[i]:at[i + 1]]
                packed = b"".join(_framed(_squeezed(v[part].astype(np.uint32))) for v in values)
                yield block, kind, i, _keys_to(keys[at[i]:at[i + 1]]), packed, 0.0, 0.0, 0.0

    def placed(self, answers: pd.DataFrame, kind: str, n: int) -> list[np.ndarray]:
        """The buckets' answers of one kind, ``n`` numbers each, in the order of the block's own numbers."""
        order = self.pair_order if kind == "b" else self.word_order
        own = answers.sort_values("bucket")
        out = []
        for column in zip(*(_unframed(a) for a in own["a"])):
            values = np.zeros(len(order))
            values[order] = np.concatenate([_spread(x, "u4") for x in column])
            out.append(values)
        return out if out else [np.zeros(len(order)) for _ in range(n)]


def _framed(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + b


def _unframed(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at:at + 8], "little")
        out.append(b[at + 8:at + 8 + n])
        at += 8 + n
    return out


def blocks(docs: DataFrame, held_out: str) -> DataFrame:
    """``block, payload, n_tokens``: documents (``doc_id, text`` and a flag) packed by the task.

    A block ends when it holds ``BLOCK_BYTES`` of text. The table is written before it is used,
    so that a task that runs again cannot deal documents to blocks differently.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = 0
        words: dict[bytes, int] = {}
        ids, held, lengths, sequence, size = [], [], [], [], 0

        def close() -> pd.DataFrame:
            hashes = np.array([_END, *(xxhash.xxh3_64_intdigest(w) for w in words)], dtype=_U)
            tokens = np.concatenate(sequence)
            payload = pickle.dumps((ids, np.array(held, dtype=bool), np.array(lengths, dtype=np.int64), tokens, hashes))
            return pd.DataFrame({"block": [(TaskContext.get().partitionId() << 24) + made],
                                 "payload": [zstandard.ZstdCompressor(level=3).compress(payload)], "n_tokens": [len(tokens)]})

        for b in batches:
            for doc_id, text, flag in zip(b["doc_id"], b["text"], b["held"]):
                raw = (text or "").encode("utf-8", "surrogatepass").lower()
                own = [words.setdefault(w, len(words) + 1) for w in raw.split()]
                own.append(0)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                held.append(bool(flag))
                lengths.append(len(own))
                sequence.append(np.array(own, dtype=np.uint32))
                size += len(raw) + 16
                if size >= BLOCK_BYTES:
                    yield close()
                    made, size = made + 1, 0
                    words, ids, held, lengths, sequence = {}, [], [], [], []
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col(held_out).alias("held"))
    return rows.mapInPandas(run, "block long, payload binary, n_tokens long")


def _bucketed(df: DataFrame, label: str) -> DataFrame:
    """A table bucketed by block, so that later meetings of blocks and answers move answers only."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, "block").option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def _answered(messages: DataFrame, then: Callable[[str, np.ndarray, list[np.ndarray]], tuple]) -> DataFrame:
    """Add up what all blocks say of each key and answer every block in the order it asked.

    ``then(kind, keys, sums)`` gives the numbers to answer with and three figures to be summed
    over all keys. Pairs get one number more: 1 for the block that owns the pair.
    """
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        kind, bucket = rows["kind"].iloc[0], rows["bucket"].iloc[0]
        asked = [_keys_from(a) for a in rows["a"]]
        said = [[_spread(x, "u4") for x in _unframed(b)] for b in rows["b"]]
        keys, first, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate(column), minlength=len(keys)) for column in zip(*said)]
        numbers, figures = then(kind, keys, sums)
        owned = np.zeros(len(at), dtype=np.uint32)
        owned[first] = 1
        out, start = [], 0
        for block, own in zip(rows["block"], asked):
            part = slice(start, start + len(own))
            start += len(own)
            answer = [n[at[part]].astype(np.uint32) for n in numbers] + ([owned[part]] if kind == "b" else [])
            out.append((block, kind, bucket, b"".join(_framed(_squeezed(x)) for x in answer), b"", *figures))
            figures = (0.0, 0.0, 0.0)
        return pd.DataFrame(out, columns=_COLUMNS)

    return messages.groupBy("kind", "bucket").applyInPandas(reduce, MESSAGE)


def _figures(df: DataFrame) -> dict[str, tuple[float, float, float]]:
    rows = df.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n2")]).collect()
    return {r["kind"]: (r["n0"], r["n1"], r["n2"]) for r in rows}


def _once_twice(x: np.ndarray) -> tuple[float, float]:
    return float((x == 1).sum()), float((x == 2).sum())


class Model:
    """A fitted model: the blocks it was fitted on, with what each needs to score its documents."""

    def __init__(self, docs: DataFrame, held_out: str, sweeps: int = SWEEPS):
        self.sweeps = sweeps
        self.blocks = _bucketed(blocks(docs, held_out), "blocks")
        n = self.blocks.agg(F.sum("n_tokens")).first()[0] or 0
        bits = max(0, int(np.ceil(np.log2(max(1, n / KEYS_PER_BUCKET)))))
        self.counts = self._counts(bits)
        figures = _figures(self.counts)
        tokens, words, _ = figures.get("w", (0.0, 0.0, 0.0))
        self.totals = [Totals(tokens, words, _discount(*figures.get("b", (0.0, 0.0, 0.0))[:2]))]
        self.states: list[DataFrame] = []
        self.answers: list[DataFrame] = []
        for sweep in range(sweeps + 1):
            state = written(self._swept(sweep, bits), f"state-{sweep}")
            last = self.totals[-1]

            def seat(kind: str, keys: np.ndarray, sums: list[np.ndarray], sweep=sweep, last=last) -> tuple:
                context_tables, customers = sums
                root = (customers > 0).astype(np.float64) if sweep == 0 else tables(
                    keys, customers, np.full(len(keys), max(last.root_tables - 1, 0)), np.full(len(keys), last.uniform),
                    last.root_discount, STRENGTH, -sweep)
                once, twice = _once_twice(customers)
                # the discount is read off the first seating; later ones give customers and tables
                return [context_tables, customers, root], (once, twice, 0.0) if sweep == 0 else (customers.sum(), root.sum(), 0.0)

            answer = written(_answered(state.where("kind = 'w'"), seat), f"answer-{sweep}")
            n0, n1, _ = _figures(answer).get("w", (0.0, 0.0, 0.0))
            if sweep == 0:
                customers = figures.get("b", (0.0, 0.0, 0.0))[2]
                self.totals.append(replace(last, root_discount=_discount(n0, n1), customers=customers, root_tables=words))
            else:
                self.totals.append(replace(last, customers=n0, root_tables=n1))
            self.states.append(state.where("kind = 's'"))
            self.answers.append(answer)

    def _counts(self, bits: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for block, payload in zip(b["block"], b["payload"]):
                    own = Block(payload)
                    pairs = np.bincount(own.pair[own.trains], minlength=len(own.pair_keys))
                    words = np.bincount(own.sequence[own.trains], minlength=len(own.hashes))
                    for kind, values in (("b", pairs), ("w", words)):
                        yield pd.DataFrame(list(own.messages(block, kind, bits, [values])), columns=_COLUMNS)

        def then(kind: str, keys: np.ndarray, sums: list[np.ndarray]) -> tuple:
            c = sums[0]
            if kind == "b":
                return [c], (*_once_twice(c), float((c > 0).sum()))
            return [c], (float(c.sum()), float((c > 0).sum()), 0.0)

        return _bucketed(_answered(self.blocks.select("block", "payload").mapInPandas(run, MESSAGE), then), "counts")

    def _met(self, run: Callable, schema: str, *more: DataFrame) -> DataFrame:
        """``run(Block, block number, answers)`` for each block and what came back for it."""
        back = self.counts.select(*_COLUMNS)
        for m in more:
            back = back.unionByName(m.select(*_COLUMNS))

        def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return run(Block(left["payload"].iloc[0]), int(left["block"].iloc[0]), right)

        return self.blocks.select("block", "payload").groupBy("block").cogroup(back.groupBy("block")).applyInPandas(both, schema)

    def _swept(self, sweep: int, bits: int) -> DataFrame:
        """Draw the tables of every pair; messages on words (their tables as context and customers
        as word) and the tables themselves as the block's state."""
        totals = self.totals[-1]

        def run(own: Block, block: int, back: pd.DataFrame) -> pd.DataFrame:
            count, owned = own.placed(back[back["kind"] == "b"], "b", 2)
            if sweep == 0:
                drawn = (count > 0).astype(np.float64)
            else:
                of_context, customers, root = own.placed(back[back["kind"] == "r"], "w", 3)
                state = back[back["kind"] == "s"]
                had = _spread(state["a"].iloc[0], "u4").astype(np.float64)
                parent = totals.parent(customers, root)
                drawn = tables(own.pair_keys, count, np.maximum(of_context[own.context] - had, 0), parent[own.word],
                               totals.discount, STRENGTH, sweep)
            mine = drawn * owned
            as_context = np.bincount(own.context, weights=mine, minlength=len(own.hashes))
            as_word = np.bincount(own.word, weights=mine, minlength=len(own.hashes))
            out = list(own.messages(block, "w", bits, [as_context, as_word]))
            out.append((block, "s", 0, _squeezed(drawn.astype(np.uint32)), b"", 0.0, 0.0, 0.0))
            return pd.DataFrame(out, columns=_COLUMNS)

        if sweep == 0:
            return self._met(run, MESSAGE)
        return self._met(run, MESSAGE, self.answers[-1].withColumn("kind", F.lit("r")), self.states[-1])

    def scores(self) -> DataFrame:
        """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document."""
        used = range(1, self.sweeps + 1)
        totals = [self.totals[s + 1] for s in used]
        base = self.totals[0]

        def run(own: Block, block: int, back: pd.DataFrame) -> pd.DataFrame:
            (count, _), (word_count,) = own.placed(back[back["kind"] == "b"], "b", 2), own.placed(back[back["kind"] == "w"], "w", 1)
            of_pair = np.zeros(len(own.pair_keys))
            seen = word_count[own.context]
            for s, t in zip(used, totals):
                of_context, customers, root = own.placed(back[back["kind"] == f"r{s}"], "w", 3)
                drawn = _spread(back[back["kind"] == f"s{s}"]["a"].iloc[0], "u4").astype(np.float64)
                parent = t.parent(customers, root)[own.word]
                new = (STRENGTH + t.discount * of_context[own.context]) * parent
                own_part = np.maximum(count - t.discount * drawn, 0)
                of_pair += np.where(seen > 0, (own_part + new) / (STRENGTH + seen), parent) / len(totals)
            score = np.bincount(own.doc, weights=np.log10(of_pair)[own.pair], minlength=len(own.ids))
            single = np.log10((word_count + 0.1) / (base.tokens + 0.1 * (base.words + 1)))
            plain = np.bincount(own.doc, weights=single[own.sequence], minlength=len(own.ids))
            known = np.bincount(own.doc, weights=(word_count > 0)[own.sequence], minlength=len(own.ids))
            return pd.DataFrame({"doc_id": pd.array(own.ids, dtype="Int64"), "held_out": own.held, "n_tokens": own.lengths,
                                 "n_known": known.astype(np.int64), "train_tokens": int(base.tokens), "base_score": plain,
                                 "score": score})

        more = [self.answers[s].withColumn("kind", F.lit(f"r{s}")) for s in used]
        more += [self.states[s].withColumn("kind", F.lit(f"s{s}")) for s in used]
        return self._met(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                              "base_score double, score double", *more)


def scored(docs: DataFrame, sweeps: int = SWEEPS, folds: int = FOLDS) -> DataFrame:
    """Score every row of ``docs``; those whose id's ``crc32 mod folds`` is 0 teach nothing.

    Null and empty texts are an end alone; repeated rows count, and are scored, as often as
    they come; a null id counts as the empty text in the fold. Extra columns are left out. An
    empty table gives an empty one.
    """
    flagged = docs.select("doc_id", "text", (crc_fold(F.col("doc_id"), folds) == 0).alias("held"))
    return Model(flagged, "held", sweeps).scores()


@query("op10_pitman_yor")
def pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
