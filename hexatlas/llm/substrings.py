"""Exact substring dedup: remove every byte covered by a 400-byte string that occurs twice.

The suffixes are bucketed and the buckets refined, after the bucket-pointer method, but only
where that can still change something:

1. *Initial buckets.* Each 100-byte gram has a bucket identifier, a rolling hash. Every window of
   400 bytes is filed at one suffix, that of its least gram (the leftmost of equal ones). Equal
   windows have the same least gram at the same place, so they meet in one initial bucket;
   about one suffix in 120 bytes is filed at all, with the run of windows that it stands for.
   Suffixes of one document with equal runs are one row: a text that repeats a word over and over
   has one suffix in each of its periods.
2. *Refinement by later offsets.* Within a bucket suffixes are grouped by the identifiers of the
   grams that follow, as far as their run of windows reaches. A bucket of one member is done:
   none of its windows repeats. Members that agree over the whole run are done: all repeat.
3. *Recursion.* Where a bucket falls apart, the runs are cut into cells of 16 windows and these
   grouped by the identifiers over what all their windows share, and over all they cover; then
   the cells that are still open into single windows. One member of each settled class goes
   along, so that an open one still finds it.

A window's identity is 128 bits made of four gram identifiers. Suffixes of all documents are
compared by hash keys alone. Buckets are counted before the shuffle; rows of a hot one are dealt
over salts, as many as its count asks for, so no hot bucket is gathered in one task. Texts
travel compressed, once, and only touched documents are read again, from a bucketed table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.llm.base import Scratch, aside, query, table
from hexatlas.session import written

LENGTH = 400
GRAM = 100
CELL = 16
#: A key is hot that more than one row in ``HOT_SHARE`` (and more than ``LEAST_HOT``) has: there
#: are never more than ``HOT_SHARE`` hot keys.
HOT_SHARE, LEAST_HOT = 4096, 1000
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits: a bijection whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of the hash base and of its inverse, as far as a chunk needs them."""

    def __init__(self, n: int):
        self.up, self.down = np.ones(n, dtype=_U), np.ones(n, dtype=_U)
        np.cumprod(np.full(n - 1, _BASE, dtype=_U), out=self.up[1:])
        np.cumprod(np.full(n - 1, pow(_BASE, -1, 1 << 64), dtype=_U), out=self.down[1:])


_powers: list[_Powers] = []


def gram_ids(data: bytes, gram: int = GRAM) -> np.ndarray:
    """Bucket identifier of the gram at each position of ``data`` (up to a chunk and its overlap)."""
    if not _powers:
        _powers.append(_Powers(_CHUNK + 4 * LENGTH))
    p, x = _powers[0], np.frombuffer(data, dtype=np.uint8).astype(_U) + _U(1)
    n = len(x)
    if n < gram:
        return np.zeros(0, dtype=_U)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(x * p.up[:n], out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * p.down[:n - gram + 1])


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least identifier (leftmost of equals) in each run of ``w`` of them.

    Identifier and position are packed into one number (the position's 20 bits are enough for a
    chunk), and the least of a run is the lesser of a block's suffix and the next one's prefix.
    """
    n = len(h)
    packed = (h & ~_U(0xFFFFF)) | np.arange(n, dtype=_U)
    k = -(-n // w)
    m = np.full(k * w, _U(2**64 - 1))
    m[:n] = packed
    m = m.reshape(k, w)
    prefix = np.minimum.accumulate(m, axis=1).ravel()
    suffix = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(suffix[:n - w + 1], prefix[w - 1:n]) & _U(0xFFFFF)).astype(np.int64)


def _key(h: np.ndarray, starts: np.ndarray, span: np.ndarray, reach: int, salt: int) -> np.ndarray:
    """64 bits for the bytes ``[start, start + span)``, from the identifiers of grams that cover them."""
    out = _mix(span.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(salt))
    for offset in range(0, reach, GRAM):
        at = starts + np.minimum(offset, span - GRAM)
        out = _mix(out ^ h[at])
    return _mix(out ^ h[starts + span - GRAM])


def _pair(h: np.ndarray, starts: np.ndarray, span: np.ndarray, reach: int) -> list[np.ndarray]:
    return [_key(h, starts, span, reach, salt).view(np.int64) for salt in (1, 2)]


def _chunks(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Offset and gram identifiers of each chunk of a text of 400 bytes or more."""
    for at in range(0, len(data) - LENGTH + 1, _CHUNK):
        yield at, gram_ids(data[at:at + _CHUNK + LENGTH - 1])


def filed(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per suffix that windows are filed at: its identifier, that of its whole run, and the run.

    A run is ``first * 1024 + (last - first)``, of the starts of its windows.
    """
    for at, h in _chunks(data):
        least = _least(h, LENGTH - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        whole = _key(h, first, last - first + LENGTH, 2 * LENGTH - GRAM, 3)
        yield h[least[first]].view(np.int64), whole.view(np.int64), (first + at) * 1024 + (last - first)


def _at(data: bytes, starts: np.ndarray, room: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Chunk by chunk: which ``starts`` lie in it, its offset, its identifiers with ``room`` around."""
    chunk = starts // _CHUNK
    for c in np.unique(chunk):
        begin = max(0, int(c) * _CHUNK - room)
        yield np.flatnonzero(chunk == c), begin, gram_ids(data[begin:int(c) * _CHUNK + _CHUNK + LENGTH + room])


def cells(data: bytes, runs: np.ndarray) -> list[np.ndarray]:
    """The cells of ``runs``: two keys of what a cell's windows share, two of what they cover, and
    the cell as ``first * 32 + (last - first)``.

    Cells lie at fixed distances from the suffix that the run is filed at, so that those of
    different documents compare. A cell that the run holds only in part covers nothing that
    could compare: its second pair of keys is zero.
    """
    first, last = runs // 1024, runs // 1024 + runs % 1024
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for idx, begin, h in _at(data, first, CELL):
        lo, hi = first[idx] - begin, last[idx] - begin
        anchor = np.array([a + _argmin(h[a:a + LENGTH - GRAM + 1]) for a in lo], dtype=np.int64)
        from_, to = (anchor - hi) // CELL, (anchor - lo) // CELL
        count = to - from_ + 1
        which = np.repeat(np.arange(len(lo)), count)
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + from_[which]
        near = anchor[which] - CELL * j  # the cell's last window, if the run reaches it
        far = near - (CELL - 1)
        s0, s1 = np.maximum(lo[which], far), np.minimum(hi[which], near)
        core = _pair(h, near, np.full(len(near), LENGTH - CELL + 1), LENGTH)
        full = (s0 == far) & (s1 == near)
        cover = [np.zeros(len(near), dtype=np.int64) for _ in range(2)]
        if full.any():
            for c, k in zip(cover, _pair(h, far[full], np.full(full.sum(), LENGTH + CELL - 1), LENGTH)):
                c[full] = k
        for o, v in zip(out, [*core, *cover, (s0 + begin) * 32 + (s1 - s0)]):
            o.append(v)
    return [np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in out]


def _argmin(h: np.ndarray) -> int:
    return int(np.argmin(h & ~_U(0xFFFFF)))


def single_windows(data: bytes, runs: np.ndarray) -> list[np.ndarray]:
    """Both keys and the start of each window in the cells ``runs``."""
    first, count = runs // 32, runs % 32 + 1
    starts = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    out: list[list[np.ndarray]] = [[], [], []]
    for idx, begin, h in _at(data, starts, 0):
        for o, v in zip(out, [*_pair(h, starts[idx] - begin, np.full(len(idx), LENGTH), LENGTH), starts[idx]]):
            o.append(v)
    return [np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in out]


def removed(data: bytes, firsts: np.ndarray, lasts: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs and what is left, given runs of repeated windows."""
    order = np.argsort(firsts, kind="stable")
    begin, end = firsts[order], np.maximum.accumulate(lasts[order] + LENGTH)
    fresh = np.concatenate([[True], begin[1:] > end[:-1]]) if len(begin) else np.zeros(0, dtype=bool)
    begins = begin[fresh]
    ends = end[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(end) - 1]])] if len(begin) else begin
    parts, at = [], 0
    for b, e in zip(begins.tolist(), ends.tolist()):
        parts.append(data[at:b])
        at = e
    parts.append(data[at:])
    left = b"".join(parts)
    return len(data) - len(left), len(begins), left


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _packed(docs: DataFrame) -> DataFrame:
    """``key, packed``: the text's UTF-8 bytes under zstandard."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "packed": [pack.compress(_raw(t)) for t in b["text"]]})
    return docs.select("key", "text").mapInPandas(run, "key long, packed binary")


def _unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def classes_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
    """``filed`` of a text, suffixes whose runs are equal taken together: identifiers, the first of the
    runs and, where there are several, the firsts and lasts of all; runs next to each other are one."""
    g, u, run = (np.concatenate(x) for x in zip(*filed(data)))
    if len(np.unique(u)) == len(u):
        return g, u, run, [None] * len(g), [None] * len(g)
    order = np.lexsort((run, u, g))
    g, u, run = g[order], u[order], run[order]
    first, last = run // 1024, run // 1024 + run % 1024
    begins = np.concatenate([[True], (g[1:] != g[:-1]) | (u[1:] != u[:-1])])
    apart = begins.copy()
    apart[1:] |= first[1:] > last[:-1] + 1
    at, parts = np.flatnonzero(begins), np.flatnonzero(apart)
    several = np.diff(np.append(at, len(g))) > 1
    cuts = np.searchsorted(parts, at[1:])
    spans = [np.split(x, cuts) for x in (first[parts], last[np.append(parts[1:], len(g)) - 1])]
    return g[at], u[at], run[at], *([x if many else None for x, many in zip(each, several)] for each in spans)


def _filed(docs: DataFrame) -> DataFrame:
    """``g, u, key, run, firsts, lasts`` for each class of filed suffixes in each document, as by ``classes_of``."""
    columns = ["g", "u", "run", "firsts", "lasts", "key"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        g, u, run, firsts, lasts, key = zip(*rows)
        return pd.DataFrame(dict(zip(columns, [*(np.concatenate(x) for x in (g, u, run)),
                                               *([v for each in x for v in each] for x in (firsts, lasts)),
                                               np.repeat(np.array(key, dtype=np.int64), [len(x) for x in g])])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for key, text in zip(b["key"], b["text"]):
                data = _raw(text)
                if len(data) >= LENGTH:
                    rows.append((*classes_of(data), key))
                    held += len(rows[-1][0])
                if held > 100_000:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)
    return docs.select("key", "text").mapInPandas(
        run, "g long, u long, run long, firsts array<long>, lasts array<long>, key long")


def _from_texts(texts: DataFrame, runs: DataFrame, cut, columns: list[str]) -> DataFrame:
    """``cut(bytes, runs)`` of each document of ``texts`` that has rows ``key, run`` in ``runs``."""
    listed = runs.groupBy("key").agg(F.collect_set("run").alias("runs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, packed, own in zip(b["key"], b["packed"], b["runs"]):
                values = cut(_unpacked(packed), np.sort(np.asarray(own, dtype=np.int64)))
                if len(values[0]):
                    yield pd.DataFrame(dict(zip(columns, values))).assign(key=key)

    schema = ", ".join(f"{c} long" for c in [*columns, "key"])
    return texts.join(listed, "key").select("key", "packed", "runs").mapInPandas(run, schema)


def _classes(rows: DataFrame, keys: list[str], label: str, scratch: Scratch | None = None, several: bool = False) -> DataFrame:
    """``keys, n, least``: how many rows agree (``several``: more than one), and the least document among them.

    Written to ``scratch``, or else to the shared folder.
    """
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    found = found.where("n > 1") if several else found
    return scratch.written(found, label) if scratch else written(found, label)


def _meet(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str], count: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts``, whose ``keys`` are unique and which tell how many rows have them.

    Rows of a hot key are dealt by ``by`` over as many salts as keep each below the limit, and
    the key's fact is sent to all of these. Both tables are written ones, as they are read twice.
    """
    limit = max(LEAST_HOT, rows.count() // HOT_SHARE)
    hot = F.col(count) > limit
    salts = F.ceil(F.col(count) / F.lit(limit)).cast("long")
    few = F.broadcast(facts.where(hot).select(*keys, salts.alias("_salts")))
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_salts")), F.lit(0).cast("long"))
    dealt = rows.join(few, keys, "left").withColumn("_salt", salt).drop("_salts")
    last = F.when(hot, salts - 1).otherwise(F.lit(0).cast("long"))
    sent = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.join(sent, [*keys, "_salt"], how).drop("_salt")


def spans_and_texts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``key, first, last`` of runs of repeated windows, and ``key, packed`` of documents with any.

    ``docs`` has ``key`` (of document and text) and ``text``. Tables of ``scratch`` that neither needs are dropped.
    """
    rows = scratch.written(_filed(docs), "suffixes")
    own = F.bool_or(F.col("firsts").isNotNull())  # repeated within a document
    twice = scratch.written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), own.alias("own")).where(
        (F.col("n") > 1) | F.col("own")).drop("own"), "suffix-buckets")
    shared = scratch.written(_meet(rows, twice, ["g"], ["key", "run"]).drop("n"), "suffixes-shared")
    scratch.drop("suffixes", "suffix-buckets")
    kinds = scratch.written(shared.groupBy("g", "u").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), own.alias("own")).select(
        "g", "u", "n", "least", (F.col("own") | (F.col("n") > 1)).alias("settled")), "suffix-classes")
    # a bucket whose classes are all settled has nothing open to find them
    apart = scratch.written(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or(~F.col("settled")).alias("apart")), "suffix-apart")
    judged_kinds = scratch.written(_meet(kinds, apart, ["g"], ["u"], "kinds").drop("kinds"), "suffix-kinds")
    found = scratch.written(_meet(shared, judged_kinds, ["g", "u"], ["key", "run"]).select(
        "key", "run", "firsts", "lasts", "settled",
        (F.col("apart") & (~F.col("settled") | (F.col("key") == F.col("least")))).alias("open")), "suffixes-found")
    scratch.drop("suffixes-shared", "suffix-classes", "suffix-apart", "suffix-kinds")

    touched = found.select("key").distinct()
    texts = scratch.bucketed(_packed(docs).join(touched, "key", "left_semi").dropDuplicates(["key"]), "key", "touched")

    cut = scratch.written(_from_texts(texts, found.where("open").select("key", "run"), cells, ["c1", "c2", "u1", "u2", "run"]),
                          "cells")
    alive = _classes(cut, ["c1", "c2"], "cell-cores", scratch, several=True).drop("least")
    living = scratch.written(_meet(cut, alive, ["c1", "c2"], ["key", "run"]).drop("n"), "cells-alive")
    scratch.drop("cells", "cell-cores")
    # cells that cover nothing comparable have the same keys: they are kept out of the join
    whole, partial = living.where(F.col("u1") != 0), living.where(F.col("u1") == 0)
    covers = _classes(whole, ["u1", "u2"], "cell-covers", scratch, several=True)
    judged = scratch.written(_meet(whole, covers, ["u1", "u2"], ["key", "run"], how="left").select(
        "key", "run", "c1", "c2", F.col("n").isNotNull().alias("settled"), (F.col("key") == F.col("least")).alias("first"))
        .union(partial.select("key", "run", "c1", "c2", F.lit(False), F.lit(None).cast("boolean"))), "cells-judged")
    scratch.drop("cells-alive", "cell-covers")
    lone = judged.where(~F.col("settled"))
    along = judged.where(F.col("settled") & F.col("first")).join(lone.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi")
    open_ = lone.select("key", "run").union(along.select("key", "run"))

    last = scratch.written(_from_texts(texts, open_, single_windows, ["k1", "k2", "start"]),
                           "windows")
    again = _classes(last, ["k1", "k2"], "window-classes", scratch, several=True).drop("least")
    single = _meet(last, again, ["k1", "k2"], ["key", "start"]).select(
        "key", F.col("start").alias("first"), F.col("start").alias("last"))

    def spans(judgement: DataFrame, unit: int) -> DataFrame:
        first = F.floor(F.col("run") / unit).cast("long")
        return judgement.where("settled").select("key", first.alias("first"), (first + F.pmod("run", F.lit(unit))).alias("last"))

    several = found.where("settled").select("key", F.explode(F.arrays_zip("firsts", "lasts")).alias("s")).select("key", "s.firsts", "s.lasts")
    return spans(found.where(F.col("firsts").isNull()), 1024).union(several).union(spans(judged, 32)).union(single), texts


def deduplicated(docs: DataFrame, id_column: str = "doc_id", with_text: bool = False) -> DataFrame:
    """``docs``'s ids with ``n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the rest).

    Null texts are empty; texts of under 400 bytes keep all. Matches never cross documents. All
    is judged on the input, so of two equal passages both go. Rows that repeat an id and a text
    are documents like any other, and so each other's copies. ``kept`` is decoded as UTF-8 with
    a replacement character for each broken sequence, as a removed run may part a character.
    An empty table gives an empty one.
    """
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("key", F.xxhash64("doc_id", "text"))
    scratch = Scratch(docs.sparkSession)
    spans, texts = spans_and_texts(keyed, scratch)
    # windows of one document that are next to each other need not be listed one by one
    listed = spans.groupBy("key").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, packed, firsts, lasts in zip(b["key"], b["packed"], b["firsts"], b["lasts"]):
                n, runs, left = removed(_unpacked(packed), np.asarray(firsts, dtype=np.int64), np.asarray(lasts, dtype=np.int64))
                out.append((key, n, runs, hashlib.sha256(left).hexdigest(),
                            left.decode("utf-8", "replace") if with_text else None))
            yield pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "sha", "kept"])

    changed = texts.join(listed, "key").select("key", "packed", "firsts", "lasts").mapInPandas(
        run, "key long, n_removed long, n_spans long, sha string, kept string")
    changed = scratch.written(changed, "removed").withColumnRenamed("key", "_key")
    scratch.drop(*[label for label in scratch.paths if label != "removed"])
    rows = keyed if with_text else keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"),
                                                F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    if with_text:
        rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn(
            "own", F.sha2(F.col("text").cast("binary"), 256))
    both = rows.join(changed, F.col("key") == F.col("_key"), "left")
    result = both.select("doc_id", "key", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                         F.coalesce("sha", "own").alias("kept_sha256"),
                         *([F.coalesce("kept", "text").alias("kept")] if with_text else []))
    return result


def without_repeats(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and ``n_chars``, if there is one, counted anew.

    A document of which nothing is left goes; one that had no text stays. Other columns, whatever
    their names, are kept.
    """
    return aside(docs, [id_column, "text", "n_chars"], lambda plain: _without_repeats(plain, id_column))


def _without_repeats(docs: DataFrame, id_column: str) -> DataFrame:
    found = deduplicated(docs.select(id_column, "text"), id_column, with_text=True)
    changed = found.where(F.col("n_removed") > 0).select(
        F.col("key").alias("_key"), F.col("kept").alias("_kept")).dropDuplicates(["_key"])
    keyed = docs.withColumn("_own", F.xxhash64(F.col(id_column), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    both = keyed.join(changed, F.col("_own") == F.col("_key"), "left").where(F.col("_kept").isNull() | (F.col("_kept") != ""))
    text = F.coalesce(F.col("_kept"), F.col("text"))
    counted = {"n_chars": F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.char_length("_kept"))} \
        if "n_chars" in docs.columns else {}
    return both.withColumns({**counted, "text": text}).select(
        *[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


@query("op7_substrings")
def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")
