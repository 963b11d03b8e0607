"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The first candidates are those of ``simhash``: texts whose fingerprints differ in two bits at most. They
are the closest copies, but not all pairs of 0.8, and a few of them are under 0.8, so the others are met as
well and all are verified. What is linked already is not compared again.

The others are met without loss. In any one order of all shingles, two sets of similarity 0.8
share a shingle among the first ``n - ceil(0.8 n) + 1`` of each. Shingles that are frequent in
a sample of the texts come last in the order, so what is met by is rare; the sample decides the
work, never the result. It is a fixed share of the texts, so that a shingle is frequent from the
same number of texts on whatever the size of the table, and groups do not grow with it.

A candidate pair is first held against the sets' parity sketches: bit ``i`` is the parity of the
number of shingles that fall on ``i``. Sketches differ in no more bits than the sets differ in
shingles, so a pair that differs in too many is excluded without a text being moved, and no pair
of 0.8 is lost. Fixed small sketches come first, then ones as wide as the sets ask for. What is
left is verified on the whole sets.

Of a group that shares a shingle, members are compared with one of them first: the one with the
fewest rare shingles, as those tell edits. Copies of one text are often further from each other
than from that text. Only pairs that these links leave in different components are compared after
that, so a group of copies that are near the least altered one does not cost the square of its size. Sets that share a run of shingles meet at the first of the
run only. Equal sets are one row here, whatever their number.

Texts are read once: those whose sets share a prefix shingle with another lie compressed in a table
bucketed by set, where every turn looks them up without moving the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from hexatlas.llm import simhash
from hexatlas.llm.base import Scratch, aside
from hexatlas.llm.components import components

SEED = 42
SHINGLE = 5
STARS = 2
#: One text in ``SHARE`` is sampled, and ``SAMPLE`` at least. Tasks are told of the ``MOST`` most frequent shingles (16 bytes each).
SHARE = 12
SAMPLE = 4000
MOST = 1_000_000
FREQUENT = 8
#: Longs of a sketch: 512 bits exclude unlike sets of up to about a thousand shingles.
LONGS = 8
SKETCH = [f"s{i}" for i in range(LONGS)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, no words none.

    Words are those of ``simhash.fingerprint``.
    """
    return _shingles((text or "").encode("utf-8", "surrogatepass"))


def _shingles(data: bytes) -> np.ndarray:
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of 0.8 or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * common >= 4 * (len(a) + len(b))


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``FREQUENT`` or more sampled texts, sorted, and how many have them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["text"]:
                yield pd.DataFrame({"h": shingles(text).view(np.int64)})

    texts = rows.select("text").sample(min(1.0, max(1 / SHARE, SAMPLE / max(rows.count(), 1))), SEED)
    found = texts.mapInPandas(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST).toPandas()
    hashes = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy(np.int64)[order]


def sketch(h: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """Parity of the number of shingles on each of ``64 * longs`` bits."""
    odd = np.bincount((h % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, key, n, s0.., fp, prefix, packed``: the shingle set's hash, size and sketch, the
    text's fingerprint, the set's first shingles, and the text's UTF-8 bytes under zstandard.

    A task gives the prefix and a text of equal sets once; their other rows have none.
    """
    frequent, counts = _frequent(rows)

    def prefix(h: np.ndarray) -> np.ndarray:
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
            h = h[np.lexsort((h, np.where(frequent[at] == h, counts[at], 0)))]
        return h[:len(h) - -(-4 * len(h) // 5) + 1].view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            out = []
            for doc_id, text_hash, text in zip(b["doc_id"], b["text_hash"], b["text"]):
                h = shingles(text)
                key = xxhash.xxh64_intdigest(h.tobytes(), SEED)
                key -= key >> 63 << 64
                own = (None, None) if key in seen else (prefix(h), pack((text or "").encode("utf-8", "surrogatepass")))
                fp = simhash.fingerprint(text)
                out.append((doc_id, text_hash, key, len(h), *sketch(h), fp - (fp >> 63 << 64), *own))
                seen.add(key)
            yield pd.DataFrame(out, columns=["doc_id", "text_hash", "key", "n", *SKETCH, "fp", "prefix", "packed"])

    # as text: pandas has no whole numbers beside nulls
    plain = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return plain.mapInPandas(run, "doc_id string, text_hash long, key long, n int, "
                             + "".join(f"{s} long, " for s in SKETCH) + "fp long, prefix array<long>, packed binary") \
        .withColumn("doc_id", F.col("doc_id").cast("long"))


def _sized(docs: DataFrame, id_column: str) -> DataFrame:
    """``doc_id, text_hash, text`` of ``docs``."""
    text = F.col("text").cast("string")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _possible(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose sizes and sketches do not exclude a similarity of 0.8.

    Sets of similarity 0.8 differ in at most a ninth of their sizes' sum.
    """
    def side(k: str) -> DataFrame:
        return keys.select(F.col("key").alias(k), F.col("n").alias(k + "n"), *[F.col(s).alias(k + s) for s in SKETCH])

    differing = sum((F.bit_count(F.col("a" + s).bitwiseXOR(F.col("b" + s))) for s in SKETCH), F.lit(0))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        (F.least("an", "bn") * 5 >= F.greatest("an", "bn") * 4) & (differing * 9 <= F.col("an") + F.col("bn"))).select("a", "b")


def _unpacked(packed: bytes) -> np.ndarray:
    """The shingles of a packed text."""
    return _shingles(zstandard.ZstdDecompressor().decompress(packed))


def wide_sketch(h: np.ndarray) -> np.ndarray:
    """A sketch of at least two bits a shingle; its length is a power of two."""
    return sketch(h, max(LONGS, 1 << max(2 * len(h) - 1, 0).bit_length() >> 6))


def differing_bits(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ; the wider one is folded to the other's length, which keeps parities."""
    small, large = sorted((a, b), key=len)
    folded = np.bitwise_xor.reduce(large.reshape(-1, len(small)), axis=0)
    return int(np.bitwise_count((folded ^ small).view(np.uint64)).sum())


def _closer(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` whose wide sketches do not exclude a similarity of 0.8."""
    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [_unpacked(t) for t in batch["packed"]]
            yield pd.DataFrame({"key": batch["key"], "n": [len(h) for h in sets], "w": [wide_sketch(h).tobytes() for h in sets]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [9 * differing_bits(np.frombuffer(v, np.int64), np.frombuffer(w, np.int64)) <= n
                    for v, w, n in zip(batch["v"], batch["w"], batch["n"])]
            yield batch.loc[near, ["a", "b"]]

    wide = scratch.written(texts.mapInPandas(widen, "key long, n long, w binary"), "near-wide")
    both = pairs.join(wide.select(F.col("key").alias("a"), F.col("n").alias("an"), F.col("w").alias("v")), "a") \
        .join(wide.select(F.col("key").alias("b"), F.col("n").alias("bn"), "w"), "b")
    found = scratch.written(both.select("a", "b", "v", "w", (F.col("an") + F.col("bn")).alias("n"))
                            .mapInPandas(run, "a long, b long"), "near-close")
    scratch.drop("near-wide")
    return found


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, alike`` for each pair of keys, by the whole sets of their ``texts`` (``key, packed``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            out = []
            for b, s, t in zip(batch["b"], batch["s"], batch["t"]):
                if b != last:
                    last, held = b, _unpacked(t)
                out.append(alike(_unpacked(s), held))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "alike": out})

    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("packed").alias("s")), "a")
    right = texts.join(pairs.select(F.col("b").alias("key")).distinct(), "key", "left_semi")
    both = left.join(right.select(F.col("key").alias("b"), F.col("packed").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInPandas(run, "a long, b long, alike boolean")


def _may_meet(n: Column, at: Column, m: Column, at2: Column, first: bool = False) -> Column:
    """Whether sets of ``n`` and ``m`` that share the shingles at these places can be alike.

    ``first``: if these are the first that they share. Sets that share earlier ones meet there
    too, so where all pairs meet, one that is alike passes where it shares its first.
    """
    most = F.least(n - at, m - at2) + (F.lit(0) if first else F.least(at, at2))
    return (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (most * 9 >= (n + m) * 4)


def _sorted_pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def all_pairs(posts: DataFrame) -> DataFrame:
    """``posts`` of one shingle met with each other, once a pair. Sets with the same shingle before this one meet at that."""
    other = posts.select("h", *[F.col(c).alias("other_" + c) for c in ("key", "n", "at", "before", "root")])
    return posts.join(other, "h").where(
        (F.col("key") > F.col("other_key")) & F.coalesce(F.col("before") != F.col("other_before"), F.lit(True)))


def by_fingerprint(prints: DataFrame) -> DataFrame:
    """``a, b`` (``a > b``): keys of ``prints`` (``key, fp``) to be compared, as their fingerprints are linked by ``simhash``.

    The least key of a fingerprint stands for it in links to others; the other ones are compared with that.
    """
    each = prints.groupBy("fp").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    same = prints.join(each.where(F.col("least") < F.col("most")), "fp").select("key", F.col("least").alias("other_key"))
    near = simhash.links(each.select("fp")) \
        .join(each.select(F.col("fp").alias("a"), F.col("least").alias("key")), "a") \
        .join(each.select(F.col("fp").alias("b"), F.col("least").alias("other_key")), "b").select("key", "other_key")
    return same.union(near).where(F.col("key") != F.col("other_key")).select(*_sorted_pair("key", "other_key")).distinct()


def _compared(pairs: DataFrame, tested: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``tested`` with the written ``pairs`` (``a, b``) added."""
    wanted = scratch.written(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "near-wanted")
    asked = scratch.written(texts.join(wanted, "key", "left_semi"), "near-asked")
    close = _closer(pairs, asked, scratch)
    far = pairs.join(close, ["a", "b"], "left_anti").withColumn("alike", F.lit(False))
    tested = scratch.written(tested.union(far).union(_verified(close, asked)), "near-tested")
    scratch.drop("near-asked", "near-wanted", "near-close")
    return tested


def links(texts: DataFrame, keys: DataFrame, posts: DataFrame, prints: DataFrame, scratch: Scratch,
          stars: int = STARS) -> DataFrame:
    """``node, root`` of the keys that are linked by a similarity of 0.8 or more.

    ``texts``: key, packed; bucketed by key. ``keys``: a row per key with n and its sketch. ``prints``: key, fp.
    ``posts``: key, n, at, h, and as ``before`` the prefix's shingle before ``h``.
    """
    spark = texts.sparkSession
    tested = spark.createDataFrame([], "a long, b long, alike boolean")
    roots = spark.createDataFrame([], "node long, root long")
    pairs = scratch.written(_possible(by_fingerprint(prints), keys), "near-pairs")
    for turn in range(-1, stars + 1):
        if turn >= 0:
            pairs = scratch.written(_met(posts, roots, turn, stars, keys).join(tested, ["a", "b"], "left_anti"), "near-pairs")
        if not pairs.isEmpty():
            tested = _compared(pairs, tested, texts, scratch)
            roots = components(tested.where("alike").select("a", "b"), "near-links")
        scratch.drop("near-pairs")
    return roots


def _met(posts: DataFrame, roots: DataFrame, turn: int, stars: int, keys: DataFrame) -> DataFrame:
    """``a, b``: pairs that share a shingle of ``posts``, are in different components and may be alike.

    Turns under ``stars`` compare the members of a shingle with one of them, the last turn with each other.
    """
    # members of a group that is one component already have nothing to be compared for
    now = posts.join(roots, F.col("key") == F.col("node"), "left").select(
        "h", "key", "n", "at", "before", F.coalesce("root", "key").alias("root"))
    # first the least altered copy, which most are near: rare shingles come first, and it has the fewest before this one
    order = ([F.col("at").alias("place")] if turn == 0 else []) + [F.xxhash64("key", F.lit(turn)).alias("o")]
    several = now.groupBy("h").agg(
        F.min("root").alias("r"), F.max("root").alias("q"),
        F.min(F.struct(*order, "key", "n", "at", "root")).alias("p")).where(F.col("r") < F.col("q"))
    if turn < stars:
        other = several.select("h", *[F.col("p." + c).alias("other_" + c) for c in ("key", "n", "at", "root")])
        met = now.join(other, "h")
    else:
        met = all_pairs(now.join(several.select("h"), "h"))
    pairs = met.where(F.col("root") != F.col("other_root")).where(
        _may_meet(F.col("n"), F.col("at"), F.col("other_n"), F.col("other_at"), first=turn == stars))
    return _possible(pairs.select(*_sorted_pair("key", "other_key")).distinct(), keys)


def _grouped(docs: DataFrame, id_column: str, stars: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, text_hash`` of every row, and ``key, first, root`` of every key.

    ``first`` is the key's document of the smallest id, then of the smallest hash of its text: ``none, doc_id, text_hash``,
    ``none`` where it has no id.
    """
    rows = _sized(docs, id_column)
    sets = scratch.written(_sets(rows), "near-sets")
    keys = scratch.written(sets.groupBy("key").agg(
        F.first("n").alias("n"), *[F.first(s).alias(s) for s in SKETCH],
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")), "near-keys")
    # dealt out by shingle once: counting and meeting both find their rows in place
    posts = sets.where(F.col("prefix").isNotNull()).select("key", "n", "prefix", F.posexplode("prefix").alias("at", "h")).select(
        "key", "n", "at", "h", F.get("prefix", F.col("at") - 1).alias("before")).repartition("h")
    shared = posts.groupBy("h").agg(F.min("key").alias("k"), F.max("key").alias("l")).where(F.col("k") < F.col("l")).select("h")
    posts = scratch.written(posts.join(shared, "h").distinct(), "near-shared")
    members = scratch.written(sets.select("doc_id", "key", "text_hash", "fp"), "near-members")
    texts = scratch.bucketed(sets.where(F.col("packed").isNotNull()).join(posts.select("key").distinct(), "key", "left_semi")
                             .select("key", "packed").dropDuplicates(["key"]), "key", "near-texts")
    scratch.drop("near-sets")
    roots = links(texts, keys, posts, members.select("key", "fp").distinct(), scratch, stars)
    scratch.drop("near-shared", "near-tested", "near-texts")
    least = scratch.written(keys.join(roots, F.col("key") == F.col("node"), "left").select(
        "key", "first", F.coalesce("root", "key").alias("root")), "near-least")
    scratch.drop("near-keys")
    return members.drop("fp"), least


def near_copies(docs: DataFrame, id_column: str = "doc_id", stars: int = STARS) -> DataFrame:
    """``doc_id, component_id, text_hash`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over near copies. Texts without words are copies of each other. A null id keeps its row and never names a
    component that has other ids. Texts may be of any length. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    members, least = _grouped(docs, id_column, stars, scratch)
    first = least.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = least.join(first, "root").select("key", "component_id")
    found = scratch.written(members.join(named, "key").select("doc_id", "component_id", "text_hash"), "near-found")
    scratch.drop("near-members", "near-least")
    return found


def kept(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest id.

    A document is an id and a text: rows that repeat both stay. Of several texts of that id in the group, and of a
    group without ids, the text of the smallest hash stays. Columns of any name are kept as they are.
    """
    return aside(docs, [id_column, "text"], lambda plain: _kept(plain, id_column))


def _kept(docs: DataFrame, id_column: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    _, least = _grouped(docs, id_column, STARS, scratch)
    named = scratch.written(least.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_keep"), F.col("first.text_hash").alias("_text")), "near-kept")
    scratch.drop("near-members", "near-least")
    text = F.xxhash64(F.col("text").cast("string"))
    return docs.join(named, F.col(id_column).eqNullSafe(F.col("_keep")) & text.eqNullSafe(F.col("_text")), "left_semi")
