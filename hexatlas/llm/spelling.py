"""Spelling variants: words one edit apart, through a dictionary of trie-node pairs.

The vocabulary is sorted and its trie numbered: a word brings a new node for every prefix that
the word before it does not share, so nodes are numbered by running sums over sorted words, part
by part. The same is done with the words reversed. A word cut at a place is then a pair of whole
numbers (prefix node, suffix node), and

* a word with the character after the cut skipped equals the pair of the word without it: the two
  differ by one insertion;
* two words with equal pairs after skipping one character each differ by one replacement.

Pairs meet by equality and are exact. A pair has one whole word at most and one skipping word per
character of the alphabet, so its members are ranked within the pair, and no pairs of words are
written out. Of a run of equal characters only the first is skipped for insertions, since skipping
any of them gives the same word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.llm.base import query, table
from hexatlas.session import written

LETTERS = "[A-Za-zÀ-ÿ]+"
MISSPELT = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form is at least so many times as frequent as the word.
TIMES = 2
#: Words numbered by one task.
PART_WORDS = 100_000
#: Different words that a task holds before it passes their counts on.
HELD = 200_000

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def misspelt(run: str, seed: int) -> str:
    """The lower-cased run, without one character where ``MISSPELT`` divides its crc32."""
    h = zlib.crc32(run.encode("utf-8", "surrogatepass"), seed)
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _frame(**columns: list) -> pd.DataFrame:
    """Columns as Python objects: strings that pandas keeps in Arrow chunks may not go back as one array."""
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})


def word_counts(docs: DataFrame, id_column: str = "doc_id", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words of all texts with at least ``least_length`` characters and ``least_count`` places.

    Null and empty texts have none; a null id counts as the empty text. Each task adds its
    documents up before the shuffle.
    """
    runs = re.compile(LETTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                seed = zlib.crc32(f"{doc_id or ''}:".encode())
                seen: dict[str, str] = {}
                for found in runs.findall(text or ""):
                    word = seen.get(found)
                    if word is None:
                        word = seen[found] = misspelt(found.translate(_LOWER), seed)
                    if len(word) >= least_length:
                        counts[word] = counts.get(word, 0) + 1
                if len(counts) > HELD:
                    yield _frame(word=list(counts), n=list(counts.values()))
                    counts = {}
        yield _frame(word=list(counts), n=list(counts.values()))

    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _paths(words: list[str]) -> Iterator[list[int]]:
    """Node numbers of each word's prefixes, for sorted words, counted from 0."""
    path, before, fresh = [], "", 0
    for word in words:
        kept = _shared(before, word)
        path = path[:kept] + list(range(fresh, fresh + len(word) - kept))
        fresh, before = fresh + len(word) - kept, word
        yield path


def _offsets(ends: list) -> dict[int, tuple[int, int, list[int]]]:
    """Of each part: how far its numbers move, its first rank, and the nodes that its first word takes over.

    A part numbers all nodes of its first word anew; those that it shares with the last word of
    the part before are that word's nodes.
    """
    moved, node, rank, last, last_path = {}, 0, 0, "", []
    for e in sorted(ends, key=lambda r: r["part"]):
        taken = last_path[:_shared(last, e["first"])]
        moved[e["part"]] = (node, rank, taken)
        last, last_path = e["last"], [taken[p] if p < len(taken) else node + p for p in e["path"]]
        node, rank = node + e["nodes"], rank + e["words"]
    return moved


def trie_paths(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``word, rank, path, starts``: each word's place in code-point order, the trie nodes of its
    prefixes, and for each character whether it differs from the one before.

    ``words`` has distinct, non-null words. They are dealt out by ranges; the driver sees two
    words and one path of each range, from which it works out how the ranges' numbers go on.
    """
    parts = max(1, -(-words.count() // part_words))
    dealt = written(words.select("word").repartitionByRange(parts, "word").select(
        F.spark_partition_id().alias("part"), "word"), "trie-words")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        listed = sorted(group["word"])
        path, nodes = [], 0
        for path in _paths(listed):
            nodes = max(nodes, path[-1] + 1)
        return _frame(part=[int(group["part"].iloc[0])], first=[listed[0]], last=[listed[-1]], path=[path],
                      nodes=[nodes], words=[len(listed)])

    moved = _offsets(dealt.groupBy("part").applyInPandas(
        ends, "part int, first string, last string, path array<long>, nodes long, words long").collect())

    def numbered(group: pd.DataFrame) -> pd.DataFrame:
        node, rank, taken = moved[int(group["part"].iloc[0])]
        listed = sorted(group["word"])
        paths = [[taken[p] if p < len(taken) else node + p for p in path] for path in _paths(listed)]
        starts = [[c != before for before, c in zip(chain([""], word), word)] for word in listed]
        return _frame(word=listed, rank=list(range(rank, rank + len(listed))), path=paths, starts=starts)

    return dealt.groupBy("part").applyInPandas(numbered, "word string, rank long, path array<long>, starts array<boolean>")


def node_pairs(words: DataFrame, part_words: int = PART_WORDS) -> tuple[DataFrame, DataFrame]:
    """``word, id, n`` and ``id, n, p, s, whole, first``: the words by rank, and their pairs.

    ``whole`` pairs cut the word, the others skip a character, the ``first`` of its run or not.
    The root of a trie is -1.
    """
    forward = trie_paths(words, part_words)
    backward = trie_paths(words.select(F.reverse("word").alias("word")), part_words).select(
        F.reverse("word").alias("word"), F.col("path").alias("back"))
    both = written(words.join(forward, "word").join(backward, "word").select(
        "word", F.col("rank").alias("id"), "n", "path", "starts", "back"), "trie-nodes")
    root = F.array(F.lit(-1).cast("long"))
    at = both.select("id", "n", F.concat(root, "path").alias("p"),
                     F.reverse(F.concat(root, "back")).alias("s"), "starts")
    cuts = at.select("id", "n", F.explode(F.arrays_zip("p", "s")).alias("c")).select(
        "id", "n", "c.p", "c.s", F.lit(True).alias("whole"), F.lit(False).alias("first"))
    skips = at.select("id", "n", F.explode(F.arrays_zip(
        F.expr("slice(p, 1, size(p) - 1)").alias("p"), F.expr("slice(s, 2, size(s) - 1)").alias("s"),
        F.col("starts"))).alias("c")).select(
        "id", "n", "c.p", "c.s", F.lit(False).alias("whole"), F.col("c.starts").alias("first"))
    return both.select("word", "id", "n"), cuts.union(skips)


def neighbours(pairs: DataFrame) -> DataFrame:
    """``id, n_near, near``: how many words are one edit away, and ``(-n, id)`` of the most frequent.

    Ties go to the least id. Words without any have no row. Members of a pair are bounded by
    the alphabet: one whole word, and one skipping word for each character.
    """
    member = F.struct((-F.col("n")).alias("m"), "id", "first")
    met = pairs.groupBy("p", "s").agg(
        F.count(F.lit(1)).alias("_c"), F.max(F.when(F.col("whole"), F.struct((-F.col("n")).alias("m"), "id"))).alias("w"),
        F.sort_array(F.collect_list(F.when(~F.col("whole"), member))).alias("k")).where(F.col("_c") > 1)
    # what a whole word sees: those that skip the first of a run
    seen = met.where("w IS NOT NULL").selectExpr("w", "filter(k, x -> x.first) as f").where("size(f) > 0").selectExpr(
        "w.id as id", "cast(size(f) as bigint) as c", "named_struct('m', f[0].m, 'id', f[0].id) as near")
    # what a skipping word sees: the others that skip here, and the whole word
    each = met.where("size(k) > 0").selectExpr("explode(k) as x", "k", "w").selectExpr(
        "x.id as id", "cast(size(k) - 1 as bigint) + if(x.first and w is not null, 1L, 0L) as c",
        "if(x.first, w, null) as w", "get(k, if(k[0].id = x.id, 1, 0)) as o").where("c > 0").selectExpr(
        "id", "c", "least(w, if(o is null, null, named_struct('m', o.m, 'id', o.id))) as near")
    return seen.union(each).groupBy("id").agg(F.sum("c").alias("n_near"), F.min("near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` from ``id, form`` (null: none), by doubling: each round halves what is left of a chain."""
    now = written(forms.where("form IS NOT NULL").select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        after = written(now.join(further, "root", "left").select(
            "id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if not after.where("_moved").take(1):
            return forms.join(after.select("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        now = after.drop("_moved")


def variants(docs: DataFrame, id_column: str = "doc_id", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, times: int = TIMES, part_words: int = PART_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts.

    A word's form is its near word (one character inserted, deleted or replaced) of the largest
    count, the first in code-point order among equals, where that count is ``times`` the word's
    own at least; the root is the last word along the forms, and the word itself without any.

    Null and empty texts have no words, repeated rows count as often as they come, words and texts
    may have any length, other columns are ignored, and an empty table gives an empty one.
    """
    words = written(word_counts(docs, id_column, least_length, least_count), "spelling-words")
    known, pairs = node_pairs(words, part_words)
    near = written(neighbours(pairs), "spelling-near")
    counted = known.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("near.m") >= F.col("n") * times, F.col("near.id")).alias("form"))
    formed = written(counted, "spelling-forms")
    named = known.select(F.col("id").alias("_id"), F.col("word").alias("_word"), F.col("n").alias("_n"))
    rooted = formed.join(roots(formed.select("id", "form")), "id")
    with_form = rooted.join(named, F.col("form") == F.col("_id"), "left").select(
        "word", F.col("_word").alias("form"), "root", "n", "n_near", F.col("_n").alias("form_n"))
    return with_form.join(named.drop("_n"), F.col("root") == F.col("_id")).select(
        "word", "form", F.col("_word").alias("root"), "n", "n_near", "form_n")


@query("op12_spelling")
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
