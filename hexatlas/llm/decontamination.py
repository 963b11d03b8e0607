"""Benchmark decontamination through a positional inverted index.

The training texts are read once into postings ``(document, position, term)`` of the terms that
the benchmark uses; a term that no phrase holds is never looked up, so it has no list. Postings
stay beside their documents: no term's list, however common, is gathered anywhere. An end mark
after the last word keeps each document's length and makes every document part of the index.

A phrase is looked up from its rarest terms: their lists, shifted back by the term's offset in
the phrase, meet in the same start. Starts on which the rarest terms agree are then compared
with the document's words. No phrase is dropped for being common; it only has more postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hexatlas.llm.base import aside, ascii_lower, query, table
from hexatlas.session import written

#: A word: a run of anything but the ASCII characters outside a-z and 0-9, of lower-cased text.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH = 10
RAREST = 3
#: Lookup tables of up to so many rows (about 20 MB) are sent to every executor; larger are joined by shuffle.
SENT_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def row_key() -> Column:
    """Names a document by id and text, so that rows of equal id and different text stay apart."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


class Phrases:
    """The phrases of ``items`` (``item_id, text``) and what they consist of.

    A phrase is ``length`` consecutive words of an item; an item of fewer words, but not none,
    is one phrase. Items of equal words are one sequence. ``sequences``: seq, words. ``owners``:
    seq, item_id. ``phrases``: seq, first, offset, word, size (a row per word of each phrase).
    ``terms``: term, word, with the empty word as the end mark.
    """

    def __init__(self, items: DataFrame, length: int = LENGTH):
        listed = written(items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
                         .where(F.size("words") > 0), "items")
        self.sequences = written(listed.select("words").distinct().select(
            F.monotonically_increasing_id().alias("seq"), "words"), "sequences")
        self.owners = listed.join(self.sequences, "words").select("seq", "item_id").distinct()
        firsts = F.sequence(F.lit(0), F.greatest(F.size("words") - length, F.lit(0)))
        self.phrases = self.sequences.select("seq", "words", F.explode(firsts).alias("first")).select(
            "seq", "first", F.slice("words", F.col("first") + 1, F.lit(length)).alias("p")).select(
            "seq", "first", F.size("p").alias("size"), F.posexplode("p").alias("at", "word")).select(
            "seq", "first", "size", (F.col("first") + F.col("at")).alias("offset"), "word")
        used = self.sequences.select(F.explode("words").alias("word")).union(
            items.sparkSession.range(1).select(F.lit("").alias("word"))).distinct()
        self.terms = written(used.select(F.monotonically_increasing_id().alias("term"), "word"), "terms")


def build_index(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """``key, doc_id, pos, term, last``: postings of the phrases' terms, written to the shared folder.

    ``last`` marks the posting after a document's last word: its ``pos`` is the number of words.
    Only this posting carries ``doc_id``.
    """
    tokens = docs.select("doc_id", row_key().alias("key"),
                         F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "word"))
    known = tokens.join(_sent(phrases.terms), "word")
    last = F.col("word") == ""
    return written(known.select("key", F.when(last, F.col("doc_id")).alias("doc_id"), "pos", "term", last.alias("last")),
                   "postings")


def _rarest(index: DataFrame, phrases: Phrases, rarest: int) -> DataFrame:
    """``seq, first, size, offset, term, rank``: the rarest terms of each phrase."""
    often = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = phrases.phrases.join(phrases.terms, "word").join(often, "term", "left")
    order = Window.partitionBy("seq", "first").orderBy(F.coalesce("n", F.lit(0)), "offset")
    return written(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rarest).select(
        "seq", "first", "size", "offset", "term", "rank"), "rarest")


def _bit(offset: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(offset, F.lit(64)).cast("int"))


def _candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """``key, seq, start, first, size``: places at which all of a phrase's rarest terms stand.

    Lists are met by the place at which the whole sequence would start, so a posting is one row
    for all phrases that look it up. Which offsets were met is a set of 64 bits, offsets that
    are 64 words apart sharing one: that can only let more places through to be compared.
    """
    lookups = rare.select("term", "seq", "offset").distinct()
    shifted = index.where(~F.col("last")).select("key", "pos", "term").join(_sent(lookups), "term").select(
        "key", "seq", (F.col("pos") - F.col("offset")).alias("start"), _bit(F.col("offset")).alias("bit"))
    met = shifted.groupBy("key", "seq", "start").agg(F.bit_or("bit").alias("met"))
    asked = rare.groupBy("seq", "first", "size").agg(F.bit_or(_bit(F.col("offset"))).alias("all"))
    sets = asked.groupBy("seq").agg(F.collect_list(F.struct("first", "size", "all")).alias("sets"))
    # one term alone is enough only where a phrase looks up no more
    least = asked.groupBy("seq").agg(F.min(F.bit_count("all")).alias("least"))
    open_ = met.join(_sent(sets.join(least, "seq")), "seq").where(F.bit_count("met") >= F.col("least"))
    agreed = F.filter("sets", lambda x: x["all"].bitwiseAND(F.col("met")) == x["all"])
    return open_.select("key", "seq", "start", F.explode(agreed).alias("p")).select(
        "key", "seq", "start", "p.first", "p.size").where(F.col("start") + F.col("first") >= 0)


def exact_matches(docs: DataFrame, index: DataFrame, phrases: Phrases, rarest: int = RAREST) -> DataFrame:
    """``key, seq, start, length``: every place of every phrase in ``docs``."""
    places = _candidates(index, _rarest(index, phrases, rarest)).join(phrases.sequences, "seq").select(
        "key", F.struct("seq", (F.col("start") + F.col("first")).alias("start"),
                        F.slice("words", F.col("first") + 1, F.col("size")).alias("words")).alias("place"))
    found = places.groupBy("key").agg(F.collect_list("place").alias("found"))
    texts = docs.select(row_key().alias("key"), "text").join(found, "key").select(
        "key", words(F.col("text")).alias("w"), "found")
    agree = F.filter("found", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["words"])) == c["words"])
    return texts.select("key", F.explode(agree).alias("m")).select(
        "key", "m.seq", "m.start", F.size("m.words").alias("length")).distinct()


def near_matches(index: DataFrame, phrases: Phrases, slop: int, rarest: int = RAREST) -> DataFrame:
    """``key, seq, first, start``: places where a phrase's rarest terms stand nearly as in it.

    Each of the ``rarest`` rarest terms is at most ``slop`` words from where the rarest of them
    says it should be. Starts are met in bins of ``slop + 1`` words and their neighbours, so the
    join is an equality.
    """
    width, rare = slop + 1, _rarest(index, phrases, rarest)
    starts = index.where(~F.col("last")).select("key", "pos", "term").join(_sent(rare), "term").select(
        "key", "seq", "first", (F.col("pos") - F.col("offset") + F.col("first")).alias("start"), "offset", "rank",
        F.least("size", F.lit(rarest)).alias("needed"))
    anchors = starts.where(F.col("rank") == 1).select(
        "key", "seq", "first", "start", "needed",
        F.explode(F.array(*[F.floor(F.col("start") / width) + d for d in (-1, 0, 1)])).alias("bin"))
    others = starts.select("key", "seq", "first", F.col("start").alias("other"), "offset",
                           F.floor(F.col("start") / width).alias("bin"))
    met = anchors.join(others, ["key", "seq", "first", "bin"]).where(F.abs(F.col("other") - F.col("start")) <= slop)
    return (met.groupBy("key", "seq", "first", "start").agg(
        F.count_distinct("offset").alias("met"), F.first("needed").alias("needed"))
        .where(F.col("met") == F.col("needed")).select("key", "seq", "first", "start"))


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, rarest: int = RAREST) -> DataFrame:
    """Per row of ``docs``: key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any place of any phrase is hit. Null texts have no words; repeated rows are
    returned as often as they come, and so are rows of a null id. No items, or none with words,
    leave every document clean; an empty table gives an empty one. Item ids are compared and
    sorted as strings; a null one is skipped in the list but its phrases count.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    phrases = Phrases(items, length)
    index = build_index(docs, phrases)
    matches = written(exact_matches(docs, index, phrases, rarest), "matches")
    end = F.col("start") + F.col("length")
    order = Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(order), F.lit(0))), F.lit(0))
    hits = (matches.select("key", "start", "length").distinct().withColumn("fresh", fresh)
            .groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit")))
    owned = matches.select("key", "seq").distinct().join(phrases.owners, "seq").groupBy("key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = index.where("last").select("key", "doc_id", F.col("pos").cast("long").alias("n_words"))
    joined = rows.join(hits, "key", "left").join(owned, "key", "left")
    return joined.select(
        "key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` in which no phrase of ``items`` occurs, with all their columns, whatever their names.

    A null or empty text holds no phrase and stays, and so does every row where there are no items.
    """
    return aside(docs, ["doc_id", "text"], lambda plain: _clean(plain, items, length))


def _clean(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    found = contamination(docs, items, length).where("contaminated").select(F.col("key").alias("_key")).distinct()
    return docs.join(found, row_key() == F.col("_key"), "left_anti")


_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM p),
o AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, l WHERE len(w) >= n)),
m AS (SELECT doc_id, s, o.n, item_id FROM o JOIN p ON o.phrase = p.phrase AND o.n = p.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


@query("op4_decontamination", _SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
