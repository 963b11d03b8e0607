"""Merkle trees over documents: sections of paragraphs of pieces.

Sections are parted by blank lines, paragraphs by line ends. A paragraph is cut further into
pieces, at sentence ends and at most ``PIECE`` characters long, so an edit inside a long
paragraph is located too. A piece, a paragraph and a section each hash what they hold; the root
hashes the sections. Equal roots mean equal texts; where roots differ, only differing branches
need to be looked into. Everything is a column expression over one row: no text is shuffled to
be fingerprinted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hexatlas.llm.base import query, table
from hexatlas.session import written

PIECE = 64
#: Characters that end a sentence.
STOPS = ".!?"
LEAF_HEX = 8
ROWS_PER_BUCKET = 2000
SPLITS = 1024


def _pieces(paragraph: Column) -> Column:
    """Pieces whose concatenation is the paragraph."""
    return F.regexp_extract_all(paragraph, F.lit(f"[^{STOPS}]{{1,{PIECE}}}[{STOPS}]*|[{STOPS}]+"), F.lit(0))


def _digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _over(parts: Column) -> Column:
    """A branch over its parts' hashes; no parts hash like the empty text."""
    return _digest(F.array_join(parts, ","))


def tree(text: Column) -> Column:
    """``array<struct<hash, paragraphs: array<struct<hash, pieces: array<string>>>>>``.

    Null is the empty text: one section of one paragraph without pieces.
    """
    def paragraph(p: Column) -> Column:
        pieces = F.transform(_pieces(p), _digest)
        return F.struct(_over(pieces).alias("hash"), pieces.alias("pieces"))

    def section(s: Column) -> Column:
        paragraphs = F.transform(F.split(s, "\n"), paragraph)
        return F.struct(_over(F.transform(paragraphs, lambda p: p["hash"])).alias("hash"), paragraphs.alias("paragraphs"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)


def root(tree_column: Column) -> Column:
    return _over(F.transform(tree_column, lambda s: s["hash"]))


def differing(a: Column, b: Column) -> Column:
    """Places ``array<struct<section, paragraph, piece>>`` (from 0) at which two trees part.

    Sections are compared by position; only unequal ones are opened, then only their unequal
    paragraphs, then their unequal pieces. A part that one side lacks counts as unequal.
    """
    empty = F.array().cast("array<string>")

    def places(x: Column, y: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y), F.lit(1)) - 1)

    def at(x: Column, i: Column) -> Column:
        return F.get(x, i)

    def pieces(s: Column, p: Column, x: Column, y: Column) -> Column:
        px, py = F.coalesce(x["pieces"], empty), F.coalesce(y["pieces"], empty)
        changed = F.filter(places(px, py), lambda i: ~at(px, i).eqNullSafe(at(py, i)))
        return F.transform(changed, lambda i: F.struct(s.alias("section"), p.alias("paragraph"), i.alias("piece")))

    def paragraphs(s: Column, x: Column, y: Column) -> Column:
        px, py = x["paragraphs"], y["paragraphs"]
        sized = F.sequence(F.lit(0), F.greatest(F.coalesce(F.size(px), F.lit(0)), F.coalesce(F.size(py), F.lit(0)), F.lit(1)) - 1)
        changed = F.filter(sized, lambda i: ~at(px, i)["hash"].eqNullSafe(at(py, i)["hash"]))
        return F.flatten(F.transform(changed, lambda i: pieces(s, i, at(px, i), at(py, i))))

    changed = F.filter(places(a, b), lambda i: ~at(a, i)["hash"].eqNullSafe(at(b, i)["hash"]))
    return F.flatten(F.transform(changed, lambda i: paragraphs(i, at(a, i), at(b, i))))


def edits(a: Column, b: Column) -> Column:
    """``struct<removed, added>`` of places ``array<struct<section, paragraph, piece>>`` (from 0).

    ``removed`` are the pieces of ``a`` that ``b`` does not have, ``added`` those of ``b`` that ``a``
    does not have, each by its place in its own tree. Branches are met by hash, wherever they stand,
    so an insertion does not mark what follows it; only sections, then paragraphs, that the other
    side lacks are opened. A paragraph without pieces is its piece -1. Texts that hold the same
    pieces in another order or number, and so differ without a piece of their own, part at the
    places of ``differing`` on both sides. Equal texts have none.
    """
    def lacking(x: Column, y: Column) -> Column:
        paragraphs = F.flatten(F.transform(y, lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))
        leaves = F.flatten(F.transform(y, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["pieces"]))))

        def numbered(parts: Column) -> Column:
            return F.transform(parts, lambda v, i: F.struct(i.alias("i"), v.alias("v")))

        def place(s: Column, p: Column, i: Column) -> Column:
            return F.struct(s.alias("section"), p.alias("paragraph"), i.alias("piece"))

        def in_paragraph(s: Column, p: Column) -> Column:
            own = F.filter(numbered(p["v"]["pieces"]), lambda q: ~F.array_contains(leaves, q["v"]))
            bare = F.array(place(s, p["i"], F.lit(-1)))
            return F.when(F.size(p["v"]["pieces"]) == 0, bare).otherwise(F.transform(own, lambda q: place(s, p["i"], q["i"])))

        def in_section(s: Column) -> Column:
            own = F.filter(numbered(s["v"]["paragraphs"]), lambda p: ~F.array_contains(paragraphs, p["v"]["hash"]))
            return F.flatten(F.transform(own, lambda p: in_paragraph(s["i"], p)))

        hashes = F.transform(y, lambda s: s["hash"])
        changed = F.filter(numbered(x), lambda s: ~F.array_contains(hashes, s["v"]["hash"]))
        return F.flatten(F.transform(changed, in_section))

    removed, added = lacking(a, b), lacking(b, a)
    moved = (F.size(removed) == 0) & (F.size(added) == 0) & (root(a) != root(b))
    return F.struct(F.when(moved, differing(a, b)).otherwise(removed).alias("removed"),
                    F.when(moved, differing(a, b)).otherwise(added).alias("added"))


def fingerprint(tree_column: Column) -> Column:
    """The root of a tree, a slash, and a short hash of each piece in order, as one string.

    Equal texts have equal fingerprints; for different texts the roots differ.
    """
    pieces = F.flatten(F.transform(tree_column, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["pieces"]))))
    return F.concat(root(tree_column), F.lit("/"),
                    F.array_join(F.transform(pieces, lambda h: F.left(h, F.lit(LEAF_HEX))), "."))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct pieces of two fingerprints that both have (0 to 1); 1 for equal roots."""
    def leaves(x: Column) -> Column:
        return F.array_distinct(F.split(F.substring_index(x, "/", -1), r"\."))

    la, lb = leaves(a), leaves(b)
    common = F.size(F.array_intersect(la, lb))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.lit(2.0) * common / (F.size(la) + F.size(lb)))


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``doc_id, text, next_text``: each document with the one after it in the order of ids.

    The last is followed by the first. Null texts are empty; equal ids are ordered by text and a
    null id comes first. Ids are dealt into ranges at splits drawn from the ids and a further
    even cut between splits, so a range holds about ``rows_per_bucket`` documents at any size.
    The first document of a range is also sent to the range before it: texts are shuffled once.
    """
    place = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    drawn = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        "doc_id", [i / SPLITS for i in range(SPLITS + 1)], 10 * SPLITS).alias("at")).first()
    keyed = rows.select("doc_id", "text", place.alias("_place"), _ranges(
        sorted(set(drawn["at"] or [])), -(-drawn["n"] // rows_per_bucket)).alias("_bucket"))
    firsts = written(keyed.groupBy("_bucket").agg(F.min("_place").alias("_first")), "merkle-ranges")
    ring = Window.orderBy("_bucket")  # one row per range, not per document
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = written(firsts.select(F.col("_bucket").alias("_own"), "_first", F.coalesce(
        F.lag("_bucket").over(ring), F.last("_bucket").over(whole)).alias("_previous")), "merkle-firsts")
    # of equal first ids the least text is the first document
    guests = (keyed.join(before, (F.col("_bucket") == F.col("_own")) & (F.col("_place") == F.col("_first")))
              .groupBy("_previous").agg(F.min("text").alias("text")))
    both = keyed.withColumn("_guest", F.lit(False)).unionByName(guests.select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("_place"),
        F.col("_previous").alias("_bucket"), F.lit(True).alias("_guest")))
    order = Window.partitionBy("_bucket").orderBy("_guest", "_place", "text")
    return (both.withColumn("next_text", F.lead("text").over(order)).where(~F.col("_guest"))
            .select("doc_id", "text", "next_text"))


def _ranges(at: list[int], wanted: int) -> Column:
    """Number of the id range of a row, about ``wanted`` ranges from the split points ``at``."""
    if wanted <= 1 or len(at) < 2:
        return F.lit(0).cast("long")
    cuts = at[::-(-len(at) // wanted)] if wanted < len(at) else at
    inner = -(-wanted // len(cuts))
    splits = F.array(*[F.lit(x).cast("long") for x in cuts])
    above = F.size(F.filter(splits, lambda x: x <= F.coalesce(F.col("doc_id"), F.lit(cuts[0] - 1))))
    low, high = F.get(splits, above - 1), F.get(splits, above)
    # beyond the last split, and before the first, a range is not cut further
    fine = F.coalesce(F.floor((F.col("doc_id") - low) * F.lit(inner) / (high - low)), F.lit(0))
    return above.cast("long") * F.lit(inner) + fine.cast("long")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n/2) characters replaced by the first as many of ``other``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def _sql() -> str:
    pieces = f"regexp_extract_all(p, '[^{STOPS}]{{1,{PIECE}}}[{STOPS}]*|[{STOPS}]+')"
    hashed = f"list_transform({pieces}, lambda x: sha256(x))"

    def fp(t: str) -> str:
        paragraph = f"sha256(array_to_string({hashed}, ','))"
        sections = (f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: sha256(array_to_string("
                    f"list_transform(string_split(s, chr(10)), lambda p: {paragraph}), ',')))")
        leaves = (f"flatten(list_transform(string_split({t}, chr(10) || chr(10)), lambda s: flatten(list_transform("
                  f"string_split(s, chr(10)), lambda p: {hashed}))))")
        return (f"sha256(array_to_string({sections}, ',')) || '/' || "
                f"array_to_string(list_transform({leaves}, lambda h: h[1:{LEAF_HEX}]), '.')")

    def like(a: str, b: str) -> str:
        la, lb = (f"list_distinct(string_split(string_split({x}, '/')[2], '.'))" for x in (a, b))
        return (f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({la}, {lb})) "
                f"/ (len({la}) + len({lb})) END")

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t)) AS nx FROM d),
e AS (SELECT *, length(t) AS n_chars, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS ed FROM n),
f AS (SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, {fp('t')} AS fingerprint, {fp('ed')} AS edited_fingerprint,
  {fp('nx')} AS nf FROM e)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {like('fingerprint', 'edited_fingerprint')} AS near_edited, {like('fingerprint', 'nf')} AS near_next FROM f"""


@query("op5_merkle", _sql())
def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # trees and fingerprints are columns of their own, so that each is worked out once
    docs = docs.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    trees = docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
                        *[tree(F.col(c)).alias(t) for c, t in (("text", "_t"), ("_edited", "_e"), ("next_text", "_n"))])
    prints = trees.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_t")).alias("fingerprint"),
                          fingerprint(F.col("_e")).alias("edited_fingerprint"), fingerprint(F.col("_n")).alias("_next"))
    return prints.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                         likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
