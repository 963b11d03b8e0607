"""The pipeline's near-dedup stage against brute force on planted near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexatlas.llm import near_copies as N
from hexatlas.llm import simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """Least id of each row's component, by the Jaccard similarity of all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if 5 * len(sets[i] & sets[j]) >= 4 * union:
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[b] = a
    return {(rows[i][0], rows[find(i)][0]) for i in range(len(rows))}


@pytest.fixture
def planted():
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line = words(12)
    texts = [None, "", " \n", "one two", "one  TWO", "three four five six seven"]
    for size in (60, 200, 400):
        for _ in range(6):
            base = words(size)
            texts.append(" ".join(base + line))
            for edits in (1, 1, 2, 3, 4, 5, size // 50 + 1, size // 40 + 1):
                copy = list(base)
                for at in rng.sample(range(size), edits):
                    copy[at] = f"x{rng.randrange(5000)}"
                texts.append(" ".join(copy + line))
    for _ in range(40):  # a chain: each text alike to the next one only
        base = base[6:] + words(6)
        texts.append(" ".join(base))
    order = rng.sample(range(1, len(texts) + 1), len(texts))
    return list(zip(order, texts))


@pytest.mark.parametrize("stars, frequent", [(0, 8), (2, 2)])
def test_near_copies_equal_brute_force(spark, documents, planted, monkeypatch, stars, frequent):
    monkeypatch.setattr(N, "FREQUENT", frequent)
    got = {(r["doc_id"], r["component_id"]) for r in N.near_copies(documents(planted), stars=stars).collect()}
    assert got == brute(planted)


def test_stage_leaves_one_of_each_group(spark, sf, documents, planted):
    docs = documents([*planted, (planted[7][0], planted[7][1]), (None, "word " * 9), (None, "one two")])
    got = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, sf).collect())
    names = {c for _, c in brute(planted)}
    twice = [planted[7][0]] if planted[7][0] in names else []
    assert got == sorted([*names, *twice, -1])
    assert corpus_pipeline.distinct(spark, docs.limit(0), sf).count() == 0


def within_two_bits(rng, size, edits, alike):
    """Two texts of ``size`` words whose fingerprints ``op6`` links, and whose shingle sets are alike or not."""
    while True:
        a = [f"w{rng.randrange(5000)}" for _ in range(size)]
        b = list(a)
        for at in rng.sample(range(5, size - 5), edits):
            b[at] = f"x{rng.randrange(5000)}"
        a, b = " ".join(a), " ".join(b)
        x, y = shingle_set(a), shingle_set(b)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 2 and (5 * len(x & y) >= 4 * len(x | y)) == alike:
            return a, b


def test_stage_compares_what_fingerprints_link_first(spark, sf, documents, monkeypatch):
    """Of pairs within two bits of each other the alike ones are linked, and not met by their shingles any more."""
    rng, proposed, met = random.Random(5), [], []
    by_fingerprint, met_by_shingles = N.by_fingerprint, N._met
    rows = list(enumerate([*within_two_bits(rng, 200, 1, True), *within_two_bits(rng, 200, 1, True), *within_two_bits(rng, 60, 2, False),
                           "one two three four five six", "one  TWO three four five six", "a text of its own"], 1))
    monkeypatch.setattr(N, "by_fingerprint", lambda prints: (proposed.append(by_fingerprint(prints).collect()), by_fingerprint(prints))[1])
    monkeypatch.setattr(N, "_met", lambda *of: (met.append(met_by_shingles(*of).count()), met_by_shingles(*of))[1])
    got = {r["doc_id"] for r in corpus_pipeline.distinct(spark, documents(rows), sf).collect()}
    assert got == {1, 3, 5, 6, 7, 9} == {c for _, c in brute(rows)}
    assert [len(pairs) for pairs in proposed] == [3] and sum(met) == 0


def test_stage_leaves_one_of_a_group_without_ids_or_with_repeated_ids(spark, sf, documents):
    base = "one two three four five six seven eight nine ten"
    rows = [(None, None), (None, ""), (None, " \n"),  # a group without words and ids
            (None, "alpha beta gamma delta epsilon zeta"), (None, "alpha  beta gamma delta epsilon zeta"),
            (3, base), (5, base.replace(" ", "  ")), (None, base.upper()),  # 5 is a copy of 3 and, in another row, a text of its own
            (5, "a text that is like no other one here"), (5, "a text that is like  no other one here"),
            (7, "twice the same row of one document"), (7, "twice the same row of one document")]
    got = [(r["doc_id"], " ".join((r["text"] or "").lower().split()))
           for r in corpus_pipeline.distinct(spark, documents(rows), sf).collect()]
    assert sorted(got, key=repr) == sorted([
        (None, ""), (None, "alpha beta gamma delta epsilon zeta"), (3, base), (5, "a text that is like no other one here"),
        (7, "twice the same row of one document"), (7, "twice the same row of one document")], key=repr)


CLASHING = ["_key", "key", "_keep", "_own", "_size", "_quality", "_text", "_0", "found", "n_hit", "_part", "last", "h", "a.b"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_stages_keep_columns_of_any_name(spark, sf, documents, planted, stage):
    plain = documents([*planted, (9001, "word " * 40_000), (9002, "alone " * 3)])
    if stage is corpus_pipeline.good:  # needs documents that are labelled
        plain = spark.read.parquet(f"{sf}/documents.parquet")
    extra = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    got = stage(spark, extra, sf)
    assert got.columns[:len(extra.columns)] == extra.columns
    rows = got.collect()
    assert rows and all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in CLASHING)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(spark, plain, sf).collect())
    if stage is corpus_pipeline.mixed:
        named = plain.withColumns({c: F.lit("own") for c in ("size", "weight", "taken")})
        assert all(r["size"] != "own" and r["weight"] != "own" and r["taken"] > 0 for r in stage(spark, named, sf).collect())


def test_sketches_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(5)
    for size, changed in [(1, 1), (10, 0), (300, 40), (5000, 900), (5000, 5000)]:
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[changed:], rng.integers(0, 2**64, changed, dtype=np.uint64)])
        bits = sum(int(x).bit_count() for x in (N.sketch(a) ^ N.sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
        fewer = b[:len(b) * 4 // 5]
        assert N.differing_bits(N.wide_sketch(a), N.wide_sketch(fewer)) <= len(np.setxor1d(a, fewer))
        assert N.differing_bits(N.wide_sketch(fewer), N.wide_sketch(fewer)) == 0


def test_the_sampled_share_holds_at_any_size(spark, documents, monkeypatch):
    """A line that a fifth of the texts have is known as frequent, however many texts there are."""
    monkeypatch.setattr(N, "SAMPLE", 10)
    line = " ".join(f"l{i}" for i in range(8))
    texts = documents([(i, f"a{i} b{i} c{i} d{i} e{i} f{i} " + (line if i % 5 == 0 else "")) for i in range(1200)])
    found, counts = N._frequent(N._sized(texts, "doc_id"))
    assert len(found) >= 4 and counts.min() >= N.FREQUENT
    monkeypatch.setattr(N, "MOST", 2)
    assert len(N._frequent(N._sized(texts, "doc_id"))[0]) == 2


def test_sets_meet_at_the_first_of_a_run(spark):
    """Two texts share ten shingles of their prefixes in a run: they are one pair, not ten."""
    posts = spark.createDataFrame([(k, 100, at, at, at - 1 if at else None) for k in (1, 2) for at in range(10)],
                                  "key long, n int, at int, h long, before long")
    met = N.all_pairs(posts.withColumn("root", F.col("key"))).select("key", "other_key").collect()
    assert [tuple(r) for r in met] == [(2, 1)]


def test_a_group_of_copies_is_met_by_its_least_altered_one(spark, documents, monkeypatch):
    """A text and 150 copies, each with edits of its own: near the text, mostly not near each other."""
    rng, met, possible = random.Random(29), [], N._possible
    base = [f"w{i}" for i in range(150)]
    rows = [(1, " ".join(base))]
    for i in range(2, 152):
        copy = list(base)
        for at in rng.sample(range(5, 145), 3):
            copy[at] = f"x{i}.{at}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(N, "_possible", lambda pairs, keys: (met.append(pairs.count()), possible(pairs, keys))[1])
    got = {(r["doc_id"], r["component_id"]) for r in N.near_copies(documents(rows)).collect()}
    assert got == brute(rows)
    assert sum(met) < 10 * len(rows), met


def test_pairs_that_are_alike_pass_at_the_first_shingle_they_share(spark):
    rng, rows = random.Random(3), [(145, 20, 145, 10, False)]
    for _ in range(500):
        a = sorted(rng.sample(range(300), rng.randrange(20, 200)))
        b = sorted({x if rng.random() < 0.9 else rng.randrange(300) for x in a})
        common = sorted(set(a) & set(b))
        if common:
            rows.append((len(a), a.index(common[0]), len(b), b.index(common[0]), 5 * len(common) >= 4 * len(set(a) | set(b))))
    df = spark.createDataFrame(rows, "n int, at int, m int, at2 int, alike boolean")
    place = [F.col(c) for c in ("n", "at", "m", "at2")]
    got = df.select("n", "at", "alike", N._may_meet(*place, first=True).alias("first"), N._may_meet(*place).alias("any")).collect()
    assert sum(r["alike"] for r in got) > 50 and all(r["first"] and r["any"] for r in got if r["alike"])
    assert not got[0]["first"] and got[0]["any"]


def test_texts_are_looked_up_in_a_bucketed_table(spark, documents, planted):
    before = {t.name for t in spark.catalog.listTables()}
    N.near_copies(documents(planted)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    scratch = N.Scratch(spark)
    table = scratch.bucketed(spark.range(100).selectExpr("id AS key", "id % 7 AS v"), "key", "near-texts")
    assert table.count() == 100
    scratch.drop("near-texts")
    assert {t.name for t in spark.catalog.listTables()} == before


def test_scratch_is_dropped(spark, documents, planted, monkeypatch, tmp_path):
    left = []
    monkeypatch.setattr(N.Scratch, "__init__", lambda self, s: (setattr(self, "spark", s), setattr(self, "paths", {}), left.append(self))[0])
    N.near_copies(documents(planted)).collect()
    assert [list(s.paths) for s in left] == [["near-found"]]


def test_workers_of_the_stage_get_few_texts_at_a_time(spark):
    def sizes(batches):
        for b in batches:
            yield b[:1].assign(n=len(b))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(key), spark.range(0, 5_000, 1, 1).mapInPandas(sizes, "id long, n long")
    assert rows.agg(F.max("n")).first()[0] == 5_000
    scratch = N.Scratch(spark)
    assert scratch.written(rows, "near-batches").agg(F.max("n"), F.sum("n")).first()[:] == (500, 5_000)
    scratch.drop("near-batches")
    with pytest.raises(Exception):
        scratch.written(rows.selectExpr("raise_error('no') AS x"), "near-batches")
    assert spark.conf.get(key) == before
