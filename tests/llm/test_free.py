"""The operators that SQL cannot express, against brute force and odd rows."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from hexatlas.llm import (
    licenses as L, pitman_yor as P, quality as Q, simhash as S, substrings as B, toxicity as T, warc as W)
from hexatlas.llm.components import components
from hexatlas.session import written

NOTHING = [(1, None), (2, ""), (3, " \n\t")]


def text_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# --- licences -------------------------------------------------------------------------

def test_license_parts_and_bounds(spark, documents):
    mit = L.TEMPLATES["MIT-text"]
    docs = documents([*NOTHING, (4, "some text\nReleased under the MIT license\nmore"), (5, mit.upper().replace(",", "")),
                      (6, "word " * 100_000), (7, "under the license"), (7, "under the license"), (None, "x\n\n" + mit)])
    got = {(r["doc_id"], r["license"], r["part"]) for r in L.scan(docs).collect()}
    assert got == {(1, None, None), (2, None, None), (3, None, None), (4, "MIT", "line"), (5, "MIT-text", "text"),
                   (6, None, None), (7, None, None), (None, "MIT-text", "line")}
    assert L.scan(docs).count() == 9 and L.scan(docs.limit(0)).count() == 0
    known = L.Templates(L.TEMPLATES, 0.8)
    for size in range(1, 200):
        near = known.candidates(size)
        best = [2 * min(size, s) / (size + s) >= 0.8 - 1e-12 for s in known.sizes]
        assert [i for i, ok in enumerate(best) if ok] == list(near)


def test_embedded_notices_equal_brute_force():
    """Windows at every place, not only at a template's bigrams; and no better window lies elsewhere."""
    rng = random.Random(12)
    texts = {"one": "a b c d e", "two": "a b c d e f g", "twice": "a b a b a b c", "far": "p q r", "single": "z"}
    known = L.Templates(texts, 0.8)
    stated = 0
    for _ in range(300):
        words = [rng.choice("abcdefgpqrx") for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 3)):
            notice = rng.choice(list(texts.values())).split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice if rng.random() < 0.6 else notice[:-1] + ["x"]
        want, tops = {}, {}
        for name, t in texts.items():
            grams = L.bigrams(t.split())
            size = sum(grams.values())
            for at in range(len(words) - 1 if size else 0):
                window = L.bigrams(words[at:at + size + 1])
                dice = 2 * sum((window & grams).values()) / (size + sum(window.values()))
                tops[name] = max(tops.get(name, 0), dice)
                if dice >= 0.8 and (words[at], words[at + 1]) in grams:
                    want[at] = min(want.get(at, (0, 0, "")), (-dice, -size, name))
        got = known.embedded(" ".join(words))
        assert got == want
        best = max(tops.values(), default=0)
        assert (-min(got.values())[0] if got else 0) == (best if best >= 0.8 else 0)
        stated += len(got)
    assert stated > 100


def test_notices_inside_longer_lines(spark, documents):
    mit = " ".join(L.TEMPLATES["MIT-text"].split())
    long = "word " * 50_000
    docs = documents([*NOTHING, (4, "We say: Released under the MIT License. And so on for ever and ever"),
                      (5, f"MIT License Copyright 2020 someone {mit} THE SOFTWARE IS PROVIDED AS IS {long}"),
                      (6, f"{long} released under the BSD 3-clause\nlicense {long}"), (7, "under the license of the software " * 20)])
    got = {r["doc_id"]: (r["license"], r["part"], r["n_parts"], r["licenses"]) for r in L.scan(docs).collect()}
    assert got == {1: (None, None, 0, ""), 2: (None, None, 0, ""), 3: (None, None, 0, ""), 4: ("MIT", "window", 0, "MIT"),
                   5: ("MIT-text", "window", 0, "MIT-text"), 6: ("BSD-3-Clause", "window", 0, "BSD-3-Clause"), 7: (None, None, 0, "")}


# --- WARC -----------------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    tricky = "WARC/1.0\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.0\r\n" * 40
    rows = [(1, "http://a\r\nX: y", tricky), (2, None, tricky), (3, "http://c", "é" * 500), (4, "d", "é" * 499), (5, "e", "é" * 499),
            (6, "f", None), (7, "g", ""), (8, "h", "é" * 500), (9, "i", tricky), (10, "k", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r["page_id"]: r for r in W.revisits_of_pages(pages, str(tmp_path / "w")).collect()}
    assert len(got) == 10
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == hashlib.sha1(raw).hexdigest()
    refers = {i: got[i]["refers_to_page"] for i in got if got[i]["record_type"] == "revisit"}
    assert refers == {1: 9, 2: 9, 3: 8}
    kept = W.read_archives(spark, str(tmp_path / "w" / "deduplicated"), payloads=True).where("record_type = 'response'")
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in kept.collect()} == {
        i: html or "" for i, _, html in rows if i not in refers}
    assert W.revisits_of_pages(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_repeated_rows_of_pages(spark, tmp_path):
    x, y = "x" * 1200, "y" * 1200
    rows = [(5, "a", x), (5, "a", x), (7, "b", x), (5, "c", y), (None, "d", x)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.revisits_of_pages(pages, str(tmp_path / "w")).collect()
    assert sorted((r["target_uri"], r["record_type"], r["refers_to_page"]) for r in got) == [
        ("a", "revisit", 7), ("a", "revisit", 7), ("b", "response", None), ("c", "response", None), ("d", "response", None)]


def test_archive_that_holds_revisits(spark, tmp_path):
    def record(kind, name, body="", page=None, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{name}>", "WARC-Date": "2024-01-01T00:00:00Z",
                **({"X-Page-ID": str(page)} if page else {}), **{k.replace("_", "-"): v for k, v in more.items()}}
        lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
        return f"WARC/1.0\r\n{lines}Content-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n"

    x, y = "x" * 1200, "y" * 1200
    digest = "sha1:" + hashlib.sha1(x.encode()).hexdigest()
    source = tmp_path / "in"
    source.mkdir()
    (source / "part-0.warc").write_bytes("".join([
        record("warcinfo", "info", "software: z\r\n"), record("response", "r1", x, 1), record("response", "r2", x, 2),
        record("revisit", "v9", page=9, WARC_Payload_Digest=digest, X_Payload_Length="1200"),
        record("revisit", "named", WARC_Refers_To="<urn:x:r1>"), record("revisit", "lost", WARC_Refers_To="<urn:y:far>"),
        record("response", "plain", y)]).encode())
    W.deduplicate(spark, str(source), str(tmp_path / "out"))
    got = {r["record_id"]: (r["record_type"], r["refers_to_id"], len(r["payload"]))
           for r in W.read_archives(spark, str(tmp_path / "out"), payloads=True).collect()}
    assert got == {
        "urn:x:info": ("warcinfo", None, 13), "urn:x:r1": ("revisit", "urn:x:r2", 0), "urn:x:r2": ("response", None, 1200),
        "urn:x:v9": ("revisit", "urn:x:r2", 0), "urn:x:named": ("revisit", "urn:x:r2", 0),
        "urn:x:lost": ("revisit", "urn:y:far", 0), "urn:x:plain": ("response", None, 1200)}


def test_gzip_members_of_any_size():
    parts = [bytes(i % 251 for i in range(n)) for n in (0, 1, 5000, 0, 300_000)] + [random.Random(n).randbytes(n) for n in (70_000, 10)] * 3
    assert W._bytes_of(b"".join(map(gzip.compress, parts))) == b"".join(parts)
    assert W._bytes_of(b"WARC/1.0") == b"WARC/1.0" and W._bytes_of(b"") == b""


# --- SimHash and components ------------------------------------------------------------

def linked(fps):
    """Component roots of fingerprints by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("few", [2, 8, 256])
def test_links_equal_brute_force(spark, few):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        middle = rng.getrandbits(64)
        for _ in range(25):
            fps.add(middle ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    at = {s: i for i, s in enumerate(signed)}
    found = components(S.links(spark.createDataFrame([(s,) for s in signed], "fp long"), few)).collect()
    got = {at[r["node"]]: r["root"] for r in found}
    want = linked(fps)
    for i in range(len(fps)):
        for j in range(i):
            same = got.get(i, -i - 1 << 70) == got.get(j, -j - 1 << 70)
            assert same == (want[i] == want[j])


def test_simhash_of_odd_texts(spark, documents):
    docs = documents([*NOTHING, (9, "A b"), (4, "a B"), (None, "a b"), (7, "x " * 50_000), (8, "x " * 50_000)])
    got = {(r["doc_id"], r["fp"] == 0, r["component_id"]) for r in S.near_duplicates(docs).collect()}
    assert got == {(1, True, 1), (2, True, 1), (3, True, 1), (9, False, 4), (4, False, 4), (None, False, 4), (7, False, 7), (8, False, 7)}
    assert sorted(r["doc_id"] for r in S.kept(docs).collect()) == [1, 4, 7]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id * 11 % 301 a", "(id + 1) * 11 % 301 b").union(spark.range(5).selectExpr("1000 a", "1000 + id b"))
    got = {(r["node"], r["root"]) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(301)} | {(1000 + i, 1000) for i in range(5)}
    assert components(edges.limit(0)).count() == 0


def test_rounds_over_few_links_are_few_tasks(spark):
    """On a session that deals every shuffle over many partitions, a round of few links is written by one task."""
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = components(spark.range(300).selectExpr("id a", "id + 1 b"))
        assert len(found.inputFiles()) == 1
        assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(301)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- exact substrings -----------------------------------------------------------------

def brute_removed(texts, length=400):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        left = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out.append((len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("least_hot", [B.LEAST_HOT, 2])
def test_substrings_equal_brute_force(spark, documents, monkeypatch, least_hot):
    """Also where nearly every repeated bucket, class, cell and window is dealt over salts."""
    monkeypatch.setattr(B, "LEAST_HOT", least_hot)
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    shared, other = prose(900), prose(420)
    texts = [None, "", prose(399), shared, shared, prose(300) + shared[100:620] + prose(80), shared[:399], shared[:400],
             prose(50) + other + prose(500) + other[10:], other[5:405] + other[6:406], "ab" * 700, "x" * 1200, prose(200) + "ab" * 400,
             prose(1000) + shared[300:700] + "é", "é" + shared[301:702], prose(3000)]
    texts += [prose(rng.randrange(0, 300)) + shared[a:a + rng.randrange(380, 460)] + prose(100) for a in range(0, 400, 9)]
    got = {r["doc_id"]: tuple(r)[2:] for r in B.deduplicated(documents(list(enumerate(texts)))).collect()}
    want = brute_removed([(t or "").encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_hot_keys_are_dealt_over_salts(spark, monkeypatch):
    """One key with half of all rows meets its fact in many tasks, and no row is lost or repeated."""
    monkeypatch.setattr(B, "LEAST_HOT", 100)
    rows = written(spark.range(20000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("g"),
                                             F.col("id").alias("key"), F.lit(0).alias("run")), "hot-rows")
    facts = B._classes(rows, ["g"], "hot-facts")
    met = B._meet(rows, facts, ["g"], ["key", "run"])
    assert met.count() == met.select("key").distinct().count() == 20000
    assert met.where("g = -1 and n <> 10000 or g <> -1 and n <> 1").isEmpty()
    plain = B._meet(rows, facts.where("g <> -1"), ["g"], ["key", "run"], how="left")
    assert plain.where("n is null").count() == 10000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        each = B._meet(rows, facts, ["g"], ["key", "run"]).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert each < 2 * 20000 / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_substrings_across_chunks(spark, documents, monkeypatch):
    """The helpers on a text of several chunks, where runs are cut at their borders."""
    rng = random.Random(4)
    passage = bytes(rng.randrange(97, 123) for _ in range(1500))
    noise = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    data = noise(B._CHUNK - 700) + passage + noise(B._CHUNK) + passage + noise(500)
    docs = documents([(1, data.decode()), (2, data[:1000].decode())])
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in B.deduplicated(docs).collect()}
    assert got == {1: (4000, 3), 2: (1000, 1)}


def test_periods_of_a_document_are_one_row(spark, documents):
    """A repeated word files a suffix in each of its periods: they are one row of the document, also where it has gaps."""
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [noise(150) + "and " * 400 + noise(k) + "and " * 300 + noise(90) for k in range(0, 300, 60)]
    texts += ["the " * 500, "thé " * 90 + noise(5) + "thé " * 90, noise(700)]
    docs = documents(list(enumerate(texts)))
    filed = B._filed(docs.select(F.col("doc_id").alias("key"), "text"))
    assert filed.groupBy("g", "u", "key").count().where("count > 1").isEmpty()
    assert filed.where("key < 5").groupBy("key").count().agg(F.max("count")).first()[0] < 60
    got = {r["doc_id"]: tuple(r)[2:] for r in B.deduplicated(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed([t.encode() for t in texts])


def test_repeated_rows_and_cut_texts(spark, documents):
    text = "".join(random.Random(9).choice("klmnopqr") for _ in range(600))
    docs = documents([(1, text), (1, text), (2, "short"), (3, None), (None, "ü" + text[:450] + "end")])
    before = {t.name for t in spark.catalog.listTables()}
    got = B.deduplicated(docs)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got.collect()) == [(0, 0), (5, 0), (455, 450), (600, 600), (600, 600)]
    left = {(r["doc_id"], r["text"], r["n_chars"]) for r in B.without_repeats(docs).collect()}
    assert left == {(2, "short", 5), (3, None, 0), (None, "üend", 4)}
    assert B.without_repeats(docs).columns == docs.columns and B.deduplicated(docs.limit(0)).count() == 0


def test_scratch_of_substrings_is_dropped(spark, documents, monkeypatch):
    left, text = [], "".join(random.Random(9).choices("klmnopqr", k=600))
    monkeypatch.setattr(B.Scratch, "__init__", lambda self, s: (setattr(self, "spark", s), setattr(self, "paths", {}), left.append(self))[0])
    got = B.deduplicated(documents([(1, text), (2, text[:500] + "x"), (3, "short")]))
    assert sorted(r["n_removed"] for r in got.collect()) == [0, 500, 500]
    assert [list(s.paths) for s in left] == [["removed"]]


# --- toxicity and quality ---------------------------------------------------------------

def invented(rng, n, extra=()):
    base = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "magna", "aliqua", "tempor", "labore", "veniam"]
    return " ".join(rng.choice(extra) if extra and rng.random() < 0.1 else rng.choice(base) + rng.choice(["", "a", "us", "em"])
                    for _ in range(n))


def test_toxicity_of_held_out_texts(spark, documents):
    rng = random.Random(1)
    rows = [(i, invented(rng, rng.randrange(30, 120), ("grobnak", "snarvil") if i % 4 == 0 else ())) for i in range(400)]
    docs, labels = documents(rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = T.train(docs, labels.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    held = [i for i in got if i % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    odd = T.score(documents([*NOTHING, (None, "x" * 200_000)]), model).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] in (1, 2)}) == 1
    one_kind = T.train(docs, labels.where("toxic = 0"))
    assert all(r["score"] < 0.5 for r in T.score(docs, one_kind).collect())
    assert T.score(docs.limit(0), model).count() == 0


def test_toxicity_of_texts_without_spaces(spark, documents):
    """Marks stand deep inside one long run: all of it has to be learned from."""
    rng = random.Random(8)
    letters, marks = "あいうえおかきくけこさしすせそ", ("ぬねのはひ", "まみむめも")
    def run(toxic):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 60))) for _ in range(4)]
        return (rng.choice(marks) if toxic else "").join(parts)
    rows = [(i, run(i % 4 == 0)) for i in range(400)]
    docs, labels = documents(rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = T.train(docs, labels.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    held = [i for i in got if i % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.9 * len(held)


def test_pieces_are_whole_characters_and_cover_the_run():
    rng = random.Random(6)
    for _ in range(50):
        text = "".join(rng.choice("aéあ😀") for _ in range(rng.randrange(12, 60)))
        raw = text.encode()
        want = set()
        for i in range(len(text)):
            for least in T.PIECES:
                ends = [j for j in range(i, len(text) + 1) if len(text[i:j].encode()) >= least]
                want |= {text[i:ends[0]].encode()} if ends else set()
        assert T.pieces(raw) == want
    beginnings = {b" " + b"x" * k for k in (*range(T.SHORTEST, T.LONGEST + 1), T.LONGEST_WORD)}
    assert T.segments("ab " + "x" * 300) == {b" ab", b"x" * 6, b"x" * 9} | beginnings


def test_windows_cover_the_text():
    for raw in (b"", b"a", b"a b c " * 100, b"x" * 1000, b"y" * 47 + b" z" * 60):
        cut = T.windows(raw)
        assert b"".join(cut) == raw and all(len(w) <= 2 * T.WINDOW for w in cut)


def test_ordinal_fit_finds_weights_and_ordered_thresholds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 5))
    true = np.array([2.0, -1.0, 0.5, 0, 0])
    latent = x @ true + rng.logistic(size=4000)
    grades = (latent[:, None] > np.array([-1.0, 0.5, 2.0])).sum(1)
    model = Q.fit(x, grades, 4, steps=800)
    assert np.all(np.diff(model.thresholds) > 0)
    assert np.allclose(model.weights, true, atol=0.2) and np.allclose(model.thresholds, [-1.0, 0.5, 2.0], atol=0.25)
    tails = model.tails(x)
    assert np.all(np.diff(tails, axis=1) <= 0) and abs(tails.sum(1).mean() - grades.mean()) < 0.05
    empty = Q.fit(x[:0], grades[:0], 4)
    assert np.allclose(empty.weights, 0) and np.all(np.diff(empty.thresholds) > 0)


def test_quality_of_texts_not_learned_from(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in Q.graded(docs, labels.where("doc_id % 3 <> 0")).collect()}
    held = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 3 = 0").collect()}
    assert sum(got[i]["keep"] == (q == 1) for i, q in held.items()) >= 0.93 * len(held)
    assert all(r["p_above_0"] >= r["p_above_1"] for r in got.values()) and len(got) == docs.count()


def test_kept_documents_are_unchanged(spark, documents):
    big = 2**60 + 1
    docs = documents([(big, "good text here"), (None, None), (3, "")]).withColumn("tails", F.lit("x")).withColumn("expected_grade", F.lit(None).cast("date"))
    labels = spark.createDataFrame([(big, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = Q.kept(docs, labels)
    assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
    assert (big, "good text here") in {(r["doc_id"], r["text"]) for r in rows.collect()}
    assert Q.kept(docs.limit(0), labels).count() == 0


# --- Pitman-Yor -------------------------------------------------------------------------

def tokens(t):
    return (t or "").encode().lower().split() + [None]


def test_base_scores_equal_brute_force(spark, sf):
    texts = text_of(spark, sf)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    rows = entry.queries()["op10_pitman_yor"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r["doc_id"]])
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["train_tokens"] == n
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (held[r["doc_id"]], len(own), sum(count[w] > 0 for w in own))
    apart = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_predictive_probabilities_sum_to_one(spark, documents):
    """Scores of all texts of up to two words give a matrix similar to that of the transitions
    (scaled by the probabilities of first words). Its rows sum to one, so its radius is one."""
    train = [(i, t) for i, t in enumerate(["a b a c", "a b a b b", "c a b", "b", "", None, "a b a c"])]
    words = ["a", "b", "c", "zzz"]
    probe = [(100, "")] + [(101 + i, u) for i, u in enumerate(words)]
    probe += [(200 + 4 * i + j, f"{u} {w}") for i, u in enumerate(words) for j, w in enumerate(words)]
    docs = documents(train + probe).select("doc_id", "text", (F.col("doc_id") >= 100).alias("held"))
    for sweeps in (1, 3):
        got = {r["doc_id"]: 10 ** r["score"] for r in P.Model(docs, "held", sweeps=sweeps).scores().collect()}
        m = np.ones((5, 5))
        m[0, 0] = got[100]
        for i in range(4):
            m[1 + i, 0] = got[101 + i]
            for j in range(4):
                m[1 + i, 1 + j] = got[200 + 4 * i + j] / got[101 + j]
        assert abs(max(abs(np.linalg.eigvals(m))) - 1) < 1e-9


def test_tables_follow_the_seating_rule():
    keys = np.random.default_rng(1).integers(0, 2**63, 40_000).astype(np.uint64)
    for n, others, parent in ((2, 3.0, 0.2), (5, 0.0, 0.05), (40, 10.0, 0.3)):
        t = P.tables(keys, np.full(len(keys), float(n)), np.full(len(keys), others), np.full(len(keys), parent), 0.6, 1.0, 1)
        rng = np.random.default_rng(7)
        want = np.ones(len(keys))
        for i in range(1, n):
            new = (1.0 + 0.6 * (others + want)) * parent
            want += rng.random(len(keys)) < new / (new + i - 0.6 * want)
        assert abs(t.mean() - want.mean()) < 0.05 * want.mean() and abs(t.std() - want.std()) < 0.1 * want.std() + 0.02
    many = P.tables(keys[:500], np.full(500, 20_000.0), np.full(500, 50.0), np.full(500, 0.1), 0.5, 1.0, 1)
    assert np.all((many >= 1) & (many <= 20_000)) and many.mean() > 20
    assert P.tables(keys[:3], np.array([0.0, 1.0, 2.0]), np.zeros(3), np.full(3, 0.5), 0.5, 1.0, 1)[:2].tolist() == [0, 1]


def test_scores_of_odd_rows(spark, documents):
    docs = documents([*NOTHING, (4, "a b " * 40_000), (None, "a b"), (5, "a b"), (5, "a b")])
    rows = P.scored(docs).collect()
    assert len(rows) == 7 and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert P.scored(docs.limit(0)).count() == 0


# --- pipeline ---------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near-dedup", "suffix-array dedup", "benchmark decontamination", "mixing to target weights"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = spark.createDataFrame(stage(spark, before, sf).toPandas())
        if i < 4:
            assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    last = docs.toPandas()
    assert (last["taken"] > 0).all() and (last["taken"] <= 2 * last["size"]).all()
    assert last["doc_id"].is_unique
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == sizes[-1]
