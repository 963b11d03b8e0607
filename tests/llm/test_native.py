"""Mixing, decontamination and Merkle fingerprints against SQL, brute force and odd rows."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from hexatlas.llm import decontamination as D, merkle as M, mixing as X
from hexatlas.llm.base import word_count

WITH_SQL = [n for n in ("op1_mixing", "op2_licenses", "op3_warc", "op4_decontamination", "op5_merkle")]


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, sf, name):
    line = compare(spark, sf, name)
    assert line.startswith("ok "), line


def test_native_plans_have_no_python(spark, sf):
    for name in ("op1_mixing", "op4_decontamination", "op5_merkle"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan, (name, word)


def test_targets_stop_at_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 100), ("z", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in X.targets(sizes, 1.5, 2.0, (5, 2, 1)).collect()}
    caps, weights = {"a": 20, "b": 2000, "c": 10, "z": 0, None: 200}, {"a": 5, "b": 2, "c": 1, "z": 5, None: 2}
    want, total = {}, 1.5 * 1115
    while True:
        open_ = [s for s in caps if s not in want]
        level = (total - sum(want.values())) / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > caps[s]]
        if not over:
            want.update({s: weights[s] * level for s in open_})
            break
        want.update({s: float(caps[s]) for s in over})
    assert all(math.isclose(got[s], want[s]) for s in want) and len(got) == 5


def test_mix_with_odd_rows(spark, documents):
    docs = documents([(1, "a b c d"), (2, "e f"), (3, None), (4, ""), (None, "g h i"), (5, "j " * 50), (7, "k l"), (7, "k l")])
    docs = docs.withColumn("taken", F.lit("old")).withColumn("size", word_count(F.col("text")))
    docs = docs.withColumn("source", F.when(F.col("doc_id") == 2, None).otherwise(F.col("source")))
    rows = X.mix(docs).collect()
    assert len(rows) == 8 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2
    again = X.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert X.mix(docs.limit(0)).count() == 0


def brute_contamination(docs, items):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: token.findall((t or "").translate(low))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            q = cut(text)
            n = min(10, len(q))
            for s in range(len(q) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == q[s:s + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i % 90}" for i in range(100))
ITEMS = [(3, "Alpha beta, gamma"), (20, LONG), (100, "the the the the the the the the the the the"), (7, None), (8, "!?"), (9, "Alpha beta gamma")]


def test_contamination_equals_brute_force(spark, documents):
    texts = [(1, "x alpha BETA gamma y alpha beta gamma"), (2, LONG), (3, "the " * 30), (4, None), (5, ""), (6, "alpha beta"),
             (7, "w5 " + LONG[30:120]), (8, "pre w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 post"), (9, "the " * 9), (10, "Ünï w1 ßet"),
             (11, "w" * 100_000 + " alpha beta gamma"), (None, "alpha-beta_gamma"), (12, "alpha beta gamma"), (12, "alpha beta gamma")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(documents(texts), items).drop("key").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_contamination(texts, ITEMS)
    for rarest in (1, 2):
        few = D.contamination(documents(texts), items, rarest=rarest).drop("key").collect()
        assert sorted([tuple(r) for r in few], key=str) == brute_contamination(texts, ITEMS)
    kept = {r["doc_id"] for r in D.clean(documents(texts), items).collect()}
    assert kept == {r[0] for r in brute_contamination(texts, ITEMS) if not r[5]}


def test_contamination_without_items_or_documents(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(documents([]), items).count() == 0
    got = D.contamination(documents([(1, "a b")]), items.limit(0)).collect()
    assert [(r["doc_id"], r["n_words"], r["n_hit"]) for r in got] == [(1, 2, 0)]


def test_near_matches_allow_for_slop(spark, documents):
    items = spark.createDataFrame([(1, "red green blue amber")], "item_id long, text string")
    docs = documents([(1, "red green blue amber"), (2, "red x green y blue z amber"), (3, "red " + "x " * 30 + "green blue amber")])
    phrases = D.Phrases(items)
    index = D.build_index(docs, phrases)
    ids = {r["key"]: r["doc_id"] for r in index.where("last").collect()}
    for slop, want in ((0, {1}), (2, {1, 2}), (40, {1, 2, 3})):
        assert {ids[r["key"]] for r in D.near_matches(index, phrases, slop).collect()} == want


def test_fingerprints_tell_texts_apart_and_locate_edits(spark):
    a = "First one. Second one.\nThird line\n\nNew section here. Another sentence."
    b = a.replace("Another", "One more")
    rows = spark.createDataFrame([(a, a), (a, b), ("", None), ("x", "x\n"), ("é" * 300, "é" * 299)], "a string, b string")
    trees = rows.withColumns({"ta": M.tree(F.col("a")), "tb": M.tree(F.col("b"))})
    prints = trees.withColumns({"fa": M.fingerprint(F.col("ta")), "fb": M.fingerprint(F.col("tb"))})
    got = prints.select("fa", "fb", M.likeness(F.col("fa"), F.col("fb")).alias("like"), M.differing(F.col("ta"), F.col("tb")).alias("at")).collect()
    assert got[0]["fa"] == got[0]["fb"] and got[0]["like"] == 1.0 and got[0]["at"] == []
    assert [tuple(p) for p in got[1]["at"]] == [(1, 0, 1)] and 0.5 < got[1]["like"] < 1
    assert got[2]["fa"] == got[2]["fb"] and got[3]["fa"] != got[3]["fb"] and got[4]["fa"] != got[4]["fb"]


def test_edits_are_located_after_insertions(spark):
    body = "One. Two.\nThree.\n\nFour. Five.\nSix. Seven."
    pairs = [(body, body, [], []),
             (body, "New.\n" + body, [], [(0, 0, 0)]),
             (body, "New. Newer.\n\n" + body, [], [(0, 0, 0), (0, 0, 1)]),
             ("Gone.\n" + body, body, [(0, 0, 0)], []),
             (body, "New.\n\n" + body.replace(" Five", " Nine"), [(1, 0, 1)], [(0, 0, 0), (2, 0, 1)]),
             (body, body.replace("Three.\n", "Three.\n\n"), [], [(1, 0, -1)]),
             (None, "", [], []),
             ("", "Word", [(0, 0, -1)], [(0, 0, 0)]),
             ("A.\nB.", "B.\nA.", [(0, 0, 0), (0, 1, 0)], [(0, 0, 0), (0, 1, 0)])]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(pairs)], "i int, a string, b string")
    trees = rows.select("i", M.tree(F.col("a")).alias("ta"), M.tree(F.col("b")).alias("tb"))
    got = {r["i"]: r["e"] for r in trees.select("i", M.edits(F.col("ta"), F.col("tb")).alias("e")).collect()}
    for i, (_, _, removed, added) in enumerate(pairs):
        assert ([tuple(p) for p in got[i]["removed"]], [tuple(p) for p in got[i]["added"]]) == (removed, added), i


@pytest.mark.parametrize("per_bucket", [1, 3, 1000])
def test_next_document_across_ranges(spark, documents, per_bucket):
    texts = [(i * i % 977, f"text {i}") for i in range(60)]
    texts = list({i: (i, t) for i, t in texts}.values()) + [(10_000_000, None)]
    ordered = sorted((i, t or "") for i, t in texts)
    want = {i: (t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered)}
    got = {r["doc_id"]: (r["text"], r["next_text"]) for r in M.with_next(documents(texts), per_bucket).collect()}
    assert got == want
    assert M.with_next(documents([])).count() == 0
    one = M.with_next(documents([(5, "only")])).collect()
    assert [(r["text"], r["next_text"]) for r in one] == [("only", "only")]
    twice = M.with_next(documents([(5, "b"), (5, "a"), (None, "n")])).collect()
    assert sorted((r["text"], r["next_text"]) for r in twice) == [("a", "b"), ("b", "n"), ("n", "a")]
