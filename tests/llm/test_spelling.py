"""Spelling variants against brute force, and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from hexatlas.llm import spelling as S
from hexatlas.llm.base import table


def counted(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            seen[low] += 1
    return seen


def brute(rows, least_length=5, least_count=3):
    n = {w: c for w, c in counted(rows).items() if len(w) >= least_length and c >= least_count}
    letters = {c for w in n for c in w}
    near, form = {}, {}
    for w in n:
        edits = {w[:i] + a + w[i + j:] for i in range(len(w) + 1) for j in (0, 1) for a in letters if i + j <= len(w)}
        edits |= {w[:i] + w[i + 1:] for i in range(len(w))}
        near[w] = [x for x in edits - {w} if x in n]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    found = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return found


def got(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_registered_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert got(S.spelling(spark, sf)) == brute(rows)


@pytest.mark.parametrize("part_words", [100_000, 50, 1])
def test_dense_vocabularies_over_any_parts(documents, part_words):
    """Short words over few letters: runs, ties, chains of forms and many neighbours of every kind."""
    rng = random.Random(part_words)
    words = ["".join(rng.choice("abÀ") for _ in range(rng.randint(5, 7))) for _ in range(120)]
    size = 100 if part_words > 1 else 25
    rows = [(i, " ".join(rng.choice(words[:size])[:rng.randint(5, 7)] for _ in range(60))) for i in range(30)]
    want = brute(rows)
    assert got(S.variants(documents(rows), part_words=part_words)) == want
    assert part_words == 1 or any(f for _, f, r, *_ in want if f != r) and max(x[4] for x in want) > 5


def test_numbers_of_trie_nodes_are_their_prefixes(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abÿ\U0001F600") for _ in range(rng.randint(1, 9))) for _ in range(200)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for part_words in (7, 1000):
        node, seen = {}, {}
        for r in S.trie_paths(df, part_words).collect():
            assert words[r["rank"]] == r["word"] and len(r["path"]) == len(r["word"])
            for i, number in enumerate(r["path"]):
                prefix = r["word"][:i + 1]
                assert node.setdefault(prefix, number) == number and seen.setdefault(number, prefix) == prefix
        assert len(seen) == len({w[:i + 1] for w in words for i in range(len(w))})


def test_odd_rows(spark, documents):
    long = "ab" * 3_000
    rows = [(1, None), (2, ""), (3, "1234 中文 abc"), (None, "Colour colour COLOUR"), (None, "colour color"),
            (4, "color color colours"), (4, "color color colours"), (5, "colours " * 3), (6, f"{long} {long}x {long}"),
            (7, f"{long} {long}x {long}x"), (8, "École école École École école école")]
    clash = documents(rows).withColumnsRenamed({"lang": "word", "source": "n"})
    have = got(S.variants(clash))
    assert have == {x for x in have if len(x[0]) < 100} | {x for x in have if len(x[0]) > 100}
    small = brute([r for r in rows if r[0] not in (6, 7)])
    assert {x for x in have if len(x[0]) < 100} == small
    counts = counted(rows)
    longs = {w: c for w, c in counts.items() if len(w) > 100 and c >= 3}
    assert {x[0]: x[3] for x in have if len(x[0]) > 100} == longs
    if len(longs) == 2:
        assert {x[4] for x in have if len(x[0]) > 100} == {1}
    assert S.variants(clash.limit(0)).count() == 0 and S.variants(documents([(1, None)])).count() == 0


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(i, i + 1 if i < 40 else None) for i in range(41)] + [(50, None), (51, 40)], "id long, form long")
    assert {r["id"]: r["root"] for r in S.roots(forms).collect()} == {**{i: 40 for i in range(41)}, 50: 50, 51: 40}
