"""Nearest vectors and whitening, against brute force and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexatlas.llm import qd, vantage as V, whitening as W
from hexatlas.llm.base import table
from hexatlas.llm.vectors import matrix

ODD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 1.0, 0.0]]


@pytest.fixture
def vectors(spark):
    """An embeddings table from ``(vec_id, vector)`` pairs, with columns whose names the operators use."""
    def make(rows):
        return spark.createDataFrame([(i, v, 1, "a", 2.0) for i, v in rows],
                                     "vec_id long, embedding array<double>, k1 int, region string, x double")
    return make


def cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def brute(rows, k=5, every=50):
    usable = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v
                                               and all(c is not None and math.isfinite(c) for c in v)) if any(v)]
    found = set()
    for q, a in usable:
        if q % every == 0:
            near = sorted((-cos(a, b), c) for c, b in usable if (c, b) != (q, a))[:k]
            found |= {(q, r + 1, c, round(-s, 12)) for r, (s, c) in enumerate(near)}
    return found


def got(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in df.collect()}


def clustered(seed, n, width=12, clusters=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return [(int(i), [float(x) for x in centres[i % clusters] + rng.normal(size=width) * 0.2]) for i in range(n)]


@pytest.mark.parametrize("sizes", [dict(), dict(shard_rows=40, query_rows=3, sample=100), dict(shard_rows=7, query_rows=1)])
def test_factor_one_is_exact_over_any_shards(vectors, sizes):
    rows = clustered(1, 700)
    assert got(V.search(vectors(rows), factor=1.0, every=10, **sizes)) == brute(rows, every=10)


def test_relaxed_search_keeps_its_recall(vectors):
    rows = clustered(2, 3000, width=16, clusters=40)
    want = brute(rows, every=30)
    for factor, least in ((1.5, 0.95), (3.0, 0.5)):
        found = got(V.search(vectors(rows), factor=factor, every=30, shard_rows=200))
        assert len(found) == len(want)
        assert len({x[:1] + x[2:3] for x in found} & {x[:1] + x[2:3] for x in want}) >= least * len(want)


def test_registered_search_has_the_recall_it_claims(spark, sf):
    known = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    found, want = got(V.vantage(spark, sf)), brute(known)
    assert len({x[:1] + x[2:3] for x in found} & {x[:1] + x[2:3] for x in want}) >= 0.95 * len(want)
    assert {(q, r, s) for q, r, _, s in found} and len(found) == len(want)


def test_nearest_ties_copies_and_odd_rows(vectors):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 900, 1)] + [(0, [1.0, 2.0, 3.0])] * 30 + [(0, [3.0, 2.0, 1.0])]
    rows += [(1000 + i, v) for i, v in enumerate(ODD)] + [(None, [1.0, 2.0, 3.0]), (2000, [2.0, 4.0, 6.0]), (2050, [1e200, -1e200, 0.0]),
                                                         (2051, [1e-200, -1e-200, 0.0]), (2100, [5.0])]
    found = got(V.search(vectors(rows), factor=1.0, shard_rows=2))
    assert {x[:3] for x in found if x[0] == 50} == {(50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3), (50, 5, 4)}
    assert (0, 1, 1, 1.0) in found and (0, 5, 5, 1.0) in found and (2000, 1, 0, 1.0) in found
    # id 0 has a second vector, which is a query of its own with its copies as candidates
    assert (0, 2, 0, round(10 / 14, 12)) in found
    assert (2050, 1, 2051, 1.0) in found and {x[0] for x in found} == {i for i in range(0, 900, 50)} | {2000, 2050, 2100}
    assert not {x[2] for x in found} & {1000 + i for i in range(6)}
    few = vectors([(50, [1.0, 0.0]), (51, [1.0, 1.0]), (52, [0.0, 0.0])])
    assert got(V.search(few)) == {(50, 1, 51, round(0.5 ** 0.5, 12))}
    assert V.search(few.limit(0)).count() == 0 and V.search(vectors([(50, None)])).count() == 0
    assert V.search(vectors([(50, [1.0])])).count() == 0
    with pytest.raises(ValueError):
        V.search(few, factor=0.5)


def test_bounds_leave_what_they_must():
    rng = np.random.default_rng(3)
    points, asked = (V.unit(rng.normal(size=(n, 6))) for n in (900, 60))
    tree = V.VantageTree(points, leaf=50, tight=False)
    home = tree.route(points)
    d = V.distances(asked, points)
    limit = np.sort(d, axis=1)[:, 4]
    at, leaf = tree.reach(asked, limit, 1.0)
    left = set(zip(at.tolist(), leaf.tolist()))
    assert all((q, home[p]) in left for q, p in zip(*np.nonzero(d <= limit[:, None])))
    assert len(tree.reach(asked, limit, 3.0)[0]) < len(at) <= len(asked) * len(tree.leaves)
    same = V.VantageTree(np.ones((300, 4)) / 2.0, leaf=10)
    assert same.nearest(np.ones((1, 4)) / 2.0, 3)[0][0, :3].max() < 1e-7


# --- whitening ------------------------------------------------------------------------

def test_qd_solver_against_a_dense_one():
    rng = np.random.default_rng(4)
    cases = [rng.normal(size=(40, 40)), np.diag([5.0, 5.0, 5.0, 1.0]), np.zeros((3, 3)), np.array([[2.0]]), np.eye(20),
             np.diag([3.0, 0.0, 2.0]), rng.normal(size=(30, 5)) @ rng.normal(size=(5, 12)),
             np.eye(25) + 1e-9 * rng.normal(size=(25, 25)), 1e150 * rng.normal(size=(6, 6)), 1e-150 * rng.normal(size=(6, 6))]
    for m in cases:
        r = np.linalg.qr(m, mode="r")
        n = m.shape[1]
        r = np.concatenate([r, np.zeros((n - len(r), n))])
        values, z = qd.right_singular(r, min(4, n))
        size = np.linalg.norm(m, 2) or 1.0
        dense = np.linalg.svd(r, compute_uv=False)
        assert np.abs(values - dense).max() <= 1e-13 * size
        assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-11
        assert np.abs((m / size).T @ ((m / size) @ z) - z * (values[:z.shape[1]] / size) ** 2).max() < 1e-12


def test_small_singular_values_keep_their_digits():
    """A graded bidiagonal matrix: each value to relative accuracy, which its square would lose."""
    d, e = 10.0 ** -np.arange(0, 24, 2.0), 10.0 ** -np.arange(1, 23, 2.0) / 3
    from fractions import Fraction
    values = qd.singular_values(d, e)
    exact = Fraction(1)
    for x in d:
        exact *= Fraction(x)
    product = Fraction(1)
    for v in values:
        product *= Fraction(float(v))
    assert abs(float(product / exact) - 1) < 1e-12


def whitened_by_numpy(rows, k=4):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (width - len(v)) for _, v in kept])
    fit = np.unique(x, axis=0)
    n, centred = len(fit), fit - fit.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    deviation = ((n * x - fit.sum(axis=0)) ** 2).sum(axis=1)
    return [i for i, _ in kept], n, deviation, (x - fit.mean(axis=0)) @ directions / np.sqrt(values), values / centred.var(axis=0).sum()


def check_whitened(df, rows, k=4):
    ids, n, deviation, want, explained = whitened_by_numpy(rows, k)
    out = df.toPandas()
    assert len(out) == len(ids) * k
    assert set(out["n"]) == {n} and out["identity_error"].max() < 1e-9 and out["identity_error"].nunique() == 1
    for c in range(k):
        part = out[out["component"] == c + 1]
        assert sorted(zip(part["vec_id"], part["deviation"])) == sorted(zip(ids, deviation.tolist()))
        have = part.sort_values(["vec_id", "whitened"])["whitened"].to_numpy()
        diffs = [np.abs(have - np.array([w for _, w in sorted(zip(ids, sign * want[:, c]))])).max() for sign in (1, -1)]
        assert min(diffs) < 1e-9
        assert abs(part["explained"].iloc[0] - explained[c]) < 1e-12


def test_whitening_equals_numpy(spark, sf):
    t = table(spark, sf, "embeddings")
    check_whitened(W.whitening(spark, sf), [(r["vec_id"], r["embedding"]) for r in t.collect()])


def test_whitening_of_copies_and_odd_rows(vectors):
    rows = clustered(5, 300, width=6) + [(7, [1.0] * 6)] * 50 + [(900, [2.0, 1.0]), (901, []), (902, [0.0] * 6)]
    odd = [(1000 + i, v) for i, v in enumerate(ODD) if i not in (1, 2)]
    check_whitened(W.whiten(vectors(rows + odd)), rows)
    assert W.whiten(vectors([])).count() == 0 and W.whiten(vectors([(1, None)])).count() == 0
    assert W.whiten(vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = W.whiten(vectors([(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (None, [3.0, 6.0, 0.0])]))
    assert [(r["vec_id"], r["component"], r["n"]) for r in line.orderBy("whitened").collect()] in (
        [(1, 1, 3), (2, 1, 3), (None, 1, 3)], [(None, 1, 3), (2, 1, 3), (1, 1, 3)])
    huge = W.whiten(vectors([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r["deviation"] for r in huge} == {None} or all(r["deviation"] is None for r in huge if r["vec_id"] != 3)


def test_triangles_meet_in_rounds(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, size=(500, 7))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(40)
    mean = x.mean(axis=0)
    r = W.triangle(fit, mean, fan=3)
    assert np.abs(r.T @ r - (x - mean).T @ (x - mean)).max() < 1e-6
    model = W.fitted(fit, components=7, fan=3)
    assert model.identity_error < 1e-10 and abs(model.eigenvalues.sum() / model.trace - 1) < 1e-12


def test_ragged_lists_are_filled_up():
    import pyarrow as pa
    assert matrix(pa.array([[1.0], [], [2.0, 3.0]]), 2).tolist() == [[1.0, 0.0], [0.0, 0.0], [2.0, 3.0]]
    assert matrix(pa.array([[9.0, 9.0], [1.0], [2.0, 3.0]])[1:], 2).tolist() == [[1.0, 0.0], [2.0, 3.0]]
