"""Singular values and right singular vectors of a small square matrix by qd transforms.

Householder reflections make the matrix bidiagonal; differential qd transforms with shifts
(dqds) find its singular values, each to high relative accuracy, because they never subtract but
for the shift itself; twisted factorisations of the shifted tridiagonal give the vectors.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues nearer than this, in relation to their size, share a cluster.
CLUSTER = 1e-3


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``d, e, v``: diagonal and upper diagonal of B, and v, with ``matrix = u @ B @ v.T``."""
    a = matrix.astype(np.float64).copy()
    n = len(a)
    v = np.eye(n)
    for k in range(n):
        h = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(2.0 * h, h @ a[k:, k:])
        if k < n - 2:
            h = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ h, 2.0 * h)
            v[:, k + 1:] -= np.outer(v[:, k + 1:] @ h, 2.0 * h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit ``h`` such that ``x - 2 h (h @ x)`` is zero but for its first entry."""
    size = np.abs(x).max(initial=0.0)
    if size == 0.0 or len(x) == 1:
        return np.zeros_like(x)
    h = x / size
    h[0] += math.copysign(np.linalg.norm(h), h[0])
    return h / np.linalg.norm(h)


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None where the shift is above the least eigenvalue."""
    new_q, new_e, d = [], [], q[0] - shift
    for i, ei in enumerate(e):
        if d < 0.0:
            return None
        top = d + ei
        new_q.append(top)
        if top == 0.0:
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / top
            new_e.append(ei * t)
            d = d * t - shift
    if d < 0.0:
        return None
    return [*new_q, d], new_e


def _least_bound(q: list[float], e: list[float]) -> float:
    """A lower bound of the least eigenvalue: one over the trace of the inverse.

    The ``d`` of a transform without shift are one over the inverse's diagonal.
    """
    d, total = q[0], 0.0
    for i in range(len(q)):
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
        if i < len(e):
            d *= q[i + 1] / (d + e[i])
    return 1.0 / total if math.isfinite(total) else 0.0


def singular_values(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix by dqds, largest first.

    Shifts are bounds from below, so they are always admissible but for rounding; a refused
    shift is halved and at last left out. Negligible entries split the problem in two.
    """
    scale = max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(d))
    found: list[float] = []
    tolerance = (10.0 * EPS) ** 2
    pending = [([float(x) ** 2 for x in d / scale], [float(x) ** 2 for x in e / scale], 0.0)]
    while pending:
        q, e_, sigma = pending.pop()
        while len(q) > 1:
            cut = next((i for i in range(len(e_) - 1, -1, -1)
                        if e_[i] <= tolerance * (sigma + min(q[i], q[i + 1])) or e_[i] == 0.0), None)
            if cut is not None:
                pending.append((q[:cut + 1], e_[:cut], sigma))
                q, e_ = q[cut + 1:], e_[cut + 1:]
                continue
            shift = _least_bound(q, e_) * (1.0 - 8.0 * EPS)
            after = _sweep(q, e_, shift)
            while after is None:
                shift = shift / 2.0 if shift > EPS * (sigma + q[-1]) else 0.0
                after = _sweep(q, e_, shift)
            (q, e_), sigma = after, sigma + shift
        found.append(sigma + q[0])
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def _twisted(d2: np.ndarray, low: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twist pivots and the multipliers of both factorisations of ``L D L' - lam``.

    The top-down (stationary) and bottom-up (progressive) transforms work on the factors, never
    on the tridiagonal's own entries.
    """
    n, tiny = len(d2), np.finfo(np.float64).tiny
    s, p = np.zeros(n), np.zeros(n)
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s[0] = -lam
    for i in range(n - 1):
        pivot = s[i] + d2[i] or tiny
        down[i] = d2[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - lam
    p[n - 1] = d2[n - 1] - lam
    for i in range(n - 2, -1, -1):
        if low[i] == 0.0:
            p[i] = d2[i] - lam
            continue
        pivot = d2[i] * low[i] * low[i] + p[i + 1] or tiny
        t = d2[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - lam
    return s + p + lam, down, up


def _solved(at: int, down: np.ndarray, up: np.ndarray) -> np.ndarray | None:
    """The vector whose only residual is the pivot at the twist."""
    z = np.zeros(len(down) + 1)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, len(down)):
        z[i + 1] = -up[i] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) else None


def right_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Unit right singular vectors (columns) of the ``count`` largest singular values.

    A vector comes from the twist of the least pivot. In a cluster of close values, further
    vectors come from other twists and are made orthogonal to the cluster's earlier ones.
    """
    scale = np.abs(d).max(initial=0.0) or 1.0
    d, e, values = d / scale, e / scale, values / scale
    safe = np.where(d == 0.0, EPS * EPS, d)
    d2, low = safe * safe, e / safe[:-1]
    out: list[np.ndarray] = []
    for j in range(count):
        lam = float(values[j] ** 2)
        pivots, down, up = _twisted(d2, low, lam)
        mates = [out[i] for i in range(j) if values[i] ** 2 - lam <= CLUSTER * lam]
        best, left = None, -1.0
        for at in np.argsort(np.abs(pivots), kind="stable"):
            z = _solved(int(at), down, up)
            if z is None:
                continue
            for _ in range(2):
                for m in mates:
                    z = z - (m @ z) * m
            size = float(np.linalg.norm(z))
            if size > left:
                best, left = z / (size or 1.0), size
            if size > 0.5:
                break
        out.append(best)
    return np.array(out).T.reshape(len(d), count)


def right_singular(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of a square matrix and its first ``count`` right singular vectors."""
    d, e, v = bidiagonal(matrix)
    values = singular_values(d, e)
    return values, v @ right_vectors(d, e, values, count)
