"""Eigenpairs of a symmetric matrix by contour integration (FEAST).

An interval that holds c eigenvalues is projected out by a quadrature of the
resolvent along a circle around it: sums of complex shifted solves of a few
more than c random vectors.  A Rayleigh-Ritz step on what is left gives the
eigenpairs; it is repeated until their residuals are at rounding level.  The
inertia of the matrix shifted by an interval's ends (signs of the pivots of a
symmetric factorisation) counts the eigenvalues inside, so none is missed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

POINTS = 8  # Gauss-Legendre points on the upper half circle
MOST = 16  # eigenvalues wanted in one interval, unless they are as good as equal
ROUNDS = 20
NARROW = 1e-6  # an interval of this part of the largest eigenvalue is not cut further
ROUNDING = float(np.finfo(np.float64).eps)


def count_above(a: np.ndarray, shift: float) -> int:
    """The number of eigenvalues above ``shift``: positive pivots of a - shift I,
    factorised with symmetric pivoting in blocks of one or two."""
    m = a - shift * np.eye(len(a))
    scale = np.abs(a).sum(1).max() + abs(shift)
    alpha, above = (1 + 17**0.5) / 8, 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        p = int(diagonal.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        r, q = divmod(int(off.argmax()), len(m))
        if diagonal[p] >= alpha * off[r, q]:
            pivot = m[p, p]
            if abs(pivot) <= ROUNDING * ROUNDING * scale:
                break  # what is left is zero: eigenvalues at the shift itself
            above += pivot > 0
            rest = np.delete(np.arange(len(m)), p)
            column = m[rest, p]
            m = m[np.ix_(rest, rest)] - np.outer(column, column) / pivot
        else:  # a block of two has one pivot of each sign
            above += 1
            rest = np.delete(np.arange(len(m)), [r, q])
            block, columns = m[np.ix_([r, q], [r, q])], m[np.ix_(rest, [r, q])]
            m = m[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
    return int(above)


def intervals(a: np.ndarray, low: float, wanted: int) -> list[tuple[float, float, int]]:
    """Disjoint (from, to, count) above ``low`` that hold the ``wanted`` largest eigenvalues, from the top."""
    top = float(np.abs(a).sum(1).max()) * 1.01
    known = {low: count_above(a, low), top: 0}
    least = NARROW * top
    done, taken, todo = [], 0, [(low, top)]
    while todo and taken < wanted:
        lo, hi = todo.pop()
        inside = known[lo] - known[hi]
        if not inside:
            continue
        if inside > MOST and hi - lo > least or (lo == low and hi - lo > 0.5 * hi and inside > 1):
            cut = (lo + hi) / 2
            known[cut] = count_above(a, cut)
            todo += [(lo, cut), (cut, hi)]
        else:
            done.append((lo, hi, inside))
            taken += inside
    return done


def projector(a: np.ndarray, lo: float, hi: float) -> Callable[[np.ndarray], np.ndarray]:
    """The quadrature of the resolvent around [lo, hi], applied to real vectors."""
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angle = np.pi / 2 * (1 - nodes)  # 0 to pi; the lower half is the conjugate
    centre, radius = (lo + hi) / 2, (hi - lo) / 2
    circle = np.exp(1j * angle)
    shifted = [(centre + radius * c) * np.eye(len(a)) - a for c in circle]

    def apply(y: np.ndarray) -> np.ndarray:
        return sum(w / 2 * radius * (c * np.linalg.solve(m, y.astype(complex))).real for w, c, m in zip(weights, circle, shifted, strict=True))

    return apply


def ritz(a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of ``a`` within the span of the columns of ``q``."""
    u, s, _ = np.linalg.svd(q, full_matrices=False)
    u = u[:, s > ROUNDING * len(a) * s[0]]
    e, v = np.linalg.eigh(u.T @ a @ u)
    return e, u @ v


def inside(a: np.ndarray, lo: float, hi: float, count: int, seed: int = 0) -> np.ndarray:
    """Orthonormal eigenvectors of the ``count`` eigenvalues in (lo, hi]."""
    d, scale = len(a), float(np.abs(a).sum(1).max())
    rng = np.random.default_rng(seed)
    pad = max((hi - lo) * 1e-3, 16 * ROUNDING * scale)  # an eigenvalue at an end is inside the circle
    apply = projector(a, lo - pad, hi + pad)
    size = min(d, count + count // 2 + 4)
    while size < d:
        y = rng.standard_normal((d, size))
        for _ in range(ROUNDS):
            e, y = ritz(a, apply(y))
            near = np.argsort(np.maximum(0, np.maximum(lo - e, e - hi)), kind="stable")[:count]
            residual = np.abs(a @ y[:, near] - y[:, near] * e[near]).max() if len(near) == count else np.inf
            if residual <= 8 * d * ROUNDING * scale:
                return ritz(a, apply(y[:, near]))[1]
            if y.shape[1] < size:  # fill up what the projection made dependent
                y = np.concatenate([y, rng.standard_normal((d, size - y.shape[1]))], axis=1)
        size *= 2  # neighbours crowd the interval's ends: more vectors for them
    e, y = ritz(a, np.eye(d))  # the whole space needs no projection
    return y[:, np.argsort(np.maximum(0, np.maximum(lo - e, e - hi)), kind="stable")[:count]]


def largest(a: np.ndarray, wanted: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above ``floor`` (all, if fewer), falling,
    and their unit eigenvectors as columns, each with its largest entry positive."""
    parts = intervals(a, floor, wanted)
    if not parts:
        return np.zeros(0), np.zeros((len(a), 0))
    found = np.concatenate([inside(a, lo, hi, n, i) for i, (lo, hi, n) in enumerate(parts)], axis=1)
    e, v = ritz(a, found)  # neighbours of two intervals become orthogonal
    need, lowest = sum(n for _, _, n in parts), parts[-1][0]
    if len(e) != need or (e < lowest - 64 * ROUNDING * len(a) * np.abs(e).max()).any():
        raise ArithmeticError(f"the inertia counts {need} eigenvalues, {len(e)} were found")
    order = np.argsort(-e, kind="stable")[:wanted]
    e, v = e[order], v[:, order]
    return e, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
