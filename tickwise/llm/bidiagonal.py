"""Singular values and right singular vectors of a small triangular factor.

Householder reflections bring R to an upper bidiagonal B = U' R V, dqds with
Newton shifts from below gives the squared singular values with high relative
accuracy, and twisted factorisations of B'B - s^2 give each vector without
iteration; V takes the vectors back.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
NEGLIGIBLE = (10 * EPS) ** 2   # an off-diagonal square below this share of its neighbours is dropped
CLUSTER = 1e-4                 # relative gap below which vectors are made orthogonal together


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, alpha) with (I - 2 v v') x = alpha e1; v is zero for a vector that needs none."""
    alpha = -np.copysign(np.linalg.norm(x), x[0])
    v = x.copy()
    v[0] -= alpha
    size = np.linalg.norm(v)
    return (v / size, alpha) if size else (np.zeros_like(x), x[0])


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of a square matrix; reflector i acts on the entries from i + 1."""
    a = np.array(r, dtype=float)
    d = len(a)
    right = []
    for i in range(d):
        v, _ = _reflector(a[i:, i])
        a[i:, i:] -= 2 * np.outer(v, v @ a[i:, i:])
        if i < d - 2:
            w, _ = _reflector(a[i, i + 1:])
            a[i:, i + 1:] -= 2 * np.outer(a[i:, i + 1:] @ w, w)
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform: (q, e, running d), or None if the shift is above the smallest value."""
    d = q[0] - shift
    new_q, new_e, ds = [], [], [d]
    for i in range(len(e)):
        top = d + e[i]
        if d < 0 or top <= 0:
            return None
        ratio = q[i + 1] / top
        new_q.append(top)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
        ds.append(d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, ds


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Eigenvalues of B'B by dqds, falling."""
    found: list[float] = []
    todo = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while todo:
        q, e, base = todo.pop()
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= NEGLIGIBLE * max(base, min(q[i], q[i + 1]))), None)
            if not e or cut == len(e) - 1:
                found.append(base + q.pop())
                e = e[:-1]
                continue
            if cut is not None:  # two matrices without a link
                todo.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if min(q) == 0:  # singular: unshifted sweeps cut the matrix before the zero and bring it to the end
                q, e, _ = _sweep(q, e, 0.0)
                continue
            plain = _sweep(q, e, 0.0)
            if plain is None or min(plain[2]) <= 0:
                q[q.index(min(q))] = 0.0
                continue
            # 1 / d_i are the diagonal of the inverse: the reciprocal of their sum is Newton's step from below
            shift = (1 - 4 * EPS * len(q)) / sum(1 / x for x in plain[2])
            step = None
            for _ in range(4):
                step = _sweep(q, e, shift)
                if step is not None:
                    break
                shift /= 2
            q, e, shift = (*step[:2], shift) if step is not None else (*plain[:2], 0.0)
            base += shift
    return np.sort(np.array(found))[::-1]


def _twisted(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, rank: int = 0) -> np.ndarray:
    """Columns: vectors of an unreduced B'B for ``values``, twisted where the residual is (rank-th) smallest."""
    n, m = len(diagonal), len(values)
    tiny = EPS * EPS * max(float(np.max(diagonal * diagonal)), 1e-290)
    a = np.where(np.abs(diagonal) < EPS * np.abs(diagonal).max(), EPS * np.abs(diagonal).max(), diagonal)
    d, low = a * a, above / a[:-1]

    def safe(x):
        return np.where(np.abs(x) < tiny, -tiny, x)

    s, plus = np.empty((n, m)), np.empty((n - 1, m))
    s[0] = -values
    for i in range(n - 1):
        plus[i] = d[i] * low[i] / safe(d[i] + s[i])
        s[i + 1] = plus[i] * low[i] * s[i] - values
    p, minus = np.empty((n, m)), np.empty((n - 1, m))
    p[n - 1] = d[n - 1] - values
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * low[i] ** 2 + p[i + 1])
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - values
    twist = np.argsort(np.abs(s + p + values), axis=0, kind="stable")[min(rank, n - 1)]
    z = np.zeros((n, m))
    z[twist, np.arange(m)] = 1.0
    for i in range(n - 2, -1, -1):
        z[i] = np.where(i < twist, -plus[i] * z[i + 1], z[i])
    for i in range(n - 1):
        z[i + 1] = np.where(i >= twist, -minus[i] * z[i], z[i + 1])
    return z / np.linalg.norm(z, axis=0)


def _tell_apart(z: np.ndarray, values: np.ndarray, diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Orthogonal vectors of a cluster: other twists where two agree, then the cluster's own eigenvectors."""
    kept: list[np.ndarray] = []
    for j in range(len(values)):
        for rank in range(len(diagonal)):
            v = z[:, j] if rank == 0 else _twisted(diagonal, above, values[j:j + 1], rank)[:, 0]
            for _ in range(2):
                for k in kept:
                    v = v - k * (k @ v)
            size = np.linalg.norm(v)
            if size > 1e-3 or (size > 1e-10 and rank == len(diagonal) - 1):
                break
        kept.append(v / size)
    basis = np.stack(kept, axis=1)
    image = diagonal[:, None] * basis
    image[:-1] += above[:, None] * basis[1:]
    _, turn = np.linalg.eigh(image.T @ image)
    return basis @ turn[:, ::-1]


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, vectors as columns): the ``most`` largest of a square matrix, falling."""
    scale = 2.0 ** np.frexp(np.abs(r).max(initial=0.0))[1]
    diagonal, above, right = bidiagonalise(r / scale)
    limit = EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    cuts = [0, *[i + 1 for i in range(len(above)) if abs(above[i]) <= limit], len(diagonal)]
    values, vectors = [], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        a, b = diagonal[lo:hi], above[lo:hi - 1]
        found = squared_singular_values(a, b)[:most]
        z = np.ones((1, 1)) if hi - lo == 1 else _twisted(a, b, found)
        at = 0
        while at < len(found):  # runs of close values
            end = at + 1
            while end < len(found) and found[end - 1] - found[end] <= CLUSTER * found[end - 1]:
                end += 1
            if end - at > 1:
                z[:, at:end] = _tell_apart(z[:, at:end], found[at:end], a, b)
            at = end
        whole = np.zeros((len(diagonal), len(found)))
        whole[lo:hi] = z
        values.extend(found)
        vectors.append(whole)
    v = np.concatenate(vectors, axis=1)
    order = np.argsort(-np.array(values), kind="stable")[:most]
    v = v[:, order]
    for i in range(len(right) - 1, -1, -1):
        w = right[i]
        v[i + 1:] -= 2 * np.outer(w, w @ v[i + 1:])
    return np.sqrt(np.array(values)[order]) * scale, v
