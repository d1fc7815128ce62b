"""Eigenvectors of a symmetric matrix by spectral divide and conquer on polar decompositions.

The polar factor of A - s I is the matrix sign of A - s I. Half of it plus half the identity is the projector on the eigenvectors above
the shift s. A basis of its range and one of the rest cut A into two smaller matrices, which are split again. The polar factor comes from
dynamically weighted Halley steps: six or so reach full precision at any condition, each by a QR or a Cholesky factorisation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix; of a matrix without full rank, one that agrees on the range."""
    n = len(a)
    size = np.sqrt(np.abs(a).sum(0).max() * np.abs(a).sum(1).max())  # at least the spectral norm
    if not size:
        return np.eye(n)
    x, low = a / size, _least(a / size)
    for _ in range(30):
        before = x
        if low < 1 - EPS:
            gamma = (4 * (1 - low**2) / low**4) ** (1 / 3)
            root = np.sqrt(1 + gamma)
            wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * gamma + 8 * (2 - low**2) / (low**2 * root)))
        else:
            wa = 3.0
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            l = np.linalg.cholesky(np.eye(n) + wc * x.T @ x)
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(l.T, np.linalg.solve(l, x.T)).T
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if low > 1 - 10 * EPS and np.linalg.norm(x - before) <= (4 * EPS) ** (1 / 3):
            break
    return x


def _least(x: np.ndarray) -> float:
    """A lower bound of the smallest singular value, from the inverse of the triangular factor; tiny where there is none."""
    r = np.linalg.qr(x, mode="r")
    if np.abs(np.diag(r)).min() <= EPS:
        return EPS
    inverse = np.linalg.solve(r, np.eye(len(r)))
    return float(min(1.0, max(EPS, 1 / np.linalg.norm(inverse))))


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Orthonormal bases of the invariant subspaces above and below the shift, and how far they are from invariant."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(float(np.trace(projector))))
    if not 0 < rank < n:
        return np.eye(n), np.eye(n)[:, :0], np.inf
    basis = projector @ np.random.default_rng(n).standard_normal((n, rank))
    for _ in range(2):
        q, _ = np.linalg.qr(basis, mode="complete")
        basis = projector @ q[:, :rank]
    return q[:, :rank], q[:, rank:], float(np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank]))


def _parts(a: np.ndarray, basis: np.ndarray, wanted: int, size: float) -> Iterator[np.ndarray]:
    """Eigenvectors of ``a``, within ``basis``, the larger eigenvalues' first; those of at least ``wanted`` eigenvalues."""
    n = len(a)
    if n == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * size:
        yield from (basis[:, i] for i in np.argsort(-np.diag(a), kind="stable")[:wanted])
        return
    mean = float(np.trace(a)) / n
    spread = float(np.linalg.norm(a - mean * np.eye(n))) / np.sqrt(n)
    best = None
    for shift in (float(np.median(np.diag(a))), mean, *(mean + t * spread for t in (0.13, -0.13, 0.37, -0.37, 0.71, -0.71))):
        found = _split(a, shift)
        if best is None or found[2] < best[2]:
            best = found
        if best[2] <= 10 * n * EPS * size:
            break
    above, below, off = best
    if not np.isfinite(off):
        if spread > 10 * n * EPS * size:
            raise ArithmeticError("no shift parts the spectrum")
        yield from (basis[:, i] for i in range(min(n, wanted)))  # equal to double precision
        return
    yield from _parts(_symmetric(above.T @ a @ above), basis @ above, wanted, size)
    if above.shape[1] < wanted:
        yield from _parts(_symmetric(below.T @ a @ below), basis @ below, wanted - above.shape[1], size)


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def top_eigenvectors(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    A branch below the wanted ones is not split. Vectors of equal eigenvalues are any orthonormal ones; a vector's sign is such that
    its entry of largest size is positive.
    """
    a = _symmetric(np.asarray(a, np.float64))
    wanted = min(wanted, len(a))
    if not wanted:
        return np.empty(0), np.empty((len(a), 0))
    vectors = np.stack(list(_parts(a, np.eye(len(a)), wanted, float(np.linalg.norm(a)) or 1.0)), axis=1)
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
