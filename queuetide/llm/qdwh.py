"""Eigenvectors of a symmetric matrix by QDWH spectral divide and conquer.

The polar factor of the shifted matrix is the matrix sign, which gives the projector on
the eigenvectors above the shift. Bases of its range and of the range's complement
split the matrix into two smaller ones, and so on down to single components. The matrix
has the size of a vector squared, whatever the number of vectors.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    x = a / np.linalg.norm(a)
    least = EPS  # a lower bound of the smallest singular value; smaller ones cost a few more rounds
    for _ in range(80):
        square = least * least
        d = np.cbrt(4 * (1 - square) / square**2)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        least = min(least * (wa + wb * square) / (1 + wc * square), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 4 * np.sqrt(n) * EPS ** (2 / 3) and least > 0.99:
            break
    return x


def _range(projector: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    basis, _ = np.linalg.qr(projector @ draw.standard_normal((len(projector), k)))
    return np.linalg.qr(projector @ basis)[0]


def _split(a: np.ndarray, scale: float, draw: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that make ``a`` diagonal to working precision."""
    n = len(a)
    middle = float(np.trace(a)) / n
    if n == 1 or np.linalg.norm(a - middle * np.eye(n)) <= 2 * n * EPS * scale:
        return np.eye(n)
    for shift in (float(np.median(np.diag(a))), middle, *(middle + scale * EPS * n * t for t in (2, -2, 5, -5, 11, -11))):
        sign = polar_factor(a - shift * np.eye(n))
        k = int(round((np.trace(sign) + n) / 2))
        if 0 < k < n and np.linalg.norm(sign @ sign - np.eye(n)) < 1e-8:
            break
    else:
        return np.eye(n)  # eigenvalues equal to working precision: any basis will do
    above = (np.eye(n) + sign) / 2
    basis = np.hstack([_range(above, k, draw), _range(np.eye(n) - above, n - k, draw)])
    basis, _ = np.linalg.qr(basis)
    inner = basis.T @ a @ basis
    inner = (inner + inner.T) / 2
    basis[:, :k] = basis[:, :k] @ _split(inner[:k, :k], scale, draw)
    basis[:, k:] = basis[:, k:] @ _split(inner[k:, k:], scale, draw)
    return basis


def eigenpairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit eigenvectors (columns)."""
    v = (v + v.T) / 2
    scale = float(np.linalg.norm(v))
    if scale == 0:
        return np.zeros(len(v)), np.eye(len(v))
    draw = np.random.default_rng(12)
    basis = _split(v / scale, 1.0, draw)
    # What rounding left beside the diagonal is turned away where two values are apart; twice for safety.
    for _ in range(2):
        inner = basis.T @ (v / scale) @ basis
        values = np.diag(inner)
        apart = values[None, :] - values[:, None]
        turn = np.where(np.abs(apart) > 16 * np.abs(inner) + EPS, inner / np.where(apart == 0, 1, apart), 0)
        np.fill_diagonal(turn, 0)
        basis, upper = np.linalg.qr(basis + basis @ turn)
        basis *= np.sign(np.diag(upper))
    values = np.einsum("ij,ij->j", basis, v @ basis)
    order = np.argsort(-values, kind="stable")
    return values[order], basis[:, order]
