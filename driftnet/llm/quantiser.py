"""Score-aware four-bit product quantisation: residuals along a vector cost more than those across it."""

from __future__ import annotations

import numpy as np

CODES = 16
SUB = 4
#: Scores from this share of the norm on should be kept right; sets how much more a residual's part
#: along the vector costs than the rest.
SCORE = 0.2


def along_weight(dims: int, score: float = SCORE) -> float:
    return max(1.0, (dims - 1) * score**2 / (1 - score**2))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        score = x @ c.T if spherical else x @ c.T - 0.5 * (c * c).sum(axis=1)
        near = score.argmax(axis=1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[some])[:-1]]), axis=0)
        c[some] = sums / (np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) if spherical else n[some, None])
    return c


def _solve(u: np.ndarray, weight: float, diagonal: np.ndarray, goal: np.ndarray, start: np.ndarray, most: int = 200) -> np.ndarray:
    """z of (weight u'u + diag(diagonal)) z = goal by conjugate gradients, without forming u'u."""
    times = lambda z: weight * (u.T @ (u @ z.astype(np.float32))).astype(np.float64) + diagonal * z
    scale = weight * np.einsum("nm,nm->m", u, u) + diagonal
    z = start.astype(np.float64)
    r = goal - times(z)
    y = r / scale
    p, ry, small = y, r @ y, 1e-10 * (goal @ (goal / scale))
    for _ in range(most):
        if ry <= small:
            break
        ap = times(p)
        step = ry / (p @ ap)
        z, r = z + step * p, r - step * ap
        y = r / scale
        last, ry = ry, r @ y
        p = y + ry / last * p
    return z


def lists(x: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of a coarse partition of unit vectors."""
    c = _kmeans(x, count, rounds, np.random.default_rng(seed), spherical=True)
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Quantiser:
    """Codebooks (subspaces, 16, dimensions of a subspace) for vectors of a number of dimensions divisible by the last."""

    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books.astype(np.float32), eta

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 2, most: int = 4096, seed: int = 4, sub: int = SUB) -> Quantiser:
        """Alternate anisotropic assignment and the least-squares optimal codebooks for it, on at most `most` vectors."""
        rng = np.random.default_rng(seed)
        x = x[rng.choice(len(x), min(most, len(x)), replace=False)].astype(np.float32)
        dims = x.shape[1]
        m = dims // sub
        parts = x.reshape(len(x), m, sub)
        books = np.zeros((m, CODES, sub), dtype=np.float32)
        for i in range(m):
            c = _kmeans(parts[:, i], CODES, 6, rng)
            books[i, : len(c)] = c
        out = cls(books, along_weight(dims))
        for _ in range(rounds):
            codes = out.encode(x)
            slot = (np.arange(m) * CODES + codes)[:, :, None] * sub + np.arange(sub)
            u = np.zeros((len(x), m * CODES * sub), dtype=np.float32)
            np.put_along_axis(u, slot.reshape(len(x), -1), x, axis=1)
            held = np.bincount((np.arange(m) * CODES + codes).ravel(), minlength=m * CODES).repeat(sub)
            solved = _solve(u, out.eta - 1, held + 1e-3, out.eta * u.sum(axis=0, dtype=np.float64) + 1e-3 * out.books.ravel(), out.books.ravel())
            out = cls(solved.reshape(m, CODES, sub), out.eta)
        return out

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) that lower the sum of squares plus (eta - 1) times the square along x."""
        out = np.empty((len(x), len(self.books)), dtype=np.uint8)
        for at in range(0, len(x), 2048):
            out[at : at + 2048] = self._encode(x[at : at + 2048].astype(np.float32), sweeps)
        return out

    def _encode(self, x: np.ndarray, sweeps: int) -> np.ndarray:
        parts = x.reshape(len(x), -1, self.books.shape[2])
        dots = np.einsum("nms,mcs->nmc", parts, self.books, optimize=True)
        own = (parts * parts).sum(axis=2)[:, :, None]
        square = own - 2 * dots + (self.books**2).sum(axis=2)[None]
        along = own - dots
        codes = square.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for m in range(parts.shape[1]):
                rest = total - along[rows, m, codes[:, m]]
                best = (square[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                codes[:, m] = best
                total = rest + along[rows, m, best]
        return codes.astype(np.uint8)

    @staticmethod
    def pack(codes: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    @staticmethod
    def unpack(packed: np.ndarray) -> np.ndarray:
        out = np.empty((packed.shape[0], packed.shape[1] * 2), dtype=np.uint8)
        out[:, ::2], out[:, 1::2] = packed >> 4, packed & 15
        return out

    def table(self, codes: np.ndarray) -> np.ndarray:
        """Each code's table row looked up: scores of queries are the matrix product with it.

        A query's score is the sum over subspaces of its table entry (query part times codebook entry)
        at the row's code. NumPy has no byte shuffle; looking the codebook up first and leaving the
        sums to one matrix product gives the same numbers far faster.
        """
        return self.books[np.arange(self.books.shape[0]), codes].reshape(len(codes), -1)
