"""Lossy encoders of vectors, trained on a sample with NumPy and applied to Arrow batches.

Global families are trained once; local ones keep what they need with each leaf. All decode to 64-bit floats; a scan
scores decoded vectors, so a query's look-up tables are a matrix product over whole leaves.
"""

from __future__ import annotations

import numpy as np

SIGMAS = 2.7


def kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 42, start: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's algorithm from a k-means++ start; an empty cluster takes the farthest point."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    if start is None:
        c = np.empty((k, x.shape[1]))
        c[0] = x[rng.integers(len(x))]
        d = ((x - c[0]) ** 2).sum(1)
        for i in range(1, k):
            total = d.sum()
            c[i] = x[rng.choice(len(x), p=d / total)] if total > 0 else x[rng.integers(len(x))]
            d = np.minimum(d, ((x - c[i]) ** 2).sum(1))
    else:
        c = start.astype(np.float64).copy()
    before = None
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        a = d.argmin(1)
        if before is not None and (a == before).all():
            break
        before = a
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        full = n > 0
        c[full] = s[full] / n[full, None]
        for e in np.flatnonzero(~full):
            c[e] = x[d[np.arange(len(x)), a].argmax()]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


class Global:
    local = False

    def fit(self, x: np.ndarray) -> Global:
        raise NotImplementedError

    def encode(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode(self, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class ProductQuantizer(Global):
    """Sub-spaces with a codebook each; optionally behind a learned rotation."""

    def __init__(self, m: int | None = None, bits: int = 8, rotate: bool = False):
        self.m, self.bits, self.rotate = m, bits, rotate

    def _split(self, dim: int) -> None:
        self.m = self.m or max(1, dim // 4)
        self.edges = np.linspace(0, dim, self.m + 1).astype(int)

    def fit(self, x):
        self._split(x.shape[1])
        self.rotation = np.eye(x.shape[1])
        self.books = self._books(x)
        for _ in range(6 if self.rotate else 0):
            # the rotation that fits the decoded vectors best, then codebooks anew from where they were
            left, _, right = np.linalg.svd(x.T @ self._plain(self._codes(x @ self.rotation)))
            self.rotation = left @ right
            self.books = self._books(x @ self.rotation, self.books)
        return self

    def _books(self, x, start=None):
        return [kmeans(x[:, a:b], 1 << self.bits, 25, 42 + i, None if start is None else start[i]) for i, (a, b) in enumerate(zip(self.edges, self.edges[1:]))]

    def _codes(self, x):
        return np.stack([nearest(x[:, a:b], c) for a, b, c in zip(self.edges, self.edges[1:], self.books)], 1).astype(np.uint8)

    def _plain(self, codes):
        return np.hstack([c[codes[:, i]] for i, c in enumerate(self.books)])

    def encode(self, x):
        return self._codes(x @ self.rotation)

    def decode(self, codes):
        return self._plain(codes) @ self.rotation.T


class AnisotropicQuantizer(ProductQuantizer):
    """Codes that weigh the error along a vector more than the error across it, as inner products feel it."""

    def __init__(self, m: int | None = None, bits: int = 4, threshold: float = 0.2):
        super().__init__(m, bits)
        self.eta = max(1.0, 1 / threshold**2 - 1)

    def encode(self, x):
        codes = super().encode(x)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(n > 0, n, 1)
        # across error counts once, along error eta / (dim - 1) times more; one sub-space at a time
        extra = self.eta / max(1, x.shape[1] - 1)
        for _ in range(3):
            residual = x - self._plain(codes)
            along = (residual * u).sum(1)
            for i, (a, b, c) in enumerate(zip(self.edges, self.edges[1:], self.books)):
                rest = along - (residual[:, a:b] * u[:, a:b]).sum(1)
                part = x[:, a:b]
                error = ((part[:, None] - c) ** 2).sum(2)
                line = rest[:, None] + ((part * u[:, a:b]).sum(1)[:, None] - u[:, a:b] @ c.T)
                codes[:, i] = (error + extra * line**2).argmin(1)
                residual[:, a:b] = part - c[codes[:, i]]
                along = rest + (residual[:, a:b] * u[:, a:b]).sum(1)
        return codes


class ResidualQuantizer(Global):
    """Sub-spaces of several additive levels each; encoding keeps the best few partial codes of each level."""

    def __init__(self, splits: int = 8, levels: int = 2, bits: int = 4, beam: int = 4):
        self.splits, self.levels, self.bits, self.beam = splits, levels, bits, beam

    def fit(self, x):
        self.splits = next(s for s in range(min(self.splits, x.shape[1]), 0, -1) if x.shape[1] % s == 0)
        self.width = x.shape[1] // self.splits
        self.books = []
        for s in range(self.splits):
            rest, levels = x[:, s * self.width : (s + 1) * self.width].copy(), []
            for level in range(self.levels):
                c = kmeans(rest, 1 << self.bits, 20, 42 + 100 * s + level)
                levels.append(c)
                rest -= c[nearest(rest, c)]
            self.books.append(levels)
        return self

    def encode(self, x):
        out = np.empty((len(x), self.splits * self.levels), np.uint8)
        for s in range(self.splits):
            part = x[:, s * self.width : (s + 1) * self.width]
            codes, rest = np.zeros((len(x), 1, 0), np.uint8), part[:, None, :]
            for c in self.books[s]:
                d = ((rest[:, :, None, :] - c) ** 2).sum(3).reshape(len(x), -1)
                keep = np.argsort(d, 1, kind="stable")[:, : self.beam]
                parent, code = keep // len(c), keep % len(c)
                rows = np.arange(len(x))[:, None]
                codes = np.concatenate([codes[rows, parent], code[:, :, None].astype(np.uint8)], 2)
                rest = rest[rows, parent] - c[code]
            out[:, s * self.levels : (s + 1) * self.levels] = codes[:, 0]
        return out

    def decode(self, codes):
        return np.hstack([sum(c[codes[:, s * self.levels + i]] for i, c in enumerate(self.books[s])) for s in range(self.splits)])


def pack4(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), codes.dtype)])
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def unpack4(packed: np.ndarray, dim: int) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :dim]


class ScalarQuantizer(Global):
    """16 levels a dimension: where a Lloyd iteration puts them, evenly over mean +- 2.7 deviations, or of one common
    shape scaled and shifted by dimension."""

    def __init__(self, kind: str = "lloydmax"):
        self.kind = kind

    def fit(self, x):
        self.dim = x.shape[1]
        mean, deviation = x.mean(0), x.std(0)
        if self.kind == "uniform":
            self.levels = uniform_levels(mean, deviation)
            return self
        levels = np.quantile(x, (np.arange(16) + 0.5) / 16, axis=0).T
        levels = np.sort(levels + 1e-12 * np.arange(16), axis=1)
        for _ in range(15):
            codes = self._nearest(x, levels)
            for d in range(self.dim):
                n = np.bincount(codes[:, d], minlength=16)
                s = np.bincount(codes[:, d], x[:, d], 16)
                levels[d, n > 0] = s[n > 0] / n[n > 0]
            levels.sort(axis=1)
        if self.kind == "shape":
            low, step, shape = levels[:, 0], np.maximum(levels[:, -1] - levels[:, 0], 1e-12), np.linspace(0, 1, 16)
            for _ in range(8):
                shape = ((levels - low[:, None]) * step[:, None]).sum(0) / (step**2).sum()
                centred = shape - shape.mean()
                step = ((levels - levels.mean(1, keepdims=True)) * centred).sum(1) / max((centred**2).sum(), 1e-12)
                low = levels.mean(1) - step * shape.mean()
            levels = np.sort(low[:, None] + step[:, None] * shape, axis=1)
        self.levels = levels
        return self

    @staticmethod
    def _nearest(x, levels):
        edges = (levels[:, 1:] + levels[:, :-1]) / 2
        return np.stack([np.searchsorted(edges[d], x[:, d], "left") for d in range(x.shape[1])], 1).astype(np.uint8)

    def encode(self, x):
        return pack4(self._nearest(x, self.levels))

    def decode(self, codes):
        return self.levels[np.arange(self.dim), unpack4(codes, self.dim)]


def uniform_levels(mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    step = np.maximum(2 * SIGMAS * deviation / 15, 1e-8)
    return (mean - SIGMAS * deviation)[:, None] + step[:, None] * np.arange(16)


class LocalScalar:
    """16 even levels a dimension, from each leaf's own mean and deviation."""

    local = True

    def fit(self, x):
        self.dim = x.shape[1]
        return self

    def encode_leaf(self, x: np.ndarray) -> tuple[np.ndarray, bytes]:
        deviation = x.std(0)
        low = x.mean(0) - SIGMAS * deviation
        step = np.maximum((2 * SIGMAS * deviation) / 15, 1e-8)
        low, step = low.astype(np.float32).astype(np.float64), step.astype(np.float32).astype(np.float64)
        codes = np.clip(np.floor((x - low) / step + 0.5), 0, 15).astype(np.uint8)
        return pack4(codes), np.stack([low, step]).astype("<f4").tobytes()

    def decode_leaf(self, codes: np.ndarray, state: bytes) -> np.ndarray:
        low, step = np.frombuffer(state, "<f4").reshape(2, -1).astype(np.float64)
        return low + step * unpack4(codes, self.dim)


class LocalProduct:
    """Product quantisation of the residuals to each leaf's centroid, with codebooks of its own."""

    local = True

    def __init__(self, m: int | None = None, bits: int = 4):
        self.m, self.bits = m, bits

    def fit(self, x):
        self.dim = x.shape[1]
        self.m = self.m or max(1, self.dim // 4)
        while self.dim % self.m:
            self.m -= 1
        return self

    def encode_leaf(self, x: np.ndarray) -> tuple[np.ndarray, bytes]:
        centre = x.mean(0)
        q = ProductQuantizer(self.m, self.bits).fit(x - centre)
        books = np.zeros((self.m, 1 << self.bits, self.dim // self.m))
        for i, c in enumerate(q.books):
            books[i, : len(c)] = c
        return q.encode(x - centre), np.concatenate([centre, books.ravel()]).astype("<f4").tobytes()

    def decode_leaf(self, codes: np.ndarray, state: bytes) -> np.ndarray:
        v = np.frombuffer(state, "<f4").astype(np.float64)
        books = v[self.dim :].reshape(self.m, 1 << self.bits, -1)
        return v[: self.dim] + np.hstack([books[i][codes[:, i]] for i in range(self.m)])


FAMILIES = {
    "pq": lambda m, bits: ProductQuantizer(m, bits or 8),
    "opq": lambda m, bits: ProductQuantizer(m, bits or 8, rotate=True),
    "anisotropic_pq": lambda m, bits: AnisotropicQuantizer(m, bits or 4),
    "prq": lambda m, bits: ResidualQuantizer(splits=m or 16, bits=bits or 4),
    "local_pq": lambda m, bits: LocalProduct(m, bits or 4),
    "local_scalar": lambda m, bits: LocalScalar(),
    "scalar_lloydmax": lambda m, bits: ScalarQuantizer("lloydmax"),
    "scalar_uniform": lambda m, bits: ScalarQuantizer("uniform"),
    "scalar_shape": lambda m, bits: ScalarQuantizer("shape"),
}


def make(name: str, m: int | None = None, bits: int | None = None):
    """A quantizer by family name; the scalar ones have 4 bits only."""
    if name not in FAMILIES:
        raise ValueError(f"unknown quantizer {name!r}; there are {', '.join(sorted(FAMILIES))}")
    if "scalar" in name and bits not in (None, 4):
        raise ValueError(f"{name} has 4-bit codes only")
    return FAMILIES[name](m, bits)


# --- routing planes: coarse projections that rank leaves by their best member -------------------------------------


class Plane:
    """A projection on principal axes, kept as signs with a scale or as 16 levels, with or without a factor a vector."""

    def __init__(self, kind: str = "sign", dims: int = 128):
        if kind not in ("sign", "level", "level_scaled"):
            raise ValueError(f"unknown plane {kind!r}")
        self.kind, self.dims = kind, dims

    def fit(self, x: np.ndarray) -> Plane:
        self.mean = x.mean(0)
        self.basis = principal_axes(x, self.dims)
        p = (x - self.mean) @ self.basis
        self.scale = float(np.abs(p).mean())
        self.levels = kmeans(p.ravel()[: 1 << 16, None], 16, 50).ravel()
        self.levels.sort()
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Decoded projections; the factors of the scaled kind are the least-squares ones."""
        p = (x - self.mean) @ self.basis
        if self.kind == "sign":
            return np.where(p >= 0, self.scale, -self.scale)
        q = self.levels[np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, p)]
        if self.kind == "level_scaled":
            q = q * ((p * q).sum(1, keepdims=True) / np.maximum((q * q).sum(1, keepdims=True), 1e-12))
        return q

    def project(self, q: np.ndarray) -> np.ndarray:
        return q @ self.basis


def principal_axes(x: np.ndarray, dims: int) -> np.ndarray:
    """The leading eigenvectors of the covariance, each with its largest component positive."""
    c = x - x.mean(0)
    _, v = np.linalg.eigh(c.T @ c / max(1, len(x) - 1))
    v = v[:, ::-1][:, : min(dims, x.shape[1])]
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
