"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the distributed rows.

X holds the distinct rows, centred. X V = U B with orthonormal U, V and an
upper bidiagonal B, built a column at a time: u from X v, the next v from Xᵀu.
A column of U is as long as the table, so it is never moved: u = X w for a
short w that the driver keeps, and a block of X gives its part of u, of the
products with all earlier columns (for full reorthogonalisation), and of Xᵀu in
one pass. The driver holds only d x d numbers. The SVD of B then gives the
components (V times its right vectors) and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equispark.llm.staging import staged
from equispark.llm.vectors import gridded, matrix

BLOCK_ROWS = 4096
LOW = np.int64((1 << 32) - 1)


@dataclass(frozen=True)
class Centre:
    """The number of distinct rows and their exact sum in each dimension."""

    n: int
    sums: tuple[int, ...]
    most: int  # the largest entry, signs aside

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs where they suffice, else Python's integers."""
        if self.n * self.most + max(map(abs, self.sums)) < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.moved(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over the dimensions of (n * x - sums)^2 of each row, exact."""
        moved = self.moved(x)
        if moved.dtype != object and moved.size and int(np.abs(moved).max()) ** 2 * x.shape[1] >= 1 << 62:
            moved = moved.astype(object)
        return (moved * moved).sum(axis=1).tolist()


@dataclass(frozen=True)
class Whitening:
    """Components in columns, their eigenvalues, and what share of the whole variance they are."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    def applied(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def added(parts: RDD, most: int = 256) -> np.ndarray:
    """The sum of one array a partition, over a tree where there are many."""
    add = lambda a, b: a + b
    return parts.reduce(add) if parts.getNumPartitions() <= most else parts.treeReduce(add, depth=3)


def over(blocks: RDD, dims: int, part: Callable[[np.ndarray], np.ndarray], empty: np.ndarray) -> np.ndarray:
    """The sum of part(block) over all blocks."""

    def summed(rows: Iterable) -> Iterator[np.ndarray]:
        total = empty
        for (block,) in rows:
            total = total + part(np.frombuffer(block, np.int64).reshape(-1, dims))
        yield total

    return added(blocks.mapPartitions(summed))


@dataclass
class Bidiagonalisation:
    """The columns so far: w and Xᵀu of each u, the v, and B's two diagonals."""

    product: Callable[[np.ndarray, np.ndarray], np.ndarray]  # (W, w) -> Uᵀp, p.p, Xᵀp of p = X w
    dims: int
    scale: float  # the Frobenius norm of X
    w: list[np.ndarray] = field(default_factory=list)
    g: list[np.ndarray] = field(default_factory=list)
    v: list[np.ndarray] = field(default_factory=list)
    alpha: list[float] = field(default_factory=list)
    beta: list[float] = field(default_factory=list)

    def free(self, vector: np.ndarray) -> np.ndarray:
        """The part of a vector that is orthogonal to all v, taken twice."""
        for _ in range(2 if self.v else 0):
            basis = np.array(self.v)
            vector = vector - (basis @ vector) @ basis
        return vector

    def start(self) -> np.ndarray:
        """A unit vector outside the span of all v."""
        fresh = self.free(np.random.default_rng(len(self.v)).standard_normal(self.dims))
        return fresh / np.linalg.norm(fresh)

    def step(self) -> None:
        """One more v and u. Where a column vanishes, the next v is a fresh direction, so equal deviations are all found."""
        tiny = 1e-13 * self.scale
        linked = bool(self.beta) and self.beta[-1] > 0
        v = self.next if linked else self.start()
        w = v - self.beta[-1] * self.w[-1] if linked else v
        for _ in range(3):
            basis = np.array(self.w).reshape(len(self.w), self.dims)
            found = self.product(basis.T, w)
            h, square, right = found[: len(self.w)], found[len(self.w)], found[len(self.w) + 1 :]
            left = max(square - h @ h, 0.0)
            w = w - h @ basis
            right = right - h @ np.array(self.g).reshape(len(self.g), self.dims)
            if left >= 0.5 * square or left <= tiny**2:
                break
        alpha = float(np.sqrt(left))
        if alpha <= tiny:
            alpha, w, right = 0.0, np.zeros(self.dims), np.zeros(self.dims)
        else:
            w, right = w / alpha, right / alpha
        self.v.append(v)
        self.w.append(w)
        self.g.append(right)
        self.alpha.append(alpha)
        rest = self.free(right - alpha * v)
        beta = float(np.linalg.norm(rest))
        self.beta.append(beta if beta > tiny and len(self.v) < self.dims else 0.0)
        self.next = rest / beta if beta else rest

    def solved(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(deviations, right singular vectors in columns, residuals), the largest first."""
        bidiagonal = np.diag(self.alpha) + np.diag(self.beta[:-1], 1)
        left, sigma, right = np.linalg.svd(bidiagonal)
        return sigma, np.array(self.v).T @ right.T, np.abs(left[-1]) * self.beta[-1]


def fit(rows: DataFrame, count: int = 16, tolerance: float = 0.0) -> Whitening | None:
    """The components of the distinct vectors `x` of `rows`; None where there is no spread.

    Takes one pass a dimension, which gives the whole decomposition. With a
    `tolerance` it ends as soon as the residuals of the first `count` triples
    are below it, relative to the largest deviation. Components without spread
    are left out, so there may be fewer than `count`.
    """

    def blocked(batches):
        for batch in batches:
            x = matrix(batch["x"])
            found = [x[at : at + BLOCK_ROWS].tobytes() for at in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["block"])

    first = rows.select("x").first()
    if first is None:
        return None
    dims = len(first.x)
    blocks = staged(rows.select("x").distinct().mapInArrow(blocked, "block binary"), "vectors").rdd

    def counted(x: np.ndarray) -> np.ndarray:
        """Rows and sums of the upper and lower halves, which no table overflows."""
        return np.array([len(x), *(x >> 32).sum(axis=0), *(x & LOW).sum(axis=0)], np.int64)

    totals = over(blocks, dims, counted, np.zeros(1 + 2 * dims, np.int64)).tolist()
    n, sums = totals[0], tuple((a << 32) + b for a, b in zip(totals[1 : dims + 1], totals[dims + 1 :]))
    most = blocks.map(lambda r: int(np.abs(np.frombuffer(r[0], np.int64)).max())).max()
    centre = Centre(n, sums, most)
    spread = float(over(blocks, dims, lambda x: np.array([np.square(centre.centred(x)).sum()]), np.zeros(1))[0])
    if not spread:
        return None

    def product(basis: np.ndarray, w: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            own = centre.centred(x)
            p = own @ w
            return np.concatenate([(own @ basis).T @ p, [p @ p], p @ own])

        return over(blocks, dims, part, np.zeros(basis.shape[1] + 1 + dims))

    state = Bidiagonalisation(product, dims, spread**0.5)
    for step in range(1, dims + 1):
        state.step()
        if tolerance and step >= count:
            sigma, _, residuals = state.solved()
            if (residuals[:count] <= tolerance * sigma[0]).all():
                break
    sigma, vectors, _ = state.solved()
    kept = min(count, int((sigma > 1e-12 * sigma[0]).sum()))
    eigenvalues, components = sigma[:kept] ** 2 / n, vectors[:, :kept]
    model = Whitening(centre, components, eigenvalues, eigenvalues * n / spread, 0.0)
    # Of the whitened rows: their sums, then their products centred.
    means = over(blocks, dims, lambda x: model.applied(x).sum(axis=0), np.zeros(kept)) / n

    def squares(x: np.ndarray) -> np.ndarray:
        white = model.applied(x) - means
        return white.T @ white

    covariance = over(blocks, dims, squares, np.zeros((kept, kept))) / n
    return Whitening(centre, components, eigenvalues, model.explained, float(np.abs(covariance - np.eye(kept)).max()))


def whitened(
    vectors: DataFrame, count: int = 16, scale: int = 64, shift: int = 1_000_000, vector: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component.

    Vectors are laid on a grid (vectors.gridded, which says which rows go), the
    model is fitted to the distinct ones, and every row is projected, repeated
    rows and null keys too. `deviation` is a decimal, exact at any size; null
    where 38 digits do not hold it. An empty table, or one without spread, gives
    no rows. Further columns are not read.
    """
    rows = gridded(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), scale, shift, "vector")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(rows, count)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def projected(batches):
        own = shared.value
        kept = len(own.eigenvalues)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch["x"].slice(at, BLOCK_ROWS))
                each = np.repeat(np.arange(len(x)), kept)
                deviations = [d if d < 10**38 else None for d in own.centre.deviations(x)]
                whole = pa.array(deviations, pa.int64()).cast(pa.decimal128(38, 0)) if max(filter(None, deviations), default=0) < 1 << 63 else pa.array([d if d is None else str(d) for d in deviations]).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"].slice(at, BLOCK_ROWS).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), own.centre.n)),
                        whole.take(pa.array(each)),
                        pa.array(own.applied(x).ravel()),
                        pa.array(np.tile(own.explained, len(x))),
                        pa.array(np.full(len(each), own.identity_error)),
                    ],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("key", "x").mapInArrow(projected, schema).withColumnRenamed("key", key)
