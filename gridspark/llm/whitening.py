"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never made: a pass over the vectors yields centred XᵀXQ for a thin block Q. A polynomial recurrence of
such passes damps the part of the spectrum below the block's smallest Ritz value; QR and Rayleigh-Ritz follow, until the
residuals of the wanted pairs certify them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .storage import materialize, prepare_tasks

COMPONENTS = 8
#: Columns of the block for each wanted component: the more, the wider the gap that the filter works with.
BLOCK = 3
#: Recurrence steps of a round, each a pass; doubled, up to the second, where rounds bring too little.
DEGREE = (8, 32)
#: Residual over the largest eigenvalue that certifies a pair; the second does where rounding lets it fall no further.
CERTIFIED = (1e-13, 1e-11)
MOST_ROUNDS = 60
#: An eigenvalue under this share of the largest counts as none: there is nothing to divide by.
LEAST_EIGENVALUE = 1e-12
#: Integers end here, where doubles still hold them exactly.
MOST = 2.0**52
OFFSET = 100_000

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  #: int64, of each dimension
    basis: np.ndarray  #: dimensions x components, unit eigenvectors by falling eigenvalue
    values: np.ndarray
    residuals: np.ndarray  #: of each pair, over the largest eigenvalue
    trace: float
    passes: int

    @property
    def scaled(self) -> np.ndarray:
        return self.basis / np.sqrt(self.values)


class _Passes:
    """Products of the covariance with thin blocks, each one pass over the vectors."""

    def __init__(self, table: DataFrame, dims: int):
        self.table, self.dims, self.tasks, self.count = table, dims, table.rdd.getNumPartitions(), 0
        got = vectors.summed(table, self.tasks, lambda b: np.append(vectors.matrix(b.column("x"), dims).sum(0), b.num_rows), dims + 1, "long")
        self.sums, self.n = got[:-1], int(got[-1])
        self.mean = np.array([int(s) / self.n if self.n else 0.0 for s in self.sums])

    def __call__(self, block: np.ndarray) -> np.ndarray:
        dims, mean = self.dims, self.mean

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            x = vectors.matrix(batch.column("x"), dims) - mean
            return (x.T @ (x @ block)).ravel()

        self.count += 1
        return vectors.summed(self.table, self.tasks, partial, block.size).reshape(block.shape) / self.n

    def trace(self) -> float:
        dims, mean = self.dims, self.mean
        return float(vectors.summed(self.table, self.tasks, lambda b: np.array([np.square(vectors.matrix(b.column("x"), dims) - mean).sum()]), 1)[0]) / self.n


def _filtered(product: _Passes, block: np.ndarray, image: np.ndarray, degree: int, most: float, largest: float) -> np.ndarray:
    """The block through a Chebyshev polynomial that stays small on [0, most] and is 1 at ``largest``; ``image`` is its
    product with the covariance."""
    half = middle = most / 2
    scale = half / (largest - middle)
    twice = 2 / scale
    before, now = block, (image - middle * block) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (twice - scale)
        before, now = now, (product(now) - middle * now) * (2 * after / half) - before * (scale * after)
        scale = after
    return now


def _fit(product: _Passes, components: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading eigenvectors, eigenvalues and residuals of the covariance."""
    dims = product.dims
    k, width, degree = min(components, dims), min(dims, BLOCK * components), DEGREE[0]
    rng = np.random.default_rng(seed)
    block, last = np.linalg.qr(rng.standard_normal((dims, width)))[0], np.inf
    for _ in range(MOST_ROUNDS):
        image = product(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        if values[0] <= 0:
            return block[:, :0], values[:0], values[:0]
        away = np.linalg.norm(image[:, :k] - block[:, :k] * values[:k], axis=0) / values[0]
        worst = away.max()
        if worst <= CERTIFIED[0] or worst <= CERTIFIED[1] and worst > last / 2:
            break
        if worst > last / 10:
            degree = min(2 * degree, DEGREE[1])
        if worst > last / 2 and width < dims:  # a cluster of eigenvalues as wide as the block
            more = rng.standard_normal((dims, min(dims, 2 * width) - width))
            block = np.linalg.qr(np.hstack([block, more]))[0]
            width, last = block.shape[1], np.inf
            continue
        last = worst
        most = max(values[-1], 1e-6 * values[0])
        block = np.linalg.qr(_filtered(product, block, image, degree, min(most, 0.999 * values[0]), values[0]))[0]
    kept = values[:k] > LEAST_EIGENVALUE * values[0]
    return block[:, :k][:, kept], values[:k][kept], away[kept]


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - S)^2; null beyond a long."""
    about = np.square(n * x.astype(np.float64) - sums).sum(1)
    exact = (about < 9e18) & (np.abs(x).max(1, initial=0) * float(n) < 9e18) & (np.abs(sums).max(initial=0) < 9e18)
    out: list[int | None] = [None] * len(x)
    whole = np.square(n * x[exact] - sums).sum(1)
    for row, value in zip(np.flatnonzero(exact), whole, strict=True):
        out[row] = int(value)
    for row in np.flatnonzero(~exact):
        value = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[row], sums, strict=True))
        out[row] = value if value < 1 << 63 else None
    return out


def integer_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """A written table (vec_id, x) of the vectors that stay, and their number of entries."""
    held, dims = vectors.whole_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), MOST)
    x = F.transform("embedding", lambda c: c + OFFSET)
    return materialize(held.select("vec_id", x.alias("x")), "whitening"), dims


def fit(table: DataFrame, dims: int, components: int = COMPONENTS, seed: int = 7) -> Whitening:
    """Fit on every row of a table of ``integer_vectors``. The driver holds blocks of dims x ``BLOCK`` * components
    numbers, wider ones only where eigenvalues cluster."""
    product = _Passes(table, dims)
    if not product.n:
        return Whitening(0, product.sums, np.empty((dims, 0)), np.empty(0), np.empty(0), 0.0, 0)
    trace = product.trace()
    basis, values, away = _fit(product, components, seed) if trace else (np.empty((dims, 0)), np.empty(0), np.empty(0))
    return Whitening(product.n, product.sums, basis, values, away, trace, product.count)


def _identity_error(table: DataFrame, dims: int, model: Whitening) -> float:
    """Largest entry, in size, of the whitened rows' covariance minus the identity."""
    k, mean, scaled = len(model.values), model.sums / model.n, model.scaled

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        w = (vectors.matrix(batch.column("x"), dims) - mean) @ scaled
        return np.append((w.T @ w).ravel(), w.sum(0))

    got = vectors.summed(table, table.rdd.getNumPartitions(), partial, k * k + k) / model.n
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :]) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of ``rows`` (vec_id, embedding; other columns are ignored): a row for each vector and
    component, with ``SCHEMA``'s columns; ``residual`` is the norm of V*q - e*q over the largest eigenvalue.

    Vectors stay and become integers as in ``vectors.whole_vectors``, plus ``OFFSET``. Repeated rows each keep their
    rows; a null vec_id stays null. Components without variance are left out, so equal vectors, one alone or no vector
    at all have no rows. A deviation beyond a long is null."""
    prepare_tasks(rows.sparkSession)
    table, dims = integer_vectors(rows)
    model = fit(table, dims, components) if dims else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    k, n, sums, scaled = len(model.values), model.n, model.sums, model.scaled
    one = [float(v) for v in model.values / model.trace], _identity_error(table, dims, model), [float(r) for r in model.residuals]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, x = batch.num_rows, vectors.matrix(batch.column("x"), dims)
            row = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("vec_id").take(row),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(row),
                pa.array(((x - sums / n) @ scaled).ravel()),
                pa.array(np.tile(one[0], m)),
                pa.array(np.full(m * k, one[1])),
                pa.array(np.tile(one[2], m)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return table.mapInArrow(run, SCHEMA)
