"""Whitening of embeddings by the leading eigenvectors of their covariance (LOBPCG).

The covariance is never formed. A round multiplies it with a block of a few
directions: tasks centre their rows, multiply them by the block and by its
products, and Spark adds the tasks' d x k matrices row by row. On the driver a
Rayleigh-Ritz step over the iterate, its residuals and the directions of the
round before gives the next iterate. What the driver and the closures hold is
of that size, whatever the number of vectors.

A round's products are those of its whole orthonormal basis, so the residuals
|V u - e u| of the eigenpairs that come out of it are measured, not updated;
whitening starts once all wanted ones are at rounding error. By Weyl's bound an
eigenvalue is then off by no more than its residual.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import checkpointed

COMPONENTS = 16
#: Directions of the block beyond those wanted: the gap that convergence depends on lies behind them.
GUARD = 8
MOST_ROUNDS = 500
#: Entries are counted in steps of 1/SCALE, from OFFSET; larger ones than LARGEST do not fit a long and count as not finite.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**56

_ROWS = 8192
_LONG = 2**63 - 1
_EPS = float(np.finfo(float).eps)


def usable(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): rows with a whole finite vector, as counts of steps.

    A null or empty vector and one with a null, an infinite entry or no number
    goes. Vectors must be of one length: the most frequent one, of several as
    frequent the largest; others go.
    """
    vector = F.col(vec_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).alias("id"), vector.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LARGEST)) & (F.size("v") > 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    steps = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return rows.where(F.size("v") == (most["d"] if most else 0)).select("id", steps.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most _ROWS rows with their last column as a matrix."""
    for whole in batches:
        for begin in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(begin, _ROWS)
            x = batch.column(batch.num_columns - 1)
            yield batch, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _summed(fit: DataFrame, shape: tuple[int, int], each: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of each(x), matrices of that shape, over all blocks of rows; a task adds its own first."""
    rows, columns = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            total = each(x) if total is None else total + each(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *(pa.array(np.ascontiguousarray(total[:, k])) for k in range(columns))], names=["i", *(f"c{k}" for k in range(columns))])

    names = [f"c{k}" for k in range(columns)]
    parts = fit.select("x").mapInArrow(add, "i int, " + ", ".join(f"{c} {kind}" for c in names))
    found = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    out = np.zeros(shape, np.int64 if kind == "long" else float)
    out[found["i"].to_numpy()] = found[names].to_numpy()
    return out


class Centre:
    """The mean S/n of whole numbers, subtracted without loss: its whole part first."""

    def __init__(self, n: int, sums: np.ndarray) -> None:
        self.n, self.sums = n, [int(s) for s in sums]
        self.whole = np.array([s // n for s in self.sums])
        self.rest = np.array([(s % n) / n for s in self.sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2 of each row, exact; None where no long holds it."""
        far = (x - self.whole).astype(object) if len(x) and float(np.abs(x - self.whole).max()) * self.n > 2**62 else x - self.whole
        far = far * self.n - np.array([s % self.n for s in self.sums], object if far.dtype == object else np.int64)
        if len(x) and (far.dtype == object or float(np.abs(far.astype(float)).max()) ** 2 * x.shape[1] >= 2**62):
            far = far.astype(object)
        squares = (far * far).sum(axis=1)
        return [int(s) if s <= _LONG else None for s in squares]


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions of block beside basis; those that are rounding error are left out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    return block


def leading(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guard: int = GUARD, most_rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, unit eigenvectors as columns and residuals of a symmetric matrix given by its products.

    wanted of them, or d if that is less. Each call of multiply gets at most
    three blocks of wanted + guard directions. An error after most_rounds.
    """
    block, wanted = min(d, wanted + guard), min(d, wanted)
    iterate, _ = np.linalg.qr(np.random.default_rng(20240229).standard_normal((d, block)))
    residual = before = np.zeros((d, 0))
    for _ in range(most_rounds):
        beside = _orthonormal(residual, iterate)
        beside = np.hstack([beside, _orthonormal(before, np.hstack([iterate, beside]))])
        basis = np.hstack([iterate, beside])[:, :d]
        product = multiply(basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:block], turn[:, ::-1][:, :block]
        before = basis[:, block:] @ turn[block:]
        iterate, moved = basis @ turn, product @ turn
        residual = moved - iterate * values
        far = np.linalg.norm(residual, axis=0)
        least = 4 * _EPS * max(d, 16) * max(abs(values[0]), abs(values[-1]))
        if (far[:wanted] <= least).all():
            return values[:wanted], iterate[:, :wanted] / np.linalg.norm(iterate[:, :wanted], axis=0), far[:wanted]
        residual = residual[:, far > least]
        iterate, _ = np.linalg.qr(iterate)
    raise RuntimeError(f"eigenvectors did not settle in {most_rounds} rounds")


def whitened(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: id_col, component, n, deviation, whitened, explained, identity_error.

    Vectors are counted in steps (x); each different x is in the fit list once,
    n in all with sums S. component counts from 1 by falling eigenvalue e of the
    list's covariance; whitened is (x - S/n) on that unit eigenvector over
    sqrt(e), its sign such that the eigenvector's largest entry is positive;
    explained is e over the covariance's trace. Eigenvalues at rounding error
    of the first are no components, so equal vectors, or one, give no rows, as
    does a table without usable ones. deviation, the sum of (n x - S)^2, is null
    beyond the range of a long. identity_error is the largest entry of the
    whitened fit list's covariance minus the identity. Vectors that repeat are
    returned each; null identifiers are kept; other columns are not read.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(embeddings, id_col, vec_col)
    fit = checkpointed(rows.select("x").distinct())
    size = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = size["n"], size["d"]
    if n == 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    sums = _summed(fit, (d, 1), lambda x: x.sum(axis=0, dtype=np.int64)[:, None], "long")[:, 0]
    centre = Centre(n, sums)

    def multiply(block: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ block)

        return _summed(fit, block.shape, product) / n

    trace = float(_summed(fit, (1, 1), lambda x: np.array([[(centre(x) ** 2).sum()]]))[0, 0]) / n
    values, vectors, _ = leading(multiply, d, components)
    real = values > 16 * _EPS * d * max(values[0], _EPS)
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return embeddings.sparkSession.createDataFrame([], schema)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    onto = vectors / np.sqrt(values)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ onto
        return np.vstack([z.T @ z, z.sum(axis=0)])

    found = _summed(fit, (k + 1, k), moments) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches):
            at = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column(0).take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n)),
                pa.array(centre.deviation(x), pa.int64()).take(at),
                pa.array((centre(x) @ onto).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
