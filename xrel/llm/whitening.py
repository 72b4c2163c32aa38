"""Whitening of embeddings (operator 13): shifted Cholesky QR in distributed Gram passes, then the SVD of R."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow, stored

BLOCK_ROWS = 4096
# Three passes give an orthogonal factor for any full rank; more only come for data without full rank.
LEAST_PASSES, MOST_PASSES = 3, 8
# Directions with a smaller share of the largest singular value are rounding, not components.
RANK_SHARE = 1e-10


def whole_vectors(rows: DataFrame, vector: str = "embedding", steps: int = 256) -> DataFrame:
    """The rows whose vector is whole, with x, its entries in whole steps: floor(steps * c) as array<bigint>."""
    entry = lambda c: c.cast("double")
    whole = F.forall(vector, lambda c: c.isNotNull() & (F.abs(entry(c)) < float("inf")) & ~F.isnan(entry(c)))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(steps)) * entry(c)).cast("bigint"))
    return rows.where(F.col(vector).isNotNull() & whole & (F.size(vector) > 0)).withColumn("x", x)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _matrix_sum(fit: DataFrame, dim: int, shape: tuple[int, int], kind: type, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(block) over all blocks of x. Each task adds up its own, tasks meet row by row of the matrix."""
    name = {np.float64: "double", np.int64: "bigint"}[kind]
    schema = f"i int, g array<{name}>"
    height, width = shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0, dim):
            total = part(x) if total is None else total + part(x)
        if total is not None:
            flat = pa.array(total.astype(kind).ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(height, dtype=np.int32)), pa.ListArray.from_arrays(np.arange(height + 1, dtype=np.int32) * width, flat)], names=["i", "g"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for i, row in zip(batch.column(0).to_pylist(), values, strict=True):
                sums[i] = sums[i] + row if i in sums else row.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()])], names=["i", "g"])

    rows = map_arrow(map_arrow(fit.select("x"), partial, schema).repartition("i"), add, schema).collect()
    out = np.zeros(shape, kind)
    for r in rows:
        out[r.i] = r.g
    return out


@dataclass
class Whitening:
    """What is learnt from the fit list; its size depends on the dimension alone."""

    dim: int
    n: int
    sums: list[int]
    components: np.ndarray  # dim x k, unit columns by falling eigenvalue
    eigenvalues: np.ndarray  # k
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S)^2, exact: in 64 bits where it fits, else in Python's whole numbers."""
        low, high = int(x.min(initial=0)), int(x.max(initial=0))
        largest = max(abs(self.n * v - s) for s in (min(self.sums), max(self.sums)) for v in (low, high))
        if self.dim * largest**2 < 1 << 62:
            off = self.n * x - np.array(self.sums, np.int64)
            return pa.array((off * off).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        import decimal

        wide = decimal.Context(prec=80)
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return pa.array([wide.create_decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def _upper(gram: np.ndarray, shift: float) -> tuple[np.ndarray, bool]:
    """The upper Cholesky factor, shifted only where the plain one does not exist."""
    try:
        return np.linalg.cholesky(gram).T, False
    except np.linalg.LinAlgError:
        size = np.linalg.norm(gram, 2)
        while True:
            try:
                return np.linalg.cholesky(gram + shift * size * np.eye(len(gram))).T, True
            except np.linalg.LinAlgError:
                shift *= 10


def fitted(fit: DataFrame, dim: int, n: int, most: int = 4) -> Whitening:
    """Components of the rows x (each distinct vector once, all of length `dim`), from Gram matrices of centred rows.

    The first factor is that of the Gram matrix plus a shift that makes it positive beyond rounding. Each further pass
    solves the centred rows by the factors so far, which leaves them closer to orthogonal, and composes R. The singular
    values and right vectors of R are those of the rows.
    """
    sums = [int(s) for s in _exact_sums(fit, dim)]
    mean = np.array([s / n for s in sums])
    unit = np.finfo(float).eps / 2
    shift = 11 * (n * dim + dim * (dim + 1)) * unit
    r = np.eye(dim)
    values = np.zeros(dim)
    vectors, trace, done = np.eye(dim), 0.0, 0
    for done in range(1, MOST_PASSES + 1):
        factor = r

        def part(x: np.ndarray, factor: np.ndarray = factor, first: bool = done == 1) -> np.ndarray:
            rows = x - mean
            if not first:
                rows = np.linalg.solve(factor.T, rows.T).T
            return rows.T @ rows

        gram = _matrix_sum(fit, dim, (dim, dim), np.float64, part)
        gram = (gram + gram.T) / 2
        if done == 1:
            trace = float(np.trace(gram)) / n
            if trace <= 0:
                break
            new = np.linalg.cholesky(gram + shift * np.linalg.norm(gram, 2) * np.eye(dim)).T
            shifted = True
        else:
            new, shifted = _upper(gram, shift)
        r = new @ r
        # Scaled by its largest entry: composed factors of a large table would lose nothing, but could overflow.
        before = values
        _, values, vt = np.linalg.svd(r)
        vectors = vt.T
        top = slice(0, most + 1)
        settled = np.all(np.abs(values[top] - before[top]) <= 1e-13 * values[0])
        if done >= LEAST_PASSES and (not shifted or settled):
            break
    k = min(most, int((values > RANK_SHARE * values[0]).sum())) if trace > 0 else 0
    chosen = vectors[:, :k]
    # A sign that does not depend on the run: the largest entry of each component is positive.
    if k:
        chosen = chosen * np.where(chosen[np.abs(chosen).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return Whitening(dim, n, sums, chosen, values[:k] ** 2 / n, trace, done)


def _exact_sums(fit: DataFrame, dim: int) -> list[int]:
    """Sums per dimension in whole numbers: the high and low 32 bits apart, so that no sum leaves 64 bits."""

    def part(x: np.ndarray) -> np.ndarray:
        return np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    high, low = _matrix_sum(fit, dim, (2, dim), np.int64, part)
    return [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]


def whitened_embeddings(rows: DataFrame, vector: str = "embedding", most: int = 4, steps: int = 256) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error, for each whole vector.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those of another
    length than most have (the shorter of equally frequent lengths counts). The fit takes each distinct x once; repeated
    rows and ids, null ids too, are given row by row. Directions without variance are no components: one distinct
    vector, or an empty table, gives no rows. Deviations beyond 38 digits are null. Other columns are ignored.

    One shuffle finds the distinct vectors; every pass then reads them once and brings one matrix of the dimension's
    size together. Each task returns its whitened rows without a shuffle.
    """
    spark = rows.sparkSession
    whole = whole_vectors(rows, vector, steps).select(F.col("vec_id").cast("bigint").alias("vec_id"), "x")
    schema = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    distinct = stored(whole.select("x").distinct(), "vectors")
    lengths = whole.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].dim
    fit = distinct.where(F.size("x") == dim)
    n = fit.count()
    learnt = fitted(fit, dim, n, most)
    k = learnt.components.shape[1]
    if not k:
        return spark.createDataFrame([], schema)

    def moments(x: np.ndarray) -> np.ndarray:
        w = learnt.whiten(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    second = _matrix_sum(fit, dim, (k + 1, k), np.float64, moments) / n
    error = float(np.abs(second[:k] - np.outer(second[k], second[k]) - np.eye(k)).max())
    explained = learnt.eigenvalues / learnt.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, dim):
            m = part.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    learnt.deviations(x).take(each),
                    pa.array(learnt.whiten(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_arrow(whole.where(F.size("x") == dim), project, schema)
