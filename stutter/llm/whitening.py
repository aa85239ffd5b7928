"""Embedding whitening by shifted CholeskyQR.

The centred rows A are a tall matrix spread over tasks. A pass sums the Gram
matrices of the tasks; its Cholesky factor R makes rows x R^-1, by triangular
solves, that are closer to orthonormal. The first factor is of the Gram matrix
with a small shift, so that it exists however badly conditioned the rows are;
further passes take the shift out again. The factors compose to one small R
with A = QR, and the singular values and vectors of R are those of A: squares
of singular values never enter, as they would in an eigenproblem of the
covariance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
_ROWS = 1 << 22  # numbers handled together
_FAN = 32  # partial sums added in one task
_PASSES = 8  # at most; three do unless rows are dependent
_EPS = np.finfo(np.float64).eps


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, lengths and which rows of a list column hold finite numbers only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.where(np.asarray(column.is_null()), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    end = np.cumsum(size)
    return flat, size, (bad[end] == bad[end - size]) & np.asarray(column.is_valid())


def _whole_numbers(scale: int, shift: int):
    """Task function: rows ``(vec_id, vector)`` to ``(vec_id, x)``, rows that take no part left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size, good = _lists(batch["vector"])
            x = np.floor(scale * flat[np.repeat(good, size)])
            if len(x) and np.abs(x).max() >= 2.0**62:
                raise ValueError("a component is beyond 64-bit whole numbers")
            offsets = pa.array(np.r_[0, np.cumsum(size[good])], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64) + shift, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(pa.array(good)), lists], ["vec_id", "x"])

    return run


def _matrix(batch: pa.RecordBatch, width: int, fill: int) -> np.ndarray:
    """Rows ``x`` as a matrix; shorter rows are filled up."""
    column = batch["x"]
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(batch), width), fill, np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, _ROWS // max(width, 1))
    for batch in batches:
        for lo in range(0, len(batch), step):
            yield batch.slice(lo, step)


_SUMS = "task int, m binary"


def _summed(rows: DataFrame, of_task: Callable, shape: tuple[int, ...], dtype=np.float64) -> np.ndarray:
    """Sum over all rows of what ``of_task(batches)`` yields, added up in a tree.

    Each task sends one array, tasks add up ``_FAN`` of these at a time, and the
    driver adds the last few.
    """

    def send(batches):
        total = np.zeros(shape, dtype)
        for part in of_task(batches):
            total += part
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype) for x in table["m"])
        return pa.table({"task": table["task"][:1].combine_chunks(), "m": pa.array([total.tobytes()], pa.binary())})

    many = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(send, "m binary").select(F.spark_partition_id().alias("task"), "m")
    while many > _FAN:
        many = -(-many // _FAN)
        sums = sums.withColumn("task", (F.col("task") / _FAN).cast("int")).groupBy("task").applyInArrow(add, _SUMS)
    return sum((np.frombuffer(r.m, dtype).reshape(shape) for r in sums.select("m").collect()), np.zeros(shape, dtype))


class Centred:
    """Rows x - S/n as double precision blocks, and their exact deviations."""

    def __init__(self, n: int, sums: list[int], fill: int):
        self.n, self.sums, self.fill = n, sums, fill

    def numerators(self, batch: pa.RecordBatch) -> np.ndarray:
        """n * x - S, whole numbers, as Python's where 64 bits do not hold them."""
        x = _matrix(batch, len(self.sums), self.fill)
        most = self.n * max(1, int(np.abs(x).max(initial=0))) + max((abs(s) for s in self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in _blocks(batches, len(self.sums)):
            yield (self.numerators(batch) / self.n).astype(np.float64)


def deviations(numerators: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exact; an error where it is beyond 64 bits."""
    most = max(1, int(np.abs(numerators).max(initial=0)))
    if most * most * max(1, numerators.shape[1]) < 1 << 63:
        return np.einsum("ij,ij->i", numerators, numerators)
    whole = (numerators.astype(object) ** 2).sum(axis=1)
    if max(whole) >= 1 << 63:
        raise ValueError("a deviation is beyond 64-bit whole numbers")
    return whole.astype(np.int64)


def _solved(block: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """block x R1^-1 x R2^-1 ..., one triangular solve after the other."""
    for r in factors:
        block = np.linalg.solve(r.T, block.T).T
    return block


def orthogonal_factor(rows: DataFrame, centred: Centred) -> tuple[np.ndarray, np.ndarray]:
    """(R, Gram matrix of Q) of the centred rows A = QR, by passes of shifted CholeskyQR."""
    width = len(centred.sums)
    factors: list[np.ndarray] = []
    whole, gram = np.eye(width), np.zeros((width, width))
    for left in range(_PASSES, -1, -1):
        def grams(batches, done=tuple(factors)):
            for block in centred.blocks(batches):
                q = _solved(block, list(done))
                yield q.T @ q

        gram = _summed(rows, grams, (width, width))
        if not left or not np.trace(gram) or np.abs(gram - np.eye(width)).max() <= 1e-13 * width:
            break
        shift = 11 * (centred.n * width + width * (width + 1)) * _EPS * np.linalg.norm(gram, 2)
        if factors:
            try:  # well conditioned by now, unless rows are dependent
                r = np.linalg.cholesky(gram).T
            except np.linalg.LinAlgError:
                r = np.linalg.cholesky(gram + shift * np.eye(width)).T
        else:
            r = np.linalg.cholesky(gram + min(shift, np.linalg.norm(gram, 2)) * np.eye(width)).T
        factors.append(r)
        whole = r @ whole
    return whole, gram


def principal_axes(whole: np.ndarray, gram: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit components as columns and their variances, from A = QR and the Gram matrix of Q.

    A direction in which the rows do not vary has no part in Q; it is left out.
    """
    u, sigma, vt = np.linalg.svd(whole)
    share = np.einsum("ij,ij->j", u, gram @ u)  # 1 for directions in the span of the rows, else 0
    # what is left of such a direction is rounding
    real = np.flatnonzero((share > 0.5) & (sigma > 8 * len(whole) * _EPS * sigma.max(initial=0)))
    variance = (sigma * sigma * share / n)[real]
    order = np.argsort(-variance, kind="stable")[:most]
    axes = vt[real][order].T
    lead = np.argmax(np.abs(axes), axis=0)
    return axes * np.sign(axes[lead, np.arange(axes.shape[1])]), variance[order]


WHITE = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(
    vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """A row per vector and component up to ``most``: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Components c of vectors become whole numbers floor(scale * c) + shift. Rows whose
    vector is null or holds null or non-finite entries are left out; shorter vectors
    count as filled up with zeros. All other rows, repeated ones and those with a null
    id too, make the covariance (divisor n) and are whitened. Components have falling variance; which
    of two equal ones comes first is not defined. Directions without variance are left
    out, so one row alone, or equal rows only, give no rows, as does an empty table.
    ``deviation`` is the sum of (n * x - S)^2 over the dimensions, S their sums,
    ``explained`` the component's share of the whole variance, and ``identity_error``
    the largest entry of the measured covariance of the whitened rows minus the identity.
    Entries or deviations beyond 64 bits stop the job. Other columns are left out. The
    driver and each task hold a few matrices of dimension x dimension.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = written(rows.mapInArrow(_whole_numbers(scale, shift), "vec_id long, x array<long>"))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    empty = rows.sparkSession.createDataFrame([], WHITE)
    if not n or not width:
        return empty

    # whole sums in two halves of 31 bits, so that no partial sum overflows
    def halves(batches):
        for batch in _blocks(batches, width):
            x = _matrix(batch, width, shift)
            yield np.stack([x >> 31, x & (1 << 31) - 1]).sum(axis=1)

    high, low = _summed(rows, halves, (2, width), np.int64).tolist()
    centred = Centred(n, [(h << 31) + s for h, s in zip(high, low, strict=True)], shift)
    whole, gram = orthogonal_factor(rows, centred)
    axes, variance = principal_axes(whole, gram, n, most)
    k = len(variance)
    if not k:
        return empty
    total = float(np.einsum("ij,ij->", whole, gram @ whole)) / n  # trace of the covariance
    turn = axes / np.sqrt(variance)

    def moments(batches):
        for block in centred.blocks(batches):
            w = np.c_[block @ turn, np.ones(len(block))]
            yield w.T @ w

    m = _summed(rows, moments, (k + 1, k + 1)) / n
    error = float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, max(width, 16 * k)):
            numerators = centred.numerators(batch)
            white = (numerators / n).astype(np.float64) @ turn
            each = len(batch)
            ids = batch["vec_id"].take(pa.array(np.repeat(np.arange(each), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), each)), pa.array(np.full(each * k, n, np.int64)),
                pa.array(np.repeat(deviations(numerators), k)), pa.array(white.ravel()),
                pa.array(np.tile(variance / total, each)), pa.array(np.full(each * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, WHITE)
