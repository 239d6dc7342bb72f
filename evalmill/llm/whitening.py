"""Embedding whitening by a distributed Jacobi-Davidson iteration.

Vectors become integers; the fit list holds each distinct one once, packed into blocks of rows.
The covariance is never formed: its product with a few vectors is one Spark job over the
blocks, which centres each block, multiplies it by the vectors and by its own transpose, and
sums the partial products.

A subspace is kept with its image. Each round solves the subspace's own eigenproblem
(Rayleigh-Ritz), locks the leading pairs whose residuals have reached double precision, and
enlarges the subspace by a correction for every other wanted pair, that is an approximate
solution t of (I - QQ')(V - theta I)(I - QQ') t = -r by MINRES, where Q holds the wanted
vectors. The solvers run in step, so each of their steps is one product for all of them.
A guard pair more than is wanted is followed, so that none of the wanted ones is passed over.

Only vectors of the length of one row, and sums of that size, come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import staged, unstaged

COMPONENTS = 4
#: Units of an entry.
SCALE = 256
#: Rows of a block: 4,096 vectors of 1,024 numbers are 8 to 32 MB.
BLOCK = 4096
#: Residuals to reach, as a part of the largest eigenvalue; the accuracy of sums of doubles.
TOLERANCE = 64 * np.finfo(float).eps
ROUNDS, INNER = 60, 12
#: Residual to reach, as a part of its eigenvalue, by the pair that follows the wanted ones.
GUARD = 1e-2
#: Vectors of a subspace, for each wanted pair, before it is restarted from the best of them.
SUBSPACE = 12

_LONG = (1 << 63) - 1


def finite(column: Column) -> Column:
    """True for vectors without null, NaN or infinite entries."""
    return F.coalesce(column.isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def integers(column: Column, length: int) -> Column:
    """floor(SCALE * entry) as long (the nearest long beyond the range), with zeros up to ``length``."""
    whole = F.transform(column, lambda x: F.floor(F.greatest(F.least(SCALE * x.cast("double"), F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long"))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(column)))


def packed(vectors: DataFrame, length: int, widest: int, rows: int = BLOCK) -> DataFrame:
    """(n, data): blocks of rows of the integers in column x, in the smallest type that holds them."""
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if widest <= np.iinfo(k).max)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.asarray(batch.column(0).flatten()).astype(kind))
                n += batch.num_rows
            if n >= rows:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate(held).tobytes()])], names=["n", "data"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate(held).tobytes()])], names=["n", "data"])

    return vectors.select("x").mapInArrow(run, "n long, data binary"), np.dtype(kind).str


def summed(blocks: DataFrame, kind: str, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], dtype=np.float64) -> np.ndarray:
    """The sum of ``partial`` over all blocks (n x length matrices); each task adds up its own."""

    def run(batches):
        total = np.zeros(shape, dtype)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += partial(np.frombuffer(data.as_buffer(), dtype=kind).reshape(n, -1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    number = "double" if dtype == np.float64 else "long"
    found = blocks.mapInArrow(run, f"k long, v {number}").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(int(np.prod(shape)), dtype)
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    return out.reshape(shape)


def orthonormal(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The directions of ``vectors`` that are not in the span of ``against``, orthonormal."""
    out = np.zeros((len(vectors), 0))
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        for _ in range(3):
            for basis in (against, out):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, q: np.ndarray, right: np.ndarray, goals: np.ndarray, steps: int) -> np.ndarray:
    """Solve (I - qq')(V - shift)(I - qq') t = right, a column at a time but in step.

    A column rests once its residual is below its goal, relative to ``right``; ``product`` is
    called once a step, for the columns that go on.
    """
    project = lambda x: x - q @ (q.T @ x)
    right = project(project(right))
    size = np.linalg.norm(right, axis=0)
    solution = np.zeros_like(right)
    v, before = right / np.where(size > 0, size, 1), np.zeros_like(right)
    beta, left = np.zeros(len(size)), size.copy()
    c1, s1, c0, s0 = np.ones(len(size)), np.zeros(len(size)), np.ones(len(size)), np.zeros(len(size))
    w1, w0 = np.zeros_like(right), np.zeros_like(right)
    going = size > 0
    for _ in range(steps):
        if not going.any():
            break
        k = np.flatnonzero(going)
        image = project(product(v[:, k]) - shifts[k] * v[:, k])
        alpha = np.einsum("ij,ij->j", v[:, k], image)
        new = project(image - alpha * v[:, k] - beta[k] * before[:, k])
        next_beta = np.linalg.norm(new, axis=0)
        # The column of the tridiagonal matrix, turned by the last two rotations, then by a new one.
        third, low = s0[k] * beta[k], c0[k] * beta[k]
        second, first = c1[k] * low + s1[k] * alpha, -s1[k] * low + c1[k] * alpha
        radius = np.hypot(first, next_beta)
        safe = np.where(radius > 0, radius, 1)
        c, s = first / safe, next_beta / safe
        w = (v[:, k] - third * w0[:, k] - second * w1[:, k]) / safe
        solution[:, k] += np.where(radius > 0, c * left[k], 0) * w
        left[k] = -s * left[k]
        w0[:, k], w1[:, k] = w1[:, k], w
        c0[k], s0[k], c1[k], s1[k] = c1[k], s1[k], c, s
        before[:, k], beta[k] = v[:, k], next_beta
        v[:, k] = new / np.where(next_beta > 0, next_beta, 1)
        going[k] = (np.abs(left[k]) > goals[k] * size[k]) & (next_beta > 1e-14 * np.abs(shifts[k])) & (radius > 0)
    return solution


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], length: int, wanted: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive operator and unit eigenvectors, in falling order.

    Ends when every residual is at most ``tolerance`` times the largest eigenvalue, or when the
    residuals, already below 1e-11 of it, stop falling: sums over more rows round more coarsely.
    """
    followed = min(wanted + 1, length)
    start = np.random.default_rng(1).standard_normal((length, min(2 * followed, length)))
    basis = orthonormal(start, np.zeros((length, 0)))
    image = product(basis)
    least, still = np.inf, 0
    for _ in range(rounds):
        values, turns = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        turns = turns[:, ::-1]
        values = values[::-1]
        ritz, mapped = basis @ turns[:, :followed], image @ turns[:, :followed]
        residual = mapped - ritz * values[:followed]
        sizes = np.linalg.norm(residual, axis=0)
        top = max(values[0], np.finfo(float).tiny)
        locked = np.logical_and.accumulate(sizes <= tolerance * top)  # in order, the largest first
        worst = sizes[:wanted].max() / top
        still = 0 if worst < least / 2 else still + 1
        least = min(least, worst)
        guarded = len(basis.T) == length or followed == wanted or sizes[-1] <= GUARD * max(values[followed - 1], 0) or worst <= tolerance
        if guarded and (locked[:wanted].all() or (worst <= 1e-11 and still >= 3) or len(basis.T) == length and worst <= 1e-11):
            return values[:wanted], ritz[:, :wanted] / np.linalg.norm(ritz[:, :wanted], axis=0)
        if len(basis.T) > SUBSPACE * followed:
            keep = 3 * followed
            basis, image = basis @ turns[:, :keep], image @ turns[:, :keep]
            ritz, mapped = basis[:, :followed], image[:, :followed]
        open_ = np.flatnonzero(~locked)
        goals = np.clip(sizes[open_] / top, 1e-3, 0.3)
        steps = min(INNER, length - followed)
        fixes = minres(product, values[open_], ritz, -residual[:, open_], goals, steps) if steps else residual[:, open_]
        more = orthonormal(np.column_stack([fixes, residual[:, open_]]), basis)[:, : length - len(basis.T)]
        if not more.shape[1]:
            more = orthonormal(np.random.default_rng(len(basis.T)).standard_normal((length, followed)), basis)[:, : length - len(basis.T)]
        if more.shape[1]:
            basis, image = np.column_stack([basis, more]), np.column_stack([image, product(more)])
        else:  # the whole space: refresh the image, which ends the rounding of restarts
            basis, _ = np.linalg.qr(ritz if followed == length else np.column_stack([ritz, basis]))
            image = product(basis)
    raise RuntimeError(f"residuals stay at {least:.1e} of the largest eigenvalue")


class Fit:
    """The fit list: its blocks, length, count, sums, mean, and products with its covariance."""

    def __init__(self, vectors: DataFrame):
        rows = staged(vectors.select("x").distinct(), "whitening-distinct")
        entry = F.aggregate("x", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))
        self.n, self.widest, length = rows.agg(F.count("*"), F.max(entry), F.max(F.size("x"))).first()
        self.length = length or 0
        if self.length:
            blocks, self.kind = packed(rows, self.length, self.widest)
            self.blocks = staged(blocks, "whitening-blocks")
            self.sums = [int(x) for x in rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("pos").toPandas()["s"]]
            self.mean = np.array([s / self.n for s in self.sums])
        unstaged(rows)

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``vectors``, never having formed it."""
        mean = self.mean

        def partial(block):
            centred = block - mean
            return centred.T @ (centred @ vectors)

        return summed(self.blocks, self.kind, partial, vectors.shape) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(summed(self.blocks, self.kind, lambda block: np.square(block - mean).sum(axis=0), (self.length,)).sum() / self.n)

    def identity_error(self, whitener: np.ndarray) -> float:
        """Largest entry of the whitened vectors' covariance minus the identity."""
        mean, k = self.mean, whitener.shape[1]

        def partial(block):
            white = (block - mean) @ whitener
            return np.vstack([white.sum(axis=0), white.T @ white])

        found = summed(self.blocks, self.kind, partial, (k + 1, k)) / self.n
        return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())


def projected(rows: DataFrame, fit: Fit, whitener: np.ndarray) -> DataFrame:
    """(vec_id, component, deviation, whitened) of every row (vec_id, x)."""
    sums, n, mean, k = fit.sums, fit.n, fit.mean, whitener.shape[1]
    reach = n * fit.widest + max(map(abs, sums))
    small = reach < 2**31 and reach * reach * fit.length <= _LONG

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            x = np.asarray(batch.column(1).flatten()).reshape(count, -1)
            if small:
                deviation = pa.array(np.square(n * x - np.array(sums)).sum(axis=1))
            else:  # beyond 64 bits on the way; null where the result is, too
                exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
                deviation = pa.array([v if v <= _LONG else None for v in exact], pa.int64())
            white = (x - mean) @ whitener
            each = pa.array(np.repeat(np.arange(count), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), deviation.take(each), pa.array(white.ravel())],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double")


def whitened(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row, a row
    for each of the first ``components`` components.

    Rows whose vector is null or holds null or non-finite entries are dropped. An entry c counts as
    floor(256 c), up to 2 ** 62; n, sums and covariance are over the distinct vectors. A vector that
    is shorter than the longest one, an empty one too, counts as followed by zeros. Components have
    an eigenvalue above zero (the length times 1e-15 of the trace), so there are at most as many as the
    vectors span, and none for a single distinct vector. Their order among equal eigenvalues, and
    their signs, are arbitrary but the same for all rows. ``deviation`` is null beyond a long. Rows
    that repeat an id, or have none, each get their rows. Empty tables give no rows. Memory grows
    with the length of a vector, not with their number. Other columns are not read.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vec")).filter(finite(F.col("vec")))
    length = good.agg(F.max(F.size("vec"))).first()[0] or 0
    rows = good.select("vec_id", integers(F.col("vec"), length).alias("x"))
    fit = Fit(rows)
    values, found = np.zeros(0), np.zeros((length, 0))
    trace = fit.trace() if length else 0.0
    if trace > 0:
        values, found = jacobi_davidson(fit.product, length, min(components, length))
        keep = values > length * 1e-15 * trace
        values, found = values[keep], found[:, keep]
    schema = f"{key} {good.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(values):
        return spark.createDataFrame([], schema)
    whitener = found / np.sqrt(values)
    error = fit.identity_error(whitener)
    explained = F.element_at(F.array(*(F.lit(float(v / trace)) for v in values)), F.col("component"))
    return projected(rows, fit, whitener).select(
        F.col("vec_id").alias(key), "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )
