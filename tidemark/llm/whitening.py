"""Whitening of embeddings by a Jacobi-Davidson eigensolver that never builds the covariance.

The solver sees the covariance V only through products V B with a few columns B: every task centres its vectors and
multiplies, Spark adds the parts. Leading eigenvectors are Ritz vectors of a growing search space; each open one asks for an
approximate solution of its correction equation, projected against all wanted directions and solved by MINRES, whose steps
are products of all open columns at once. Vectors whose residual has reached double precision are locked and projected out.
On the driver live matrices with one row for every dimension and some dozen columns, whatever the number of vectors.

Every entry c counts as the integer ``floor(64 c) + 1000000``; sums, centring and deviations use integers. Vectors that are
null, hold null or non-finite entries (or any beyond 2^56, which have no such integer with room to add up), or are not of the
most frequent length (the longer of two equally frequent ones) are dropped. Repeated rows and rows without an id count like
any others. An empty table, or one of equal vectors only, has no component and gives no row; directions whose variance is
below 1e-10 of the largest have nothing to divide by and are no components either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Rows, pack, record, stored, unpack

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = 1 << 56
#: Search directions beside the wanted ones, steps of the inner solver and its wanted reduction of the residual.
GUARD, INNER, REDUCTION = 8, 8, 0.02
ROUNDS = 200
FLAT = 1e-10
#: Entries of the vectors packed in one row of the stored table.
BLOCK_ENTRIES = 1 << 18

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
_EPS = np.finfo(np.float64).eps


# ---- the eigensolver, over products alone -----------------------------------------------------------------------------


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``new`` beyond the given orthonormal bases; directions that only rounding tells apart go."""
    for _ in range(2):
        for basis in bases:
            new = new - basis @ (basis.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 0] / size[size > 0]
        left, weight, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, weight > 1e-6]
    return new


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, reduction: float) -> np.ndarray:
    """Approximate solutions of ``apply(x) = right`` for all columns at once; ``apply`` is symmetric for each column."""
    beta = np.linalg.norm(right, axis=0)
    wanted = beta * reduction
    v, v_old = right / np.where(beta > 0, beta, 1), np.zeros_like(right)
    x, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    cosine, cosine_old, sine, sine_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    rest, live = beta.copy(), beta > 0
    back = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = apply(v)
        alpha = np.sum(v * p, axis=0)
        p -= alpha * v + back * v_old
        following = np.linalg.norm(p, axis=0)
        corner = cosine * alpha - cosine_old * sine * back
        r1 = np.hypot(corner, following)
        r2 = sine * alpha + cosine_old * cosine * back
        r3 = sine_old * back
        live &= r1 > 0
        r1 = np.where(r1 > 0, r1, 1)
        cosine_old, cosine, sine_old, sine = cosine, corner / r1, sine, following / r1
        w_new = (v - r3 * w_old - r2 * w) / r1
        x += np.where(live, cosine * rest, 0) * w_new
        rest = np.where(live, -sine * rest, rest)
        v_old, v, w_old, w, back = v, p / np.where(following > 0, following, 1), w, w_new, following
        live &= (np.abs(rest) > wanted) & (following > 0)
    return x


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, inner: int = INNER, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the symmetric operator behind ``apply``."""
    wanted = min(wanted, size)
    if not wanted:
        return np.empty(0), np.empty((size, 0))
    most = min(size, 3 * wanted + GUARD)
    locked, values = np.empty((size, 0)), np.empty(0)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((size, min(size, wanted + GUARD))))
    image = apply(basis)
    for _ in range(ROUNDS):
        small = basis.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        residual = image - basis * ritz
        residual -= locked @ (locked.T @ residual)
        scale = max(np.abs(values).max(initial=0), np.abs(ritz).max(initial=0))
        missing = wanted - len(values)
        whole = locked.shape[1] + basis.shape[1] == size  # nothing is left to search
        done = (np.linalg.norm(residual[:, :missing], axis=0) <= 4 * _EPS * size * scale) | whole
        ready = int(np.argmin(done)) if not done.all() else len(done)
        if ready:
            locked, values = np.hstack([locked, basis[:, :ready]]), np.append(values, ritz[:ready])
            basis, image, residual, ritz, done = basis[:, ready:], image[:, ready:], residual[:, ready:], ritz[ready:], done[ready:]
        missing -= ready
        if not missing:
            break
        open_ = np.flatnonzero(~done)
        fence = np.hstack([locked, basis[:, :missing]])
        shift = ritz[open_]

        def projected(columns: np.ndarray) -> np.ndarray:
            out = apply(columns) - columns * shift
            return out - fence @ (fence.T @ out)

        right = -residual[:, open_]
        steps = minres(projected, right - fence @ (fence.T @ right), inner, REDUCTION)
        if locked.shape[1] + basis.shape[1] + steps.shape[1] > max(most, locked.shape[1] + missing + GUARD + steps.shape[1]):
            basis, image = basis[:, : missing + GUARD], image[:, : missing + GUARD]
        steps = _orthonormal(steps, locked, basis)
        if not steps.shape[1]:  # the corrections lie in the space already: go on from a fresh direction
            steps = _orthonormal(np.random.default_rng(len(values) + seed).standard_normal((size, 1)), locked, basis)
        basis, image = np.hstack([basis, steps]), np.hstack([image, apply(steps)])
    else:
        raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenvectors have not reached double precision in {ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


# ---- vectors as integers, in blocks -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """The fit list: number of vectors, exact sums (without the offset, which centring cancels) and largest entry."""

    n: int
    sums: tuple[int, ...]
    peak: int
    #: Tasks that add the parts of a product before the driver does.
    slots: int

    @property
    def reach(self) -> int:
        """No ``n x - S`` is larger."""
        return 2 * self.n * self.peak

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """``n x - S``, exact: 64-bit where they fit."""
        if self.reach < 1 << 62:
            return y * np.int64(self.n) - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, y: np.ndarray) -> np.ndarray:
        d = self.deviations(y)
        return (d / self.n).astype(np.float64)

    def squares(self, y: np.ndarray) -> list[int] | np.ndarray:
        d = self.deviations(y)
        if self.reach**2 * len(self.sums) < 1 << 63:
            return (d * d).sum(axis=1)
        return (d.astype(object) ** 2).sum(axis=1)


def _exact_sums(y: np.ndarray) -> list[int]:
    high, low = (y >> 31).sum(axis=0), (y & ((1 << 31) - 1)).sum(axis=0)
    return [(h << 31) + w for h, w in zip(high.tolist(), low.tolist())]


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(block) of ids and integer matrices, stored."""
    rows = max(1, BLOCK_ENTRIES // size)

    def run(batches: Rows) -> Rows:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0)
                y = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64)
                peak = int(np.abs(y).max(initial=0))
                kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if peak <= np.iinfo(k).max)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                yield record({"block": ([pack(ids.fill_null(0).to_numpy(), named, y.astype(kind))], pa.binary())})

    return stored(vectors.mapInArrow(run, "block binary"))


def _unpacked(batches: Rows, size: int):
    for batch in batches:
        for block in batch.column(0):
            ids, named, y = unpack(block.as_py())
            yield ids, named, y.astype(np.int64).reshape(-1, size)


def _fit(blocks: DataFrame, size: int) -> Fit:
    def run(batches: Rows) -> Rows:
        for _, _, y in _unpacked(batches, size):
            d = list(range(size))
            yield record(
                {
                    "dim": (d, pa.int32()),
                    "total": (_exact_sums(y), pa.decimal128(38, 0)),
                    "peak": ([int(np.abs(y).max())] * size, pa.int64()),
                    "n": ([len(y)] * size, pa.int64()),
                }
            )

    parts = blocks.mapInArrow(run, "dim int, total decimal(38,0), peak long, n long")
    rows = parts.groupBy("dim").agg(F.sum("total").alias("total"), F.max("peak").alias("peak"), F.sum("n").alias("n")).orderBy("dim").collect()
    return Fit(rows[0].n, tuple(int(r.total) for r in rows), max(r.peak for r in rows), max(1, round(blocks.rdd.getNumPartitions() ** 0.5)))


def summed(blocks: DataFrame, fit: Fit, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part`` (an array of ``shape``) over the centred vectors of every block; added in tasks, then in a few, then here."""
    size, slots = len(fit.sums), fit.slots

    def run(batches: Rows) -> Rows:
        total = np.zeros(shape)
        for _, _, y in _unpacked(batches, size):
            total += part(fit.centred(y))
        yield record({"slot": ([TaskContext.get().partitionId() % slots], pa.int32()), "total": ([total.tobytes()], pa.binary())})

    def add(batches: Rows) -> Rows:
        total = np.zeros(shape)
        for batch in batches:
            for one in batch.column(1):
                total += np.frombuffer(one.as_py()).reshape(shape)
        yield record({"total": ([total.tobytes()], pa.binary())})

    parts = blocks.mapInArrow(run, "slot int, total binary").repartitionById(slots, "slot").mapInArrow(add, "total binary").collect()
    return np.sum([np.frombuffer(r.total).reshape(shape) for r in parts], axis=0)


# ---- whitening --------------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, vector) of the rows that take part, and the length of their vectors (0: there are none)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda e: e.isNotNull() & (F.abs(e) <= LARGEST)))
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = size[0] if size else 0
    return rows.filter(F.size("vector") == size), size


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for every remaining vector and component (``SCHEMA``): the vector projected on the unit eigenvector, over the
    square root of its eigenvalue; ``explained`` is the eigenvalue's part of the trace, ``deviation`` the exact sum of
    ``(n x - S)^2`` (null beyond a long; ``deviation_exact`` has 38 digits), ``identity_error`` the largest entry by which the
    covariance of the whitened vectors differs from the identity."""
    spark = vectors.sparkSession
    rows, size = usable(vectors, id_col, vector_col)
    if not size:
        return spark.createDataFrame([], SCHEMA)
    blocks = _blocks(rows, size)
    fit = _fit(blocks, size)

    def product(columns: np.ndarray) -> np.ndarray:
        return summed(blocks, fit, lambda z: z.T @ (z @ columns), columns.shape) / fit.n

    trace = float(summed(blocks, fit, lambda z: np.array([np.sum(z * z)]), (1,))[0]) / fit.n
    values, directions = jacobi_davidson(product, size, components) if trace else (np.empty(0), np.empty((size, 0)))
    held = values > FLAT * values.max(initial=0)
    values, directions = values[held], directions[:, held] / np.sqrt(values[held])
    k = len(values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    mean = summed(blocks, fit, lambda z: (z @ directions).sum(axis=0), (k,)) / fit.n

    def spread(z: np.ndarray) -> np.ndarray:
        w = z @ directions - mean
        return w.T @ w

    error = float(np.abs(summed(blocks, fit, spread, (k, k)) / fit.n - np.eye(k)).max())
    explained = values / trace

    def run(batches: Rows) -> Rows:
        for ids, named, y in _unpacked(batches, size):
            rows = max(1, (1 << 17) // k)
            for a in range(0, len(y), rows):
                part = y[a : a + rows]
                squares = fit.squares(part)
                small = [int(s) if s < 1 << 63 else None for s in squares.tolist()]
                each = np.repeat(np.arange(len(part)), k)
                count = len(each)
                columns = [
                    pa.array(ids[a : a + rows], pa.int64(), mask=~named[a : a + rows]).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(count, fit.n)),
                    pa.array(small, pa.int64()).take(pa.array(each)),
                    pa.array((fit.centred(part) @ directions).reshape(-1)),
                    pa.array(np.tile(explained, len(part))),
                    pa.array(np.full(count, error)),
                    pa.array([int(s) if s < 10**38 else None for s in squares.tolist()], pa.decimal128(38, 0)).take(pa.array(each)),
                ]
                names = [c.split()[0] for c in SCHEMA.replace("(38,0)", "").split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(run, SCHEMA)
