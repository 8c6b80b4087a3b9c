"""Whitening of integer vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

1. An entry c becomes the integer x = floor(SCALE * c) + OFFSET. Each distinct vector is
   kept once; vectors are compared as packed bytes of the narrowest width that holds them.
2. Sums, and then products of entries less their mean rounded to an integer, are added up
   as integers, so the result doesn't depend on the order of tasks. The rest of the
   centring, less than one half per entry, is exact rational arithmetic on one matrix.
3. P'AP = LL' by Cholesky with the largest pivot first. Columns of L are rotated in pairs
   until all are orthogonal: their squared norms are the eigenvalues of A, and divided by
   their norms they are the components.
4. One pass over all rows projects them; one over the distinct vectors measures how far the
   covariance of what comes out is from the identity.

What meets on the driver is one matrix of d by d numbers for vectors of d entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barledger.llm.tables import published

SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 16
#: Entries beyond this many units stop the job.
LARGEST = 1 << 53
#: Rows whose products are added in one step.
_ROWS = 4096


class Whitening(NamedTuple):
    """`components` are unit columns by falling `eigenvalues` of the covariance with divisor n."""

    n: int
    sums: list[int]  # of x, one per entry
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


# ---------------------------------------------------------------- linear algebra


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L', L of as many columns as the rank."""
    a = a.copy()
    d = len(a)
    order = np.arange(d)
    low = np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(0.0, a.diagonal().max(initial=0.0))
    for k in range(d):
        at = k + int(np.argmax(a.diagonal()[k:]))
        if a[at, at] <= floor:
            return low[:, :k], order
        if at != k:
            a[[k, at]] = a[[at, k]]
            a[:, [k, at]] = a[:, [at, k]]
            low[[k, at]], order[[k, at]] = low[[at, k]], order[[at, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def jacobi_columns(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """g with its columns rotated in pairs until all are orthogonal to working precision.

    In a round every column meets one other, so the rotations of a round are independent;
    the pairs go round as in a tournament.
    """
    g = g.copy()
    r = g.shape[1]
    if r < 2:
        return g
    seats = list(range(r)) + [-1] * (r % 2)
    enough = np.finfo(float).eps * len(g)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:])) if a >= 0 and b >= 0]
            p, q = (np.array(side) for side in zip(*pairs))
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            todo = np.abs(xy) > enough * np.sqrt(xx * yy)
            if todo.any():
                turned = True
                p, q, x, y, xx, yy, xy = p[todo], q[todo], x[:, todo], y[:, todo], xx[todo], yy[todo], xy[todo]
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                g[:, p], g[:, q] = c * (x - t * y), c * (t * x + y)
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if not turned:
            return g
    raise ArithmeticError(f"columns are not orthogonal after {sweeps} sweeps")


def eigen_of(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a positive semidefinite matrix, zeros left out."""
    low, order = pivoted_cholesky(scatter)
    rotated = jacobi_columns(low)
    norm = np.sqrt((rotated * rotated).sum(0))
    by_size = np.argsort(-norm, kind="stable")
    vectors = np.empty_like(rotated)
    vectors[order] = rotated / norm
    vectors = vectors[:, by_size]
    largest = np.abs(vectors).argmax(0) if vectors.size else np.zeros(0, np.int64)
    return norm[by_size] ** 2, vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])


# ---------------------------------------------------------------- integer vectors


def _units(column: pa.Array) -> np.ndarray:
    """Rows of x - OFFSET, as exact integers, of vectors of one length."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(size) and size.min() != size.max():
        raise ValueError(f"vectors of {size.min()} and of {size.max()} entries")
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"entries beyond {LARGEST / SCALE:g}")
    return flat.astype(np.int64).reshape(len(size), -1)


def _packer(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        units = _units(batch.column(0))
        widest = np.abs(units).max(axis=1, initial=0)
        out: list[bytes] = [b""] * len(units)
        for limit, kind in ((1 << 7, "i1"), (1 << 15, "<i2"), (1 << 31, "<i4"), (1 << 63, "<i8")):
            mine = np.flatnonzero((widest < limit) & (widest >= (0 if kind == "i1" else limit >> (4 * int(kind[-1])))))
            for at, raw in zip(mine.tolist(), units[mine].astype(kind)):
                out[at] = bytes([int(kind[-1])]) + raw.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["packed"])


def _unpacked(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    sizes = {(len(r) - 1) // r[0] for r in rows}
    if len(sizes) > 1:
        raise ValueError(f"vectors of {min(sizes)} and of {max(sizes)} entries")
    out = np.empty((len(rows), max(sizes, default=0)), np.int64)
    for width in (1, 2, 4, 8):
        mine = [k for k, r in enumerate(rows) if r[0] == width]
        if mine:
            out[mine] = np.frombuffer(b"".join(rows[k][1:] for k in mine), f"<i{width}").reshape(len(mine), -1)
    return out


def _exact_products(z: np.ndarray) -> np.ndarray:
    """z'z of integers, as Python integers."""
    largest = int(np.abs(z).max(initial=0))
    if largest * largest * len(z) < 1 << 53:  # every partial sum is an exact double
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    z = z.astype(object)
    return z.T @ z


def _as_decimals(position: np.ndarray, values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(position, pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["at", "value"])


def _total(partial: DataFrame) -> dict[int, int]:
    """Exact totals of (at, value); as many rows as positions reach the driver."""
    return {r["at"]: int(r["value"]) for r in partial.groupBy("at").agg(F.sum("value").alias("value")).collect()}


def _sums(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position -1: vectors; others: sum of that entry."""
    n, total = 0, None
    for batch in found:
        units = _unpacked(batch.column(0))
        if len(units):
            n += len(units)
            here = units.astype(object).sum(axis=0) if np.abs(units).max(initial=0) > 1 << 40 else units.sum(axis=0).astype(object)
            total = here if total is None else total + here
    if n:
        yield _as_decimals(np.arange(-1, len(total)), [n, *total])


def _scatter(near: list[int]):
    """Upper triangle of the sum of (x - near)(x - near)'."""
    middle = np.array(near, np.int64)
    d = len(near)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in found:
            units = _unpacked(batch.column(0)) - middle
            for at in range(0, len(units), _ROWS):
                total = total + _exact_products(units[at : at + _ROWS])
        row, column = np.triu_indices(d)
        held = total[row, column]
        some = np.flatnonzero(held != 0)
        if len(some):
            yield _as_decimals((row * d + column)[some], held[some].tolist())

    return batches


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """The published packed vectors of the usable rows of vectors(embedding), each once."""
    return published(usable(vectors).select("embedding").mapInArrow(_packer, "packed binary").distinct(), "vectors")


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there, has entries, and has only finite ones."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(e.isNotNull() & (F.size(e) > 0) & ~bad)


def fit(packed: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct packed vectors; None without any."""
    totals = _total(packed.mapInArrow(_sums, "at int, value decimal(38,0)"))
    if not totals:
        return None
    n = totals.pop(-1)
    d = len(totals)
    sums = [totals[k] for k in range(d)]
    # Centred twice: on the rounded mean before anything is multiplied, on the rest after.
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, near)]
    products = _total(packed.mapInArrow(_scatter(near), "at int, value decimal(38,0)"))
    scatter = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            scatter[i, j] = scatter[j, i] = float(Fraction(n * products.get(i * d + j, 0) - rest[i] * rest[j], n * n))
    values, vectors = eigen_of(scatter)
    return Whitening(n, [s + n * OFFSET for s in sums], vectors[:, :components], values[:components], float(np.trace(scatter)))


def _projection(model: Whitening) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integer part of the mean of x - OFFSET, its fraction, components over root eigenvalues)."""
    near = [s // model.n for s in model.sums]
    part = np.array([float(Fraction(s - m * model.n, model.n)) for s, m in zip(model.sums, near)])
    return np.array(near, np.int64) - OFFSET, part, model.components / np.sqrt(model.eigenvalues)


def _moments(model: Whitening):
    """Position -1: vectors; then the sums and products of whitened entries."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, part, scaled = _projection(model)
        k = scaled.shape[1]
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in found:
            units = _unpacked(batch.column(0))
            if len(units):
                w = (units - near - part) @ scaled
                first += w.sum(0)
                second += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k + k * k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], names=["at", "value"])

    return batches


def identity_error(packed: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened distinct vectors less the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    rows = packed.mapInArrow(_moments(model), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(k + k * k)
    for r in rows:
        flat[r["at"]] = r["value"]
    mean, second = flat[:k] / model.n, flat[k:].reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def _whitener(model: Whitening, error: float):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, part, scaled = _projection(model)
        k = scaled.shape[1]
        explained = model.eigenvalues / model.trace
        offset = [model.n * OFFSET - s for s in model.sums]
        spread = max(map(abs, offset), default=0)
        for batch in found:
            units = _units(batch.column(1))
            rows = len(units)
            w = (units - near - part) @ scaled if rows else np.zeros((0, k))
            # n x - S, squared and added up: as machine integers where all of it fits.
            largest = model.n * int(np.abs(units).max(initial=0)) + spread
            exact = units if len(offset) * largest * largest < 1 << 63 else units.astype(object)
            parts = exact * model.n + np.array(offset, exact.dtype)
            deviation = [Decimal(int(v)) for v in (parts * parts).sum(axis=1)] if rows else []
            yield pa.RecordBatch.from_arrays([
                _repeated(batch.column(0), k), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, model.n)), _repeated(pa.array(deviation, pa.decimal128(38, 0)), k),
                pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return batches


def _repeated(column: pa.Array, times: int) -> pa.Array:
    return column.take(pa.array(np.repeat(np.arange(len(column)), times)))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding) -> one row per usable row and component.

    vec_id, component, n, deviation (exact sum of (n x - S)^2, decimal), whitened, explained,
    identity_error. Components are unit eigenvectors by falling eigenvalue, with the entry
    of largest size positive. There are as many as the rank of the covariance, at most
    `components`: a direction without variance can't be whitened, so one distinct vector,
    or none, gives no rows.

    Rows whose vector is null or empty, or holds null or non-finite entries, are dropped.
    Repeated rows and ids keep a row each, a null vec_id is kept. Vectors of several
    lengths, entries beyond 2**47 and a deviation beyond 38 digits stop the job. Other
    columns are ignored; an empty table gives no rows.
    """
    packed = distinct_vectors(vectors)
    model = fit(packed, components)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(packed, model)
    return usable(vectors).select("vec_id", "embedding").mapInArrow(_whitener(model, error), schema)
