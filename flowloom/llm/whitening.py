"""Whitening of embeddings by the leading components of their covariance.

Each entry ``c`` becomes the whole number ``floor(64 c) + 1000000``.  The fit list
holds every distinct vector of such numbers once, so copies, of which there may be
any number, weigh nothing.  Its sums are whole numbers.  For the covariance the
vectors are moved by a whole centre (the rounded mean) before they are multiplied;
products are summed exactly, in each task and then by Spark, and the rest of the
mean (less than one half) is taken off exactly, so the d x d covariance does not
depend on how rows are dealt out.  It alone reaches the driver, where it is reduced
to a tridiagonal matrix by Householder reflections.  Bisection on Sturm counts gives
the leading eigenvalues, inverse iteration their vectors, which are made orthogonal
within clusters of close values and turned back.  The components (k x d numbers) go
to all tasks, which project their rows.

Rows whose vector is null, is empty or holds a null or a value that is not finite
are left out.  Vectors of a length other than the most frequent one (of equally
frequent ones the longest) have no place in the same covariance and are left out as
well.  Entries beyond 2**45 are taken as 2**45.  Repeated rows are all returned and
equal vectors get equal results.  Of equal eigenvalues any basis of unit vectors may
come out.  Components without variance cannot be whitened and are left out; so a
table without rows, or whose vectors are all equal, gives no rows.  Other columns are
ignored, whatever their names; texts do not occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored

SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 45)
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)
_CELLS = "row int, col int, value decimal(38,0)"
_CELL_TYPES = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("value", pa.decimal128(38, 0))])
_RESULT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
)


@dataclass(frozen=True)
class Whitening:
    """Fitted components: ``n`` distinct vectors, their sums, and what follows."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a unit vector per row
    trace: float

    @property
    def centre(self) -> list[int]:
        """The rounded mean."""
        return [_rounded(s, self.n) for s in self.sums]


def _rounded(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix."""
    a = matrix.astype(np.float64).copy()
    size = len(a)
    mirrors = []
    for k in range(size - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if not scale or not np.abs(x[1:]).max():
            mirrors.append(None)
            continue
        x /= scale
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = -np.copysign(np.linalg.norm(x) * scale, x[0])
        mirrors.append(v)
    return np.diag(a).copy(), np.array([a[i + 1, i] for i in range(size - 1)]), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each point."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    least = max(tiny, np.finfo(float).eps * float(np.abs(off).max(initial=0.0)) ** 2 * 1e-16)
    pivot = diagonal[0] - points
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - points - e * e / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection to the last bit or so."""
    size = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    margin = 4 * np.finfo(float).eps * max(abs(low), abs(high)) + np.finfo(float).tiny
    index = size - 1 - np.arange(min(most, size))  # rank from below
    lows, highs = np.full(len(index), low - margin), np.full(len(index), high + margin)
    for _ in range(200):
        middle = (lows + highs) / 2
        if np.all((middle <= lows) | (middle >= highs)):
            break
        under = below(diagonal, off, middle) <= index
        lows, highs = np.where(under, middle, lows), np.where(under, highs, middle)
    return (lows + highs) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Elimination with row exchanges of ``T - shift``, as a function of the right side."""
    size = len(diagonal)
    u0, u1, u2 = diagonal - shift, np.append(off, 0.0), np.zeros(size)
    lower, swapped = np.zeros(size), np.zeros(size, bool)
    for i in range(size - 1):
        e, nd, ne = off[i], u0[i + 1], u1[i + 1]
        if abs(e) > abs(u0[i]):
            swapped[i] = True
            lower[i] = u0[i] / e
            first = u1[i]
            u0[i], u1[i], u2[i] = e, nd, ne
            u0[i + 1], u1[i + 1] = first - lower[i] * nd, -lower[i] * ne
        else:
            if abs(u0[i]) < least:
                u0[i] = least
            lower[i] = e / u0[i]
            u0[i + 1] = nd - lower[i] * u1[i]
    u0 = np.where(np.abs(u0) < least, least, u0)

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.copy()
        for i in range(size - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - lower[i] * x[i + 1]
            else:
                x[i + 1] -= lower[i] * x[i]
        for i in range(size - 1, -1, -1):
            after = u1[i] * x[i + 1] if i + 1 < size else 0.0
            after += u2[i] * x[i + 2] if i + 2 < size else 0.0
            x[i] = (x[i] - after) / u0[i]
            most = abs(x[i])
            if most > 1e200:
                x /= most
        return x / np.linalg.norm(x)

    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors by inverse iteration, orthogonal within clusters of values."""
    size = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0))
    eps = np.finfo(float).eps
    draw = np.random.default_rng(size)
    found: list[np.ndarray] = []
    start, shift = 0, np.inf
    for n, value in enumerate(values):
        if n and values[n - 1] - value > 1e-3 * norm:
            start = n
        # Equal values get shifts of their own, or all would give the same vector.
        shift = min(value, shift - 2 * eps * norm)
        solve = _solver(diagonal, off, shift, eps * norm or 1.0)
        x = draw.standard_normal(size)
        for _ in range(6):
            x = solve(x)
            for _ in range(2):
                for other in found[start:]:
                    x = x - (other @ x) * other
            x = x / np.linalg.norm(x)
        found.append(x)
    return np.array(found).reshape(len(values), size)


def turned_back(vectors: np.ndarray, mirrors: list) -> np.ndarray:
    """Eigenvectors of the full matrix from those of the tridiagonal one."""
    out = vectors.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        if v is not None:
            out[:, k + 1 :] -= 2 * np.outer(out[:, k + 1 :] @ v, v)
    return out


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit vectors, one per row."""
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, most)
    values = values[values > len(matrix) * 4 * np.finfo(float).eps * max(values[0], 0.0)]
    vectors = turned_back(leading_vectors(diagonal, off, values), mirrors)
    return values * scale, vectors


def _whole(vector: Column) -> Column:
    """The whole-number vector."""

    def entry(c: Column) -> Column:
        value = c.cast("double") * SCALE
        value = F.least(F.greatest(value, F.lit(-MOST * SCALE)), F.lit(MOST * SCALE))
        return F.floor(value).cast("long") + F.lit(SHIFT).cast("long")

    return F.transform(vector, entry)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x`` of the usable rows; see the module text."""
    limit = F.lit(float("inf"))

    def finite(c: Column) -> Column:
        value = c.cast("double")
        return F.coalesce(~F.isnan(value) & (F.abs(value) < limit), F.lit(False))

    vector = F.col("embedding")
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)
    rows = embeddings.where(F.coalesce(usable, F.lit(False)))
    sizes = rows.groupBy(F.size(vector).alias("entries")).count()
    length = sizes.orderBy(F.desc("count"), F.desc("entries")).first()
    rows = rows.where(F.size(vector) == (length["entries"] if length else 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), _whole(vector).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """A list column as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _cells(sums: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    if sums:
        rows, cols = zip(*sums, strict=True)
        values = pa.array([Decimal(v) for v in sums.values()], pa.decimal128(38, 0))
        yield pa.record_batch(
            [pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), values], schema=_CELL_TYPES
        )


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of vectors (row -1) and sums of their entries (row 0), as cells."""
    n, totals = 0, None
    for batch in batches:
        x = _matrix(batch.column("x"))
        if len(x):
            n += len(x)
            part = x.sum(axis=0, dtype=object)
            totals = part if totals is None else totals + part
    if n:
        yield from _cells({(-1, 0): n, **{(0, i): int(v) for i, v in enumerate(totals)}})


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers, as Python numbers where they need it."""
    most = float(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _product_task(centre: list[int]):
    """Products of the moved vectors, as cells of the upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        move = np.array(centre, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                part = exact_products(x - move)
                total = part if total is None else total + part
        if total is not None:
            rows, cols = np.triu_indices(len(centre))
            yield from _cells(
                {(i, j): int(total[i, j]) for i, j in zip(rows.tolist(), cols.tolist(), strict=True)}
            )

    return run


def _totals(cells: DataFrame) -> dict[tuple[int, int], int]:
    """Cells summed over all tasks; at most one per pair of dimensions."""
    summed = cells.groupBy("row", "col").agg(F.sum("value").alias("value"))
    return {(r["row"], r["col"]): int(r["value"]) for r in summed.collect()}


def fit(distinct: DataFrame, most: int = 16) -> Whitening:
    """Components of a table of distinct whole-number vectors ``x``."""
    found = _totals(distinct.mapInArrow(_sum_task, _CELLS))
    n = found.pop((-1, 0), 0)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    sums = [found[0, i] for i in range(len(found))]
    centre = [_rounded(s, n) for s in sums]
    products = _totals(distinct.mapInArrow(_product_task(centre), _CELLS))
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    covariance = np.zeros((len(sums), len(sums)))
    exact_trace = 0
    for (i, j), value in products.items():
        cell = n * value - rest[i] * rest[j]
        covariance[i, j] = covariance[j, i] = Fraction(cell, n * n)
        exact_trace += cell if i == j else 0
    values, vectors = leading(covariance, most)
    return Whitening(n, sums, values, vectors, float(Fraction(exact_trace, n * n)))


def _moved(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """``x - S / n`` to the last bit or so, and the exact sums of ``(n x - S) ** 2``."""
    y = x - np.array(model.centre, np.int64)
    rest = [s - model.n * c for s, c in zip(model.sums, model.centre, strict=True)]
    centred = y - np.array([float(Fraction(r, model.n)) for r in rest])
    most = (model.n * (float(np.abs(y).max(initial=0)) + 1.0)) ** 2 * len(rest)
    kind = np.int64 if most < float(1 << 62) else object
    scaled = y.astype(kind) * model.n - np.array(rest, kind)
    return centred, (scaled * scaled).sum(axis=1)


def _project_task(model: Whitening):
    weights = (model.vectors / np.sqrt(model.values)[:, None]).T
    shares = model.values / model.trace if model.trace else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x) or not k:
                continue
            centred, deviation = _moved(x, model)
            rows = len(x)
            place = pa.array(np.repeat(np.arange(rows), k))
            with localcontext() as exact:
                exact.prec = 80
                far = pa.array([_fits(int(v)) for v in deviation], pa.decimal128(38, 0))
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(place),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n, np.int64)),
                    far.take(place),
                    pa.array((centred @ weights).ravel()),
                    pa.array(np.tile(shares, rows)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return run


def _fits(value: int) -> Decimal | None:
    return Decimal(value) if value < 10**38 else None


def _whitened_products(model: Whitening):
    """Sums of products of whitened vectors, of one task."""
    weights = (model.vectors / np.sqrt(model.values)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        total = np.zeros((k, k))
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                w = _moved(x, model)[0] @ weights
                total += w.T @ w
        rows, cols = np.divmod(np.arange(k * k, dtype=np.int32), np.int32(max(k, 1)))
        yield pa.record_batch(
            [pa.array(rows), pa.array(cols), pa.array(total.ravel())], names=["row", "col", "value"]
        )

    return run


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    if not len(model.values):
        return 0.0
    cells = distinct.mapInArrow(_whitened_products(model), "row int, col int, value double")
    summed = cells.groupBy("row", "col").agg((F.sum("value") / model.n).alias("value"))
    off = F.abs(F.col("value") - F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0))
    return float(summed.agg(F.max(off)).first()[0])


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained`` of rows ``vec_id, x``.

    ``deviation`` is null beyond 38 digits.
    """
    return vectors.mapInArrow(_project_task(model), _RESULT)


def whitened(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """Whitened rows of ``vec_id, embedding`` with the fit's ``identity_error``."""
    vectors = whole_vectors(embeddings)
    distinct = stored(vectors.select("x").distinct(), "whitening")
    model = fit(distinct, components)
    error = identity_error(distinct, model)
    return transform(vectors, model).withColumn("identity_error", F.lit(error))
