"""Class moments that merge and subtract exactly.

A value counts as the whole number nearest to ``value * 2**40`` (off by less than
1e-12).  A row of the moment table has the number of rows of its key, the sums of
their values and the sums of all products of two values, as whole numbers.  Adding
rows merges groups and subtracting takes a group away again, both without rounding, so
moments kept per class and capture give the state of any choice of captures, equal to
a fit on their rows.  Means, covariances and precisions are worked out from them.

Products are summed in tasks by matrix products of 20-bit parts of the values, which
doubles hold exactly, and between tasks as decimals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.model import GLOBAL_LABEL, ModelError

POINT = 40
_LIMB = 20
_BLOCK = 1024
#: Keys whose sums a task holds; beyond, it passes them on and starts anew.
_HELD_KEYS = 256
#: Largest value: its square times a billion rows still has fewer than 38 digits.
MOST_VALUE = 100.0
_WHOLE = "decimal(38,0)"
_CELLS = pa.list_(pa.decimal128(38, 0))


def whole_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers, exactly, as Python numbers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), _BLOCK):
        block = y[start : start + _BLOCK]
        size, sign = np.abs(block), np.sign(block)
        limbs = []
        while size.any():
            limbs.append((size % (1 << _LIMB) * sign).astype(np.float64))
            size = size >> _LIMB
        for i, left in enumerate(limbs):
            for j, right in enumerate(limbs):
                part = (left.T @ right).astype(np.int64).astype(object)
                total += part << (_LIMB * (i + j)) if i + j else part
    return total


def _summed(keys: Sequence[str], dimension: int):
    upper = np.triu_indices(dimension)

    def rows_of(sums: dict[tuple, list]) -> pa.RecordBatch:
        columns = [pa.array([key[n] for key in sums], pa.string()) for n in range(len(keys))]
        columns.append(pa.array([held[0] for held in sums.values()], pa.int64()))
        cells = [
            [Decimal(int(v)) for v in (*held[1], *held[2][upper])] for held in sums.values()
        ]
        return pa.record_batch([*columns, pa.array(cells, _CELLS)], names=[*keys, "n", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten(), np.float64).reshape(-1, dimension)
            if not np.abs(x).max(initial=0.0) <= MOST_VALUE:
                raise ModelError(f"moments take finite values up to {MOST_VALUE}")
            y = np.rint(x * float(1 << POINT)).astype(np.int64)
            named = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            places: dict[tuple, list[int]] = {}
            for n, key in enumerate(named):
                places.setdefault(key, []).append(n)
            for key, own in places.items():
                part = y[own]
                held = sums.setdefault(key, [0, 0, 0])
                held[0] += len(own)
                held[1] = held[1] + part.sum(axis=0, dtype=object)
                held[2] = held[2] + whole_products(part)
            if len(sums) > _HELD_KEYS:
                yield rows_of(sums)
                sums = {}
        if sums:
            yield rows_of(sums)

    return run


def _added(parts: DataFrame, keys: Sequence[str], sign: Column | None = None) -> DataFrame:
    """Moment rows summed by key, cell by cell."""
    sign = F.lit(1) if sign is None else sign
    cells = parts.select(*keys, (F.col("n") * sign).alias("n"), sign.alias("_sign"), F.posexplode("cells"))
    summed = cells.groupBy(*keys, "pos").agg(
        F.sum("n").alias("n"), F.sum(F.col("col") * F.col("_sign").cast("decimal(1,0)")).alias("col")
    )
    packed = F.sort_array(F.collect_list(F.struct("pos", F.col("col").cast(_WHOLE).alias("col"))))
    return summed.groupBy(*keys).agg(F.max("n").alias("n"), packed["col"].alias("cells"))


def class_moments(
    rows: DataFrame, vector: str, dimension: int, keys: Sequence[str] = ("label", "capture_id")
) -> DataFrame:
    """``*keys, n, cells``: moments of the rows of each key.

    Keys become text.  A task sends one row per key it has met, so a hot class or
    capture costs no more than another one.  A row has ``D + D (D + 1) / 2`` cells.
    """
    named = rows.select(
        *(F.col(k).cast("string").alias(k) for k in keys),
        F.transform(F.col(vector), lambda v: v.cast("double")).alias("x"),
    )
    sized = F.size("x") == dimension
    checked = named.withColumn(
        "x",
        F.when(sized, F.col("x")).otherwise(
            F.raise_error(F.lit(f"a vector does not have {dimension} elements")).cast("array<double>")
        ),
    )
    kinds = ", ".join(f"{k} string" for k in keys)
    parts = checked.mapInArrow(
        _summed(tuple(keys), dimension), f"{kinds}, n bigint, cells array<{_WHOLE}>"
    )
    return _added(parts, list(keys))


def merged(moments: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Moments of coarser groups."""
    return _added(moments, list(keys))


def without(whole: DataFrame, part: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Moments of the rows of ``whole`` that are not in ``part``; empty groups go."""
    both = whole.select(*keys, "n", "cells", F.lit(1).alias("_way")).unionByName(
        part.select(*keys, "n", "cells", F.lit(-1).alias("_way"))
    )
    return _added(both, list(keys), F.col("_way")).where(F.col("n") > 0)


def with_global(moments: DataFrame) -> DataFrame:
    """Moments per label, and of all rows under the label ``*``."""
    return moments.unionByName(_added(moments.withColumn("label", F.lit(GLOBAL_LABEL)), ["label"]))


def matrix_of(n: int, cells: Sequence, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance, each correctly rounded."""
    sums = [int(c) for c in cells[:dimension]]
    products = iter(int(c) for c in cells[dimension:])
    mean = np.array([float(Fraction(s, n << POINT)) for s in sums])
    covariance = np.zeros((dimension, dimension))
    scale = n * n << 2 * POINT
    for i in range(dimension):
        for j in range(i, dimension):
            cell = n * next(products) - sums[i] * sums[j]
            covariance[i, j] = covariance[j, i] = cell / scale
    return mean, covariance


def covariance_cells(moments: DataFrame, dimension: int) -> DataFrame:
    """``label, n, i, j, covariance`` of moments per label, one task per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, covariance = matrix_of(row["n"], row["cells"], dimension)
                i, j = np.divmod(np.arange(dimension * dimension, dtype=np.int32), np.int32(dimension))
                yield pa.record_batch(
                    [
                        pa.array([row["label"]] * len(i), pa.string()),
                        pa.array([row["n"]] * len(i), pa.int64()),
                        pa.array(i),
                        pa.array(j),
                        pa.array(covariance.ravel()),
                    ],
                    names=["label", "n", "i", "j", "covariance"],
                )

    return moments.select("label", "n", "cells").mapInArrow(
        run, "label string, n bigint, i int, j int, covariance double"
    )


def geometry_of(
    moments: DataFrame, labels: Sequence, dimension: int, *, maximum_classes: int = 1024
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Means and pseudo-inverse covariances of every class and of all rows.

    Driver-side state of ``(classes + 1) * D * D`` doubles, bounded by the class
    list, which is refused beyond ``maximum_classes``.  Eigenvalues at or below
    ``D * eps(float32) * max`` count as zero.
    """
    if len(labels) > maximum_classes:
        raise ModelError(f"{len(labels)} classes given, at most {maximum_classes} are allowed")
    wanted = [*map(str, labels), GLOBAL_LABEL]
    geometry = {}
    cutoff = dimension * float(np.finfo(np.float32).eps)
    for row in with_global(moments).where(F.col("label").isin(*wanted)).toLocalIterator():
        if row["n"] >= 2:
            mean, covariance = matrix_of(row["n"], row["cells"], dimension)
            inverse = np.linalg.pinv(covariance, rcond=cutoff, hermitian=True)
            geometry[row["label"]] = (mean, (inverse + inverse.T) / 2)
    missing = sorted(set(wanted) - set(geometry))
    if missing:
        raise ModelError(f"classes with fewer than two support rows: {missing}")
    return geometry


def moment_violations(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Stored moments must be those of the support rows, cell by cell."""
    pairs = stored.select("label", F.col("n").alias("a"), F.col("cells").alias("x")).join(
        rebuilt.select("label", F.col("n").alias("b"), F.col("cells").alias("y")), "label", "full"
    )
    rules = {
        "support_count": ~F.col("a").eqNullSafe(F.col("b")),
        "moments": ~F.col("x").eqNullSafe(F.col("y")),
    }
    broken = F.explode(F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda r: r.isNotNull()))
    return pairs.select(
        broken.alias("rule"),
        F.col("label").alias("key"),
        F.concat_ws("<>", F.col("a"), F.col("b")).alias("detail"),
    )
