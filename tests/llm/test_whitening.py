from __future__ import annotations

import math

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import queries, whitening


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10_000), st.sampled_from(["any", "equal", "thin", "diagonal"]))
def test_leading_components(size, seed, kind):
    draw = np.random.default_rng(seed)
    a = draw.standard_normal((3 * size, size))
    matrix = a.T @ a / size
    if kind == "diagonal":
        matrix = np.diag(draw.random(size))
    if kind == "equal":
        q, _ = np.linalg.qr(draw.standard_normal((size, size)))
        matrix = q @ np.diag(draw.choice([1.0, 2.0], size)) @ q.T
    if kind == "thin":
        b = draw.standard_normal((size, 2))
        matrix = b @ b.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading(matrix, 16)
    want = np.linalg.eigvalsh(matrix)[::-1]
    scale = want[0]
    assert np.abs(values - want[: len(values)]).max() < 1e-13 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-12 * scale
    assert len(values) == min(16, 2 if kind == "thin" else size, size)


def test_counts_of_values_below():
    diagonal, off = np.array([2.0, 2.0, 2.0, 2.0]), np.array([-1.0, -1.0, -1.0])
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    points = np.concatenate([values - 1e-9, values + 1e-9])
    assert whitening.below(diagonal, off, points).tolist() == [0, 1, 2, 3, 1, 2, 3, 4]


@pytest.mark.parametrize("most", [100, 1 << 30, 1 << 44])
def test_products_are_exact(most):
    y = np.random.default_rng(1).integers(-most, most, (50, 3))
    want = y.astype(object).T @ y.astype(object)
    assert (whitening.exact_products(y) == want).all()


def _reference(vectors):
    """Rows of the contract by numpy's eigenvectors and Python's whole numbers."""
    xs = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    covariance = centred.T @ centred / n
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1], components.T[::-1]
    rows = []
    for x in xs:
        y = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        rows.append(
            (
                n,
                sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)),
                components @ y / np.sqrt(values),
                values / np.trace(covariance),
            )
        )
    return rows


def _check(rows, vectors, most):
    want = _reference(list(vectors.values()))
    signs = {}
    assert len(rows) == len(vectors) * most
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    for key, (n, deviation, whitened, shares) in zip(vectors, want, strict=True):
        for k in range(most):
            r = by[key][k + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(shares[k], rel=1e-9)
            assert r.identity_error < 1e-8
            if abs(whitened[k]) > 1e-6:
                sign = signs.setdefault(k, np.sign(whitened[k]) * np.sign(r.whitened))
                assert r.whitened == pytest.approx(sign * whitened[k], rel=1e-6, abs=1e-9)


def test_query_equals_direct_computation(spark):
    found = queries.op12_whitening(spark, cases.SF).collect()
    source = spark.read.parquet(f"{cases.SF}/embeddings.parquet").collect()
    _check(found, {r.vec_id: r.embedding for r in source}, 16)
    assert found[0].identity_error == max(r.identity_error for r in found)


SCHEMA = "vec_id long, embedding array<double>, x string, n string, value string"


def test_awkward_rows(spark):
    draw = np.random.default_rng(3)
    good = {n: draw.standard_normal(5).tolist() for n in range(30)}
    bad = [
        None, [], [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf, 1.0, 1.0, 1.0, 1.0],
        [1.0, 2.0], [1.0] * 6,
    ]
    copies = {100 + n: good[7] for n in range(200)}
    rows = [(k, v, None, None, None) for k, v in {**good, **copies}.items()]
    rows += [(900 + n, v, None, None, None) for n, v in enumerate(bad)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = whitening.whitened(table, 16).collect()
    _check(found, {**good, **copies}, 5)
    repeated = table.where("vec_id = 3").unionByName(table)
    assert whitening.whitened(repeated, 2).where("vec_id = 3").count() == 4


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_tables_without_variance_give_no_rows(spark, vectors):
    rows = [(n, v, None, None, None) for n, v in enumerate(vectors)]
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_far_entries_keep_exact_deviations(spark):
    vectors = {0: [1e30, 0.0], 1: [-5.0, 1.0], 2: [3.0, 2.0]}
    rows = [(k, v, None, None, None) for k, v in vectors.items()]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA), 1).collect()
    clamped = {**vectors, 0: [float(1 << 45), 0.0]}
    want = [w[1] for w in _reference(list(clamped.values()))]
    assert [int(r.deviation) for r in sorted(found, key=lambda r: r.vec_id)] == want
