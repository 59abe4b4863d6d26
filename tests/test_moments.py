"""Moments that merge and subtract exactly."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from flowloom.operators import moments
from flowloom.operators.model import ModelError
from flowloom.operators.validate import geometry_violations

D = 5


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(2)
    table = [
        ("ab"[n % 2], f"c{n * 7 % 11 % 4}", (draw.standard_normal(D) * 3.0).tolist()) for n in range(600)
    ]
    table += [("a", "hot", [1.0, -2.0, 0.5, 0.0, 99.0])] * 300
    return spark.createDataFrame(table, "label string, capture_id string, v array<double>").cache()


def cells_of(df):
    return {(r.label): (r.n, tuple(map(int, r.cells))) for r in df.collect()}


def test_whole_products():
    for most in (5, 1 << 21, 1 << 41, (1 << 46) - 1):
        y = np.random.default_rng(1).integers(-most, most, (2500, 3))
        assert (moments.whole_products(y) == y.astype(object).T @ y.astype(object)).all()


def test_merging_and_taking_away_equal_a_fresh_fit(rows):
    apart = moments.class_moments(rows, "v", D)
    direct = cells_of(moments.class_moments(rows, "v", D, ["label"]))
    assert cells_of(moments.merged(apart)) == direct
    assert cells_of(moments.merged(moments.class_moments(rows.repartition(13), "v", D))) == direct
    rest = moments.without(
        moments.merged(apart), moments.merged(apart.where("capture_id IN ('hot', 'c1')"))
    )
    fresh = moments.class_moments(rows.where("capture_id NOT IN ('hot', 'c1')"), "v", D, ["label"])
    assert cells_of(rest) == cells_of(fresh)
    assert cells_of(moments.without(moments.merged(apart), moments.merged(apart.where("label = 'b'")))) == {
        "a": direct["a"]
    }
    assert moments.moment_violations(rest, fresh).count() == 0
    found = moments.moment_violations(moments.merged(apart), fresh).collect()
    assert {(r.rule, r.key) for r in found} == {
        (rule, key) for rule in ("support_count", "moments") for key in "ab"
    }


def test_covariance_and_geometry(rows):
    summed = moments.class_moments(rows, "v", D, ["label"])
    cells = moments.covariance_cells(moments.with_global(summed), D)
    assert geometry_violations(cells).count() == 0
    got = {}
    for r in cells.collect():
        got.setdefault(r.label, np.zeros((D, D)))[r.i, r.j] = r.covariance
    geometry = moments.geometry_of(summed, ["a", "b"], D)
    for label in ("a", "b", "*"):
        chosen = rows if label == "*" else rows.where(f"label = '{label}'")
        x = np.array([r.v for r in chosen.collect()])
        want = np.cov(x.T, bias=True)
        assert np.abs(got[label] - want).max() < 1e-9 * np.abs(want).max()
        assert np.abs(geometry[label][0] - x.mean(0)).max() < 1e-11
        assert np.abs(geometry[label][1] @ want - np.eye(D)).max() < 1e-6


def test_correct_rounding():
    y = [3, 1 << 39, -(1 << 41)]
    mean, covariance = moments.matrix_of(3, [sum(y), sum(v * v for v in y)], 1)
    values = [Fraction(v, 1 << 40) for v in y]
    middle = sum(values) / 3
    assert mean[0] == float(middle)
    assert covariance[0, 0] == float(sum((v - middle) ** 2 for v in values) / 3)


def test_faults(spark, rows):
    assert moments.class_moments(rows.limit(0), "v", D).count() == 0
    with pytest.raises(ModelError):
        moments.geometry_of(moments.class_moments(rows, "v", D, ["label"]), ["a", "z"], D)
    with pytest.raises(ModelError):
        moments.geometry_of(moments.class_moments(rows, "v", D, ["label"]), ["a", "b"], D, maximum_classes=1)
    for vector in ([1.0], [float("nan")] * D, [1e9] * D):
        bad = spark.createDataFrame([("a", "c", vector)], rows.schema)
        with pytest.raises(Exception):  # noqa: B017, PT011
            moments.class_moments(bad, "v", D).collect()
