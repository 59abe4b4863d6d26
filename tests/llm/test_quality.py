from __future__ import annotations

import zlib

import cases
import numpy as np

from flowloom.llm import quality, queries
from flowloom.llm.common import fold, table


def test_isotonic_equals_the_min_max_formula():
    draw = np.random.default_rng(2)
    count = draw.integers(1, 6, 60).astype(float)
    good = draw.uniform(0, 1, 60) * count
    places, levels = quality.isotonic(count, good)
    fitted = np.interp(np.arange(60), places, levels)
    for i in range(60):
        best = max(
            min(good[a : b + 1].sum() / count[a : b + 1].sum() for b in range(i, 60))
            for a in range(i + 1)
        )
        assert abs(fitted[i] - best) < 1e-9


def test_features_approximate_the_gaussian_kernel():
    model = quality.KernelRidge(features=20_000)
    rows = np.random.default_rng(0).normal(size=(6, quality.STATISTICS))
    waves = model.features(rows)[:, :-1]
    gap = ((rows[:, None] - rows[None]) ** 2).sum(-1)
    kernel = np.exp(-gap / (2 * 1.5**2 * quality.STATISTICS))
    assert np.abs(waves @ waves.T - kernel).max() < 0.05


def test_normal_equations_equal_a_direct_fit(spark):
    stats = quality.statistics_rows(table(spark, cases.SF, "documents"))
    labels = quality.quality_labels(table(spark, cases.SF, "labels"))
    model = quality.fit(stats.repartition(5), labels, ridge=0.5, features=16)
    got = {r.doc_id: r.stats for r in stats.collect()}
    own = [(got[r.doc_id], r.label) for r in labels.where("not calibrate").collect()]
    rows, label = np.array([o[0] for o in own]), np.array([o[1] for o in own], float)
    direct = quality.KernelRidge(features=16)
    direct.mean, direct.scale = rows.mean(0), rows.std(0) + 1e-3
    waves = direct.features(rows)
    weights = np.linalg.solve(waves.T @ waves + 0.5 * np.eye(17), waves.T @ label)
    assert np.allclose(model.weights, weights, atol=1e-4)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op2_quality(spark, folder).collect()
    label = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p == k for _, p, k in held]) > 0.95
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, p, _ in held)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    labels = table(spark, cases.SF, "labels")
    used = quality.quality_labels(labels)
    assert used.where(fold(used["doc_id"], 5) == 0).count() == 0


def test_awkward_rows(spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (6, 1, None), (6, 0, 0), (None, 1, 1), (9, None, None)],
        "doc_id long, quality int, toxic int",
    )
    docs = cases.documents(spark)
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id == 2]
    assert same[0] == same[1]
    assert quality.quality_scores(cases.empty(spark), labels).count() == 0
    unknown = quality.quality_scores(docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 0.01 for r in unknown)
    kept = quality.keep_good(docs, quality.KernelRidge())
    assert kept.columns == docs.columns and kept.count() == len(cases.ROWS)
