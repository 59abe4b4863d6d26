"""Baselines, prototypes, geometry, densities, metrics and exact quantiles."""

from __future__ import annotations

import math

import numpy as np
import pytest
from flowloom.functions.ordered import exact_quantiles
from flowloom.functions.vectors import log_sum_exp, normal_cdf, softmax
from flowloom.operators import density, evaluate, model
from flowloom.operators.validate import (
    ContractError,
    density_violations,
    geometry_violations,
    partition_violations,
    state_violations,
    support_violations,
)
from flowloom.plans import pipelines
from flowloom.plans.frozen import PROVENANCE, evaluation_report, load_model, save_model
from flowloom.schemas import CATEGORIES
from flowloom.session import scratch_path
from flowloom.sinks.tables import write_report
from pyspark.sql import functions as F

D = 6
LABELS = ("a", "b", "c")


def vectors(n=240, seed=2):
    source = np.random.default_rng(seed)
    labels = source.integers(0, 3, n)
    x = source.normal(size=(n, D)) + labels[:, None] * 2.0
    x[:, 4] = 1.5  # no variance anywhere
    x[labels == 1, 5] = 0.0  # no variance in one class
    return labels, x.astype(np.float32)


@pytest.fixture(scope="module")
def rows(spark):
    labels, x = vectors()
    return spark.createDataFrame(
        [(i, LABELS[k], [float(v) for v in r]) for i, (k, r) in enumerate(zip(labels, x, strict=True))],
        "row_id bigint, label string, v array<float>",
    ).cache()


def cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def test_normal_cdf(spark):
    points = [x / 7 for x in range(-280, 281)]
    df = spark.createDataFrame([(p,) for p in points], "z double")
    for r in df.select("z", normal_cdf(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(cdf(r["z"]), abs=1e-15)


def test_softmax_and_log_sum_exp(spark):
    logits = [-1000.0, -1001.0, -1003.0]
    df = spark.createDataFrame([(logits,)], "l array<double>")
    row = df.select(softmax(F.col("l")).alias("p"), log_sum_exp(F.col("l")).alias("s")).first()
    weights = np.exp(np.array(logits) + 1000)
    assert row["p"] == pytest.approx(list(weights / weights.sum()))
    assert row["s"] == pytest.approx(-1000 + math.log(weights.sum()))


def test_standardizer_keeps_constant_elements(spark, rows):
    _, x = vectors()
    scaler = model.fit_standardizer(rows, "v", D)
    state = scaler.first()
    assert state["mean"] == pytest.approx(list(x.astype(float).mean(axis=0)), rel=1e-6)
    assert state["scale"][4] == 1.0
    scaled = model.standardize(rows, scaler, "v").orderBy("row_id").collect()
    got = np.array([r["v"] for r in scaled])
    assert np.allclose(got.std(axis=0)[:4], 1.0, atol=1e-5) and np.allclose(got[:, 4], 0.0)


def test_majority_takes_the_smallest_label_on_a_tie(spark):
    df = spark.createDataFrame([("x",), ("b",), ("b",), ("x",), ("z",)], "label string")
    row = model.majority_class(df).first()
    assert (row["label"], row["rows"], row["prior"]) == ("b", 2, 0.4)


def test_logistic_separates_the_classes(rows):
    scaler = model.fit_standardizer(rows, "v", D)
    scaled = model.standardize(rows, scaler, "v")
    fitted = model.fit_balanced_logistic(scaled, LABELS, vector="v")
    predicted = model.predict_logistic(fitted, scaled, LABELS, vector="v")
    assert predicted.where("label = predicted").count() > 0.9 * predicted.count()
    with pytest.raises(model.ModelError):
        model.fit_balanced_logistic(scaled, LABELS, vector="v", maximum_iterations=1)


def test_episodes_are_disjoint_and_repeatable(rows):
    got = model.sample_episodes(rows, episodes=2, support_per_class=3, queries=20)
    found = {tuple(r) for r in got.collect()}
    assert found == {tuple(r) for r in got.collect()}
    for episode in (1, 2):
        support = {r[2] for r in found if r[0] == episode and r[1] == "support"}
        query = {r[2] for r in found if r[0] == episode and r[1] == "query"}
        assert len(support) == 9 and len(query) == 20 and not support & query


def test_every_class_is_required(rows):
    statistics = model.class_statistics(rows.where("label <> 'b'"), "v", D)
    with pytest.raises(model.ModelError):
        model.class_state(statistics, LABELS)


def test_scores_match_numpy(rows):
    labels, x = vectors()
    x = x.astype(float)
    statistics = model.class_statistics(rows, "v", D)
    state = model.class_state(statistics, LABELS)
    cutoff = D * float(np.finfo(np.float32).eps)
    distances = np.empty((len(x), 3))
    for k in range(3):
        v = x[labels == k].var(axis=0)
        w = np.where(v > cutoff * v.max(), 1 / np.where(v > 0, v, 1), 0)
        distances[:, k] = ((x - x[labels == k].mean(axis=0)) ** 2 * w).sum(axis=1)
    got = model.with_mahalanobis(rows, state, "v").orderBy("row_id").collect()
    assert np.allclose([r["distances"] for r in got], distances)

    geometry = model.read_geometry(
        model.global_statistics(rows, "v", D), model.class_covariance(rows, "v", D), LABELS, D
    )
    whole = np.linalg.pinv(np.cov(x.T, ddof=0), rcond=cutoff, hermitian=True)
    best = distances.argmin(axis=1)
    relative = np.empty(len(x))
    for i, k in enumerate(best):
        own = x[labels == k]
        p = np.linalg.pinv(np.cov(own.T, ddof=0), rcond=cutoff, hermitian=True)
        d, g = x[i] - own.mean(axis=0), x[i] - x.mean(axis=0)
        relative[i] = d @ p @ d - g @ whole @ g
    scored = model.with_scores(rows, state, geometry, vector="v").orderBy("row_id").collect()
    assert [r["predicted"] for r in scored] == [LABELS[k] for k in best]
    assert np.allclose([r["relative_distance"] for r in scored], relative, atol=1e-6)
    steps = model.with_prediction(
        model.with_mahalanobis(rows, state, "v"), LABELS, F.transform("distances", lambda d: -d)
    )
    apart = model.with_relative_mahalanobis(
        steps.select("row_id", "v", "predicted", "class_probabilities").cache(),
        geometry, vector="v", label="predicted",
    ).orderBy("row_id").collect()
    assert np.allclose([r["relative_distance"] for r in apart], relative, atol=1e-6)
    assert np.allclose(
        [r["class_probabilities"] for r in apart], [r["class_probabilities"] for r in scored]
    )
    assert geometry_violations(model.class_covariance(rows, "v", D)).count() == 0


def test_embedding_network(spark, rows):
    source = np.random.default_rng(1)
    layers = [(source.normal(size=(5, D)), source.normal(size=5)), (source.normal(size=(4, 5)), source.normal(size=4))]
    _, x = vectors()
    expected = x
    for w, b in layers:
        expected = np.maximum(expected @ w.astype(np.float32).T + b.astype(np.float32), 0)
    got = model.embed(rows, layers, vector="v").orderBy("row_id").collect()
    assert np.allclose([r["embedding"] for r in got], expected, atol=1e-5)


@pytest.mark.parametrize("n", [2, 9, 4000])
def test_density_scores_equal_the_direct_sum(spark, n):
    source = np.random.default_rng(n)
    samples = np.concatenate([source.normal(size=n - 1), [40.0]])  # one far outlier
    points = np.concatenate([samples[:60], source.normal(size=60) * 3, [-1e4, 1e4, 40.0, 39.0, 20.0]])
    calibrated = spark.createDataFrame([("a", float(s)) for s in samples], "label string, score double")
    scored = spark.createDataFrame(
        [(i, "a", float(p)) for i, p in enumerate(points)] + [(-1, "none", 0.0)],
        "row_id bigint, predicted string, relative_distance double",
    )
    densities = density.fit_densities(calibrated)
    h = samples.std(ddof=1) * n ** (-0.2)
    assert densities.first()["bandwidth"] == pytest.approx(h)
    blocks = density.density_blocks(calibrated, densities)
    got = {r["row_id"]: r["ood_score"] for r in density.with_ood_score(scored, blocks).collect()}
    assert got.pop(-1) is None
    for i, p in enumerate(points):
        direct = np.mean([cdf((p - s) / h) for s in samples])
        assert got[i] == pytest.approx(direct, abs=1e-11)
    assert density_violations(densities, calibrated).count() == 0


@pytest.mark.parametrize("kind", ["spread", "ties", "tiny"])
def test_quantiles_are_exact(spark, kind):
    source = np.random.default_rng(4)
    values = {
        "spread": source.normal(size=30_000),
        "ties": np.concatenate([np.zeros(9_000), source.integers(-3, 3, 18_000)]).astype(float),
        "tiny": np.array([3.0, 1.0, 2.0, 10.0, 7.0, 4.5, 0.5, 9.0, 8.0, 6.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {r["probability"]: r["quantile"] for r in exact_quantiles(df, "x", probabilities, accuracy=1000).collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_metrics_are_zero_where_undefined(spark):
    df = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("b", "b")], "label string, predicted string"
    )
    confusion = evaluate.confusion_counts(df, LABELS)
    assert confusion.count() == 9
    per_class = {r["label"]: r for r in evaluate.class_metrics(confusion).collect()}
    assert (per_class["c"]["precision"], per_class["c"]["recall"], per_class["c"]["f1"]) == (0, 0, 0)
    assert per_class["b"]["precision"] == 0.5 and per_class["a"]["recall"] == 0.5
    overall = evaluate.overall_metrics(evaluate.class_metrics(confusion)).first()
    assert overall["accuracy"] == pytest.approx(2 / 3)
    assert overall["balanced_accuracy"] == pytest.approx(0.75)


def test_loss_and_parity(spark):
    losses = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 2.0)], "episode int, loss double")
    row = evaluate.loss_summary(losses).first()
    assert tuple(row) == (3, 3.0, 2.0, 1.0)
    left = spark.createDataFrame([("w", 1.0), ("x", 2.0)], "window_id string, f double")
    right = spark.createDataFrame([("w", 1.5), ("y", 2.0)], "window_id string, f double")
    assert tuple(evaluate.feature_parity(left, right, ["f"]).first()) == (3, 1, 1, 0.5)


def test_calibrate_score_and_evaluate(spark, rows):
    split = rows.withColumn("capture_id", F.concat(F.lit("c"), F.col("row_id") % 3))
    train, calibration = split.where("row_id % 3 = 0"), split.where("row_id % 3 = 1")
    frozen = pipelines.calibrate(train, calibration, LABELS, vector="v", dimension=D)
    test = split.where("row_id % 3 = 2")
    scored = pipelines.traceable(
        pipelines.score_rows(test, frozen, vector="v"),
        dict.fromkeys(("model_sha256", "calibration_sha256", "feature_sha256", "split_sha256"), "x"),
    )
    assert scored.count() == test.count()
    assert scored.where("ood_score < 0 or ood_score > 1 or ood_score is null").count() == 0
    tables = pipelines.evaluate_scores(scored, LABELS)
    assert tables["overall_metrics"].first()["accuracy"] > 0.9
    assert tables["score_summary"].first()["maximum"] <= 1.0
    assert tables["flag_rates"].count() == 2 * 4
    checked = pipelines.validate_candidate(train, test, LABELS, vector="v", dimension=D)
    assert checked["overall_metrics"].first()["accuracy"] > 0.9
    with pytest.raises(model.ModelError):
        pipelines.calibrate(train, train, LABELS, vector="v", dimension=D)
    scaler = model.fit_standardizer(train, "v", D)
    assert state_violations(frozen.statistics, scaler, maximum_support=100, dimension=D).count() == 0
    folder = scratch_path(spark, "model")
    hashes = {n: n[0] for n in PROVENANCE}
    save_model(frozen, folder, hashes)
    again = load_model(spark, folder, expected=hashes)
    rescored = pipelines.score_rows(test, again, vector="v")
    columns = ["row_id", "predicted", "relative_distance", "ood_score"]
    assert rescored.select(columns).exceptAll(scored.select(columns)).count() == 0
    with pytest.raises(ContractError):
        load_model(spark, folder, expected=hashes | {"model_sha256": "other"})
    report = evaluation_report(tables, schema_version="test-1", partition="test")
    write_report(report, f"{folder}/report.json")
    stored = spark.read.json(f"{folder}/report.json").first()
    assert len(stored["results"]["confusion"]) == 9
    moved = frozen.statistics.withColumn("mean", F.transform("mean", lambda m: m + 1))
    assert support_violations(moved, frozen.statistics).count() == 3


def test_partition_contract(spark):
    df = spark.createDataFrame(
        [("train", "c1", c, [1.0, 2.0]) for c in CATEGORIES[:4]]
        + [("test", "", "OTHER", [1.0, float("nan")])],
        "partition string, capture_id string, category string, features array<double>",
    )
    rules = {r["rule"] for r in partition_violations(df, "train", dimension=2).collect()}
    assert rules == {
        "partition_role", "vector_not_finite", "capture_id_empty", "category_unknown",
        "category_missing",
    }
