"""Composed jobs: captures to features, calibration, scoring and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import density, evaluate, model, moments, splits
from flowloom.operators.features import feature_vectors
from flowloom.operators.flows import assign_flows
from flowloom.operators.validate import require_none, support_violations
from flowloom.operators.windows import observation_windows, window_packets
from flowloom.schemas import (
    BIN_SECONDS,
    ECE_BINS,
    MINIMUM_PACKETS,
    OOD_THRESHOLDS,
    SUPPORT_PER_CLASS,
    SUPPORT_SEED,
    WINDOW_SECONDS,
)
from flowloom.session import cut_lineage
from flowloom.sources.captures import read_captures, valid_packets

Layers = Sequence[tuple[np.ndarray, np.ndarray]]


def capture_windows(spark: SparkSession, path: str, **options) -> DataFrame:
    """Capture files to retained observation windows; unreadable input is refused."""
    packets, faults = read_captures(spark, path)
    require_none(faults, path)
    return observation_windows(assign_flows(valid_packets(packets)), **options)


def capture_features(
    spark: SparkSession,
    path: str,
    *,
    window_seconds: float = WINDOW_SECONDS,
    bin_seconds: float = BIN_SECONDS,
    minimum_packets: int = MINIMUM_PACKETS,
    **options,
) -> DataFrame:
    """Capture files to feature rows in one call; unreadable input is refused."""
    packets, faults = read_captures(spark, path)
    require_none(faults, path)
    windowed = window_packets(assign_flows(valid_packets(packets)), window_seconds)
    return feature_vectors(
        windowed,
        window_seconds=window_seconds,
        bin_seconds=bin_seconds,
        minimum_packets=minimum_packets,
        **options,
    )


@dataclass(frozen=True)
class FrozenModel:
    """State that scores rows: scaler, network, class state, geometry, densities."""

    labels: tuple
    dimension: int
    scaler: DataFrame | None
    layers: Layers | None
    statistics: DataFrame
    moments: DataFrame
    classes: model.ClassState
    geometry: Mapping[str, tuple[np.ndarray, np.ndarray]]
    densities: DataFrame
    blocks: DataFrame


def prepare(
    rows: DataFrame, scaler: DataFrame | None, layers: Layers | None, vector: str
) -> DataFrame:
    """Standardize and embed a vector column where the model has those steps."""
    if scaler is not None:
        rows = model.standardize(rows, scaler, vector)
    if layers is not None:
        rows = model.embed(rows, layers, vector=vector, name=vector)
    return rows


def calibrate(
    training: DataFrame,
    calibration: DataFrame,
    labels: Sequence,
    *,
    vector: str,
    dimension: int,
    scaler: DataFrame | None = None,
    layers: Layers | None = None,
    maximum_support: int = SUPPORT_PER_CLASS,
    seed: int = SUPPORT_SEED,
    stored_statistics: DataFrame | None = None,
) -> FrozenModel:
    """Geometry from training support only, densities from calibration rows only.

    Support is at most ``maximum_support`` rows per class.  With stored class
    statistics the support must reproduce them.
    """
    if "capture_id" in training.columns and "capture_id" in calibration.columns:
        shared = splits.capture_overlap(training, calibration)
        if not shared.isEmpty():
            raise model.ModelError("a capture is in training and in calibration")
    support = cut_lineage(
        prepare(
            model.select_support(training, maximum_per_class=maximum_support, seed=seed),
            scaler,
            layers,
            vector,
        ).select("label", vector)
    )
    statistics = model.class_statistics(support, vector, dimension)
    if stored_statistics is not None:
        require_none(support_violations(stored_statistics, statistics), "support statistics")
    # One row per class, read here, by the store and by its checks.
    summed = cut_lineage(moments.class_moments(support, vector, dimension, ["label"]))
    geometry = moments.geometry_of(summed, labels, dimension)
    samples = model.with_relative_mahalanobis(
        prepare(calibration, scaler, layers, vector), geometry, vector=vector, label="label"
    ).select("label", "relative_distance")
    densities = density.fit_densities(samples, score="relative_distance")
    blocks = cut_lineage(
        density.density_blocks(samples, densities, score="relative_distance")
    )
    return FrozenModel(
        labels=tuple(labels),
        dimension=dimension,
        scaler=scaler,
        layers=layers,
        statistics=statistics,
        moments=summed,
        classes=model.class_state(statistics, labels),
        geometry=geometry,
        densities=densities,
        blocks=blocks,
    )


def score_rows(rows: DataFrame, frozen: FrozenModel, *, vector: str) -> DataFrame:
    """Probabilities, predicted class, relative distance and density score per row."""
    embedded = prepare(rows, frozen.scaler, frozen.layers, vector)
    scored = model.with_scores(embedded, frozen.classes, frozen.geometry, vector=vector)
    return density.with_ood_score(scored, frozen.blocks)


def traceable(scored: DataFrame, provenance: Mapping[str, str]) -> DataFrame:
    """Attach the hashes a prediction was made with."""
    return scored.withColumns(
        {
            name: F.lit(provenance[name])
            for name in ("model_sha256", "calibration_sha256", "feature_sha256", "split_sha256")
        }
    )


def evaluate_scores(
    scored: DataFrame,
    labels: Sequence,
    *,
    bins: int = ECE_BINS,
    thresholds: Sequence[float] = OOD_THRESHOLDS,
) -> dict[str, DataFrame]:
    """All evaluation tables of one scored set; the set is written once and read often."""
    kept = cut_lineage(
        scored.select("label", "predicted", "raw_confidence", "ood_score")
    )
    confusion = evaluate.confusion_counts(kept, labels)
    per_class = evaluate.class_metrics(confusion)
    return {
        "confusion": confusion,
        "class_metrics": per_class,
        "overall_metrics": evaluate.overall_metrics(per_class),
        "calibration_error": evaluate.expected_calibration_error(
            evaluate.calibration_bins(kept, bins=bins)
        ),
        "score_summary": evaluate.score_summary(kept),
        "flag_rates": evaluate.flag_rates(kept, thresholds=thresholds),
    }


def validate_candidate(
    training: DataFrame,
    validation: DataFrame,
    labels: Sequence,
    *,
    vector: str,
    dimension: int,
    scaler: DataFrame | None = None,
    layers: Layers | None = None,
    maximum_support: int = SUPPORT_PER_CLASS,
    bins: int = ECE_BINS,
) -> dict[str, DataFrame]:
    """Closed-set metrics of a candidate: support from training, scored on validation."""
    if "capture_id" in training.columns and "capture_id" in validation.columns:
        if not splits.capture_overlap(training, validation).isEmpty():
            raise model.ModelError("a capture is in training and in validation")
    support = prepare(
        model.select_support(training, maximum_per_class=maximum_support), scaler, layers, vector
    )
    statistics = model.class_statistics(support, vector, dimension)
    state = model.class_state(statistics, labels)
    distances = model.with_mahalanobis(
        prepare(validation, scaler, layers, vector), state, vector
    )
    predicted = cut_lineage(
        model.with_prediction(
            distances, labels, F.transform("distances", lambda d: -d)
        ).select("label", "predicted", "raw_confidence")
    )
    confusion = evaluate.confusion_counts(predicted, labels)
    per_class = evaluate.class_metrics(confusion)
    return {
        "statistics": statistics,
        "confusion": confusion,
        "class_metrics": per_class,
        "overall_metrics": evaluate.overall_metrics(per_class),
        "calibration_error": evaluate.expected_calibration_error(
            evaluate.calibration_bins(predicted, bins=bins)
        ),
    }


# A scorer takes feature rows and returns them with prediction columns.
Scorer = Callable[[DataFrame], DataFrame]


def frozen_scorer(frozen: FrozenModel, *, vector: str = "features") -> Scorer:
    """The default scorer of the prediction pipeline."""
    return lambda rows: score_rows(rows, frozen, vector=vector)
