"""A frozen model as tables: published once, checked when read back."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import model, moments
from flowloom.operators.validate import (
    binding_violations,
    geometry_violations,
    require_none,
    state_violations,
)
from flowloom.plans.pipelines import FrozenModel
from flowloom.schemas import SUPPORT_PER_CLASS
from flowloom.sinks.tables import write_state
from flowloom.sources.artifacts import read_state

PROVENANCE = ("model_sha256", "calibration_sha256", "feature_sha256", "split_sha256")


def _layer_rows(layers) -> list[tuple]:
    return [
        (i, [[float(v) for v in row] for row in weight], [float(v) for v in bias])
        for i, (weight, bias) in enumerate(layers or [])
    ]


def save_model(frozen: FrozenModel, folder: str, provenance: Mapping[str, str]) -> None:
    """Write every state table of a model and the hashes it was made from."""
    spark = frozen.statistics.sparkSession
    kind = frozen.statistics.schema["label"].dataType.simpleString()
    labels = spark.createDataFrame(
        [(i, v) for i, v in enumerate(frozen.labels)], f"position int, label {kind}"
    )
    hashes = spark.createDataFrame(
        [tuple(provenance[n] for n in PROVENANCE)], ", ".join(f"{n} string" for n in PROVENANCE)
    )
    layers = spark.createDataFrame(
        _layer_rows(frozen.layers),
        "layer int, weight array<array<double>>, bias array<double>",
    )
    tables: dict[str, DataFrame] = {
        "labels": labels,
        "statistics": frozen.statistics,
        "moments": frozen.moments,
        "densities": frozen.densities,
        "density_blocks": frozen.blocks,
        "layers": layers,
    }
    if frozen.scaler is not None:
        tables["scaler"] = frozen.scaler
    for name, table in tables.items():
        write_state(table, folder, name)
    # Written last: a folder without it is not a complete model.
    write_state(hashes, folder, "provenance")


def load_model(
    spark: SparkSession,
    folder: str,
    *,
    scaled: bool = False,
    maximum_support: int = SUPPORT_PER_CLASS,
    expected: Mapping[str, str] | None = None,
) -> FrozenModel:
    """Read a model back under its contract: shapes, finite values, provenance.

    Precisions are not stored: they are rebuilt from the stored moments, whose
    covariances are checked.
    """
    statistics = read_state(spark, folder, "statistics")
    labels = tuple(
        r["label"] for r in read_state(spark, folder, "labels").orderBy("position").collect()
    )
    dimension = len(statistics.first()["mean"])
    scaler = read_state(spark, folder, "scaler") if scaled else None
    checked = scaler if scaler is not None else spark.createDataFrame(
        [([0.0], [1.0])], "mean array<double>, scale array<double>"
    )
    require_none(
        state_violations(
            statistics, checked, maximum_support=maximum_support, dimension=dimension
        ),
        "model state",
    )
    if expected is not None:
        wanted = spark.createDataFrame(
            [tuple(expected[n] for n in PROVENANCE)], ", ".join(f"{n} string" for n in PROVENANCE)
        )
        require_none(
            binding_violations(read_state(spark, folder, "provenance"), wanted), "model binding"
        )
    stored = read_state(spark, folder, "moments")
    cells = moments.covariance_cells(moments.with_global(stored), dimension)
    require_none(geometry_violations(cells), "model geometry")
    layers = [
        (np.asarray(r["weight"], dtype=np.float32), np.asarray(r["bias"], dtype=np.float32))
        for r in read_state(spark, folder, "layers").orderBy("layer").collect()
    ]
    return FrozenModel(
        labels=labels,
        dimension=dimension,
        scaler=scaler,
        layers=layers or None,
        statistics=statistics,
        moments=stored,
        classes=model.class_state(statistics, labels),
        geometry=moments.geometry_of(stored, labels, dimension),
        densities=read_state(spark, folder, "densities"),
        blocks=read_state(spark, folder, "density_blocks"),
    )


def evaluation_report(
    tables: Mapping[str, DataFrame], *, schema_version: str, partition: str
) -> DataFrame:
    """One nested row out of evaluation tables, for the report sinks.

    Every table is bounded by the class list and the thresholds.
    """
    report = None
    for name, table in sorted(tables.items()):
        one = table.agg(
            F.array_sort(F.collect_list(F.struct(*table.columns))).alias(name),
        ).withColumn("_one", F.lit(True))
        report = one if report is None else report.join(one, "_one")
    return report.select(
        F.lit(schema_version).alias("schema_version"),
        F.lit(partition).alias("evaluation_partition"),
        F.struct(*sorted(tables)).alias("results"),
    )
