"""Classification, calibration and out-of-distribution evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.ordered import exact_quantiles
from flowloom.schemas import ECE_BINS, OOD_THRESHOLDS


def confusion_counts(
    df: DataFrame, labels: Sequence, *, expected: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """All label pairs in fixed order with their counts, zeros kept."""
    kind = df.schema[expected].dataType.simpleString()
    every = df.sparkSession.createDataFrame(
        [(a, b) for a in labels for b in labels], f"expected {kind}, predicted {kind}"
    )
    counted = df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return every.join(counted, ["expected", "predicted"], "left").select(
        "expected", "predicted", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; zero where undefined."""
    sides = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("expected").alias("label"), F.lit(True).alias("is_expected")),
                F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_expected")),
            )
        ).alias("side"),
        "rows",
        (F.col("expected") == F.col("predicted")).alias("hit"),
    )
    counts = sides.groupBy(F.col("side.label").alias("label")).agg(
        F.sum(F.when(F.col("side.is_expected"), F.col("rows")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("side.is_expected"), F.col("rows")).otherwise(0)).alias("claimed"),
        F.sum(
            F.when(F.col("hit") & F.col("side.is_expected"), F.col("rows")).otherwise(0)
        ).alias("hits"),
    )
    return counts.select(
        "label",
        _ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
        "support",
        "hits",
        "claimed",
    )


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, micro F1 and macro F1."""
    return metrics.agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias(
            "balanced_accuracy"
        ),
        _ratio(2 * F.sum("hits"), F.sum("claimed") + F.sum("support")).alias("micro_f1"),
        F.avg("f1").alias("macro_f1"),
    )


def calibration_bins(
    df: DataFrame,
    *,
    bins: int = ECE_BINS,
    confidence: str = "raw_confidence",
    expected: str = "label",
    predicted: str = "predicted",
) -> DataFrame:
    """Rows, accuracy and mean confidence per equal-width confidence bin."""
    if bins < 2:
        raise ValueError(f"calibration needs two bins or more, not {bins}")
    index = F.least(F.floor(F.col(confidence) * bins).cast("int"), F.lit(bins - 1))
    return df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col(expected) == F.col(predicted)).cast("double")).alias("accuracy"),
        F.avg(F.col(confidence).cast("double")).alias("confidence"),
    )


def expected_calibration_error(binned: DataFrame) -> DataFrame:
    """Row-weighted mean gap between accuracy and confidence over the bins."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return binned.agg(
        (F.sum(F.col("rows") * gap) / F.sum("rows")).alias("expected_calibration_error"),
        F.sum("rows").alias("rows"),
    )


def score_summary(df: DataFrame, score: str = "ood_score") -> DataFrame:
    """Minimum, 5/50/95/99 % quantiles, maximum and mean of a score."""
    names = {0.05: "quantile_05", 0.5: "median", 0.95: "quantile_95", 0.99: "quantile_99"}
    ends = df.agg(
        F.min(score).alias("minimum"), F.max(score).alias("maximum"), F.avg(score).alias("mean")
    ).first()
    return exact_quantiles(df, score, list(names)).agg(
        F.lit(ends["minimum"]).cast("double").alias("minimum"),
        *[
            F.max(F.when(F.col("probability") == F.lit(p), F.col("quantile"))).alias(name)
            for p, name in names.items()
        ],
        F.lit(ends["maximum"]).cast("double").alias("maximum"),
        F.lit(ends["mean"]).cast("double").alias("mean"),
    )


def flag_rates(
    df: DataFrame,
    *,
    thresholds: Sequence[float] = OOD_THRESHOLDS,
    score: str = "ood_score",
    label: str = "label",
) -> DataFrame:
    """Rows flagged at each threshold, overall (label ``all``) and per true label.

    A row is flagged when its score is at or above the threshold.
    """
    # Rows shrink to (label, highest threshold reached) before thresholds fan out.
    reached = sum(
        ((F.col(score) >= float(t)).cast("int") for t in sorted(thresholds)), F.lit(0)
    )
    counted = df.groupBy(F.col(label).cast("string").alias("label"), reached.alias("reached")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    levels = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("level"))
            for i, t in enumerate(sorted(thresholds))
        ]
    )
    return (
        counted.withColumn("t", F.explode(levels))
        .withColumn("label", F.explode(F.array(F.col("label"), F.lit("all"))))
        .groupBy(F.col("t.threshold").alias("threshold"), "label")
        .agg(
            F.sum("rows").alias("windows"),
            F.sum(F.when(F.col("reached") >= F.col("t.level"), F.col("rows")).otherwise(0)).alias(
                "flagged_windows"
            ),
        )
        .withColumn("false_positive_rate", F.col("flagged_windows") / F.col("windows"))
    )


def loss_summary(losses: DataFrame) -> DataFrame:
    """Count, first, last and lowest value of an ``episode, loss`` trace."""
    return losses.agg(
        F.count(F.lit(1)).alias("episodes_completed"),
        F.min_by("loss", "episode").alias("initial"),
        F.max_by("loss", "episode").alias("final"),
        F.min("loss").alias("minimum"),
    )


def feature_parity(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest absolute feature difference and rows missing on either side."""
    a = left.select("window_id", F.array(*[F.col(c).cast("double") for c in columns]).alias("a"))
    b = right.select("window_id", F.array(*[F.col(c).cast("double") for c in columns]).alias("b"))
    gaps = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return a.join(b, "window_id", "full").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("a").isNull()).alias("missing_left"),
        F.count_if(F.col("b").isNull()).alias("missing_right"),
        F.coalesce(F.max(gaps), F.lit(0.0)).alias("maximum_difference"),
    )
