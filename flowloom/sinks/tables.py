"""Versioned tables, manifests, reports, frozen state and event logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.ordered import number_rows
from flowloom.operators.splits import split_objective, split_summary
from flowloom.operators.summary import window_summary
from flowloom.operators.validate import ContractError, require_none, require_schema
from flowloom.operators.windows import RELEASE_COMPATIBLE, windows_per_capture
from flowloom.schemas import (
    ASSIGNMENTS,
    FEATURE_TABLE_VERSION,
    FEATURES,
    PARTITIONS,
    SPLIT_FRACTIONS,
    SPLIT_MANIFEST_VERSION,
    WINDOW_TABLE_VERSION,
    WINDOWS,
)
from flowloom.sources.artifacts import content_fingerprint


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def check_destination(spark: SparkSession, path: str, extension: str) -> None:
    """Refuse a wrong extension or anything already published."""
    if not path.lower().endswith(extension):
        raise ContractError(f"{path} should end in {extension}")
    for target in (path, f"{path}.manifest"):
        if _exists(spark, target):
            raise ContractError(f"{target} is there already; nothing is overwritten")


def _publish(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Write complete or not at all: the committer publishes on success only.

    A null in a required column stops the write inside the task that meets it.
    """
    required = [
        F.when(
            F.col(f.name).isNull(), F.raise_error(F.lit(f"null in required column {f.name}"))
        )
        .otherwise(F.col(f.name))
        .alias(f.name)
        if not f.nullable
        else F.col(f.name)
        for f in schema
    ]
    # Measured values hardly repeat; a dictionary of each such column is built in vain.
    plain = {
        f"parquet.enable.dictionary#{f.name}": "false"
        for f in schema
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    df.select(*required).write.mode("errorifexists").options(compression="zstd", **plain).parquet(
        path
    )


def write_manifest(payload: DataFrame, table: str, **lists: DataFrame) -> None:
    """A summary row beside a table, and each list as rows of its own."""
    folder = f"{table.rstrip('/')}.manifest"
    for name, rows in lists.items():
        rows.write.mode("errorifexists").json(f"{folder}/{name}")
    payload.coalesce(1).write.mode("errorifexists").json(f"{folder}/summary")


def _counts(summary: DataFrame, value: str = "windows") -> DataFrame:
    """Label counts as maps in one row."""
    kinds = ("vpn_status", "application", "category")
    return summary.agg(
        *[
            F.map_from_entries(
                F.array_sort(
                    F.collect_list(F.when(F.col("label_kind") == k, F.struct("label", value)))
                )
            ).alias(f"{value}_by_{k}")
            for k in kinds
        ],
        F.max(F.when(F.col("label_kind") == "all", F.col("windows"))).alias("windows"),
        F.max(F.when(F.col("label_kind") == "all", F.col("packets"))).alias("packets"),
        F.max(F.when(F.col("label_kind") == "all", F.col("captures"))).alias(
            "represented_captures"
        ),
    )


def export_windows(
    windows: DataFrame,
    captures: DataFrame,
    path: str,
    *,
    window_seconds: float,
    minimum_packets: int,
    policy: str = RELEASE_COMPATIBLE,
    source_sha256: str = "",
) -> None:
    """Publish a window table and its manifest.

    ``captures`` lists every source capture, so omitted ones are reported.
    """
    spark = windows.sparkSession
    check_destination(spark, path, ".parquet")
    require_schema(windows, WINDOWS, "windows")
    _publish(windows, path, WINDOWS)
    # Everything below reads the published table back, not the source again.
    stored = spark.read.parquet(path)
    omitted = windows_per_capture(captures, stored).where("omitted").select("capture_id")
    counted = omitted.agg(
        F.count(F.lit(1)).alias("omitted_capture_count"), F.lit(1).alias("_one")
    )
    summary = _counts(window_summary(stored)).withColumn("_one", F.lit(1)).join(counted, "_one")
    payload = summary.select(
        F.lit(WINDOW_TABLE_VERSION).alias("schema_version"),
        F.struct(F.lit(source_sha256).alias("sha256")).alias("source"),
        F.struct(
            F.lit(float(window_seconds)).alias("window_seconds"),
            F.lit(minimum_packets).alias("minimum_packets"),
            F.lit(">" if policy == RELEASE_COMPATIBLE else ">=").alias("eligibility_operator"),
            F.lit(policy).alias("threshold_policy"),
        ).alias("configuration"),
        F.struct(
            F.lit(path).alias("path"),
            F.lit("parquet").alias("format"),
            F.lit("zstd").alias("compression"),
            F.lit(content_fingerprint(spark, path)).alias("sha256"),
        ).alias("output"),
        F.struct(*[c for c in summary.columns if c != "_one"]).alias("summary"),
    )
    write_manifest(payload, path, omitted_captures=omitted)


def export_features(
    features: DataFrame, path: str, *, configuration: Mapping[str, object], source_sha256: str = ""
) -> None:
    """Publish a feature table and its manifest."""
    spark = features.sparkSession
    check_destination(spark, path, ".parquet")
    require_schema(features, FEATURES, "features")
    _publish(features, path, FEATURES)
    summary = _counts(window_summary(spark.read.parquet(path)))
    payload = summary.select(
        F.lit(FEATURE_TABLE_VERSION).alias("schema_version"),
        F.struct(F.lit(source_sha256).alias("sha256")).alias("source"),
        F.struct(*[F.lit(v).alias(k) for k, v in sorted(configuration.items())]).alias(
            "configuration"
        ),
        F.struct(
            F.lit(path).alias("path"),
            F.lit("zstd").alias("compression"),
            F.lit(content_fingerprint(spark, path)).alias("sha256"),
        ).alias("output"),
        F.struct(*summary.columns).alias("summary"),
    )
    write_manifest(payload, path)


def export_split_manifest(
    assignments: DataFrame, path: str, *, source_sha256: str, seeds: int
) -> None:
    """Publish a split manifest: a summary row, and one row per capture."""
    spark = assignments.sparkSession
    check_destination(spark, path, ".json")
    cells = split_summary(assignments)
    partitions = cells.where(F.col("label_kind") == "all").agg(
        F.sum("captures").alias("captures"),
        F.sum("windows").alias("windows"),
        F.array_sort(
            F.collect_list(F.struct("partition", "captures", "windows", "window_fraction"))
        ).alias("partitions"),
        F.lit(1).alias("_one"),
    )
    labels = cells.where(F.col("label_kind") != "all").agg(
        F.array_sort(
            F.collect_list(F.struct("partition", "label_kind", "label", "captures", "windows"))
        ).alias("labels"),
        F.lit(1).alias("_one"),
    )
    objective = split_objective(assignments).withColumn("_one", F.lit(1))
    payload = (
        partitions.join(labels, "_one")
        .join(objective, "_one")
        .select(
            F.lit(SPLIT_MANIFEST_VERSION).alias("schema_version"),
            F.struct(F.lit(source_sha256).alias("sha256")).alias("source"),
            F.struct(
                F.struct(*[F.lit(SPLIT_FRACTIONS[p]).alias(p) for p in PARTITIONS]).alias(
                    "fractions"
                ),
                F.lit(seeds).alias("seeds"),
            ).alias("configuration"),
            F.struct(
                F.col("objective").alias("objective_value"),
                F.lit(f"best of {seeds} seeds").alias("message"),
            ).alias("search"),
            F.struct("captures", "windows", "partitions", "labels").alias("summary"),
        )
    )
    folder = path.rstrip("/")
    assignments.select(*ASSIGNMENTS.names).write.mode("errorifexists").json(
        f"{folder}/assignments"
    )
    payload.coalesce(1).write.mode("errorifexists").json(f"{folder}/summary")


def write_partitioned(rows: DataFrame, path: str) -> None:
    """Feature rows laid out by role, so reading one role skips the others."""
    rows.write.mode("errorifexists").partitionBy("partition").option(
        "compression", "zstd"
    ).parquet(path)


def write_state(state: DataFrame, folder: str, name: str) -> None:
    """One frozen state table."""
    state.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row nested report as JSON."""
    check_destination(report.sparkSession, path, ".json")
    report.coalesce(1).write.mode("errorifexists").json(path)


def append_events(events: DataFrame, table: str, batch_id: int, order: str) -> None:
    """Append one batch of events, numbering each run on from the batches before.

    The last number of every run is kept in a table of its own beside the events
    (``<table>-last``), one part per batch, so no stored event is read again.  A
    batch delivered twice replaces its own parts and gives the same sequences.
    """
    spark = events.sparkSession
    states = f"{table.rstrip('/')}-last"
    numbered = number_rows(events, ["run_id"], order, "_nth")
    last = spark.createDataFrame([], "run_id string, _last bigint")
    if batch_id > 0 and _exists(spark, states):
        earlier = spark.read.parquet(states).where(F.col("batch_id") < batch_id)
        newest = earlier.agg(F.max("batch_id")).first()[0]
        if newest is not None:
            last = earlier.where(F.col("batch_id") == newest).select("run_id", "_last")
    part = f"{table.rstrip('/')}/batch_id={batch_id}"
    sequence = F.coalesce(F.col("_last"), F.lit(0)).cast("bigint") + F.col("_nth")
    numbered.join(last, "run_id", "left").withColumn("sequence", sequence).drop(
        "_nth", "_last"
    ).write.mode("overwrite").parquet(part)
    reached = (
        spark.read.parquet(part).groupBy("run_id").agg(F.max("sequence").alias("_now"))
    )
    last.join(reached, "run_id", "full").select(
        "run_id", F.coalesce("_now", "_last").alias("_last")
    ).write.mode("overwrite").parquet(f"{states}/batch_id={batch_id}")


def require_sequences(events: DataFrame) -> None:
    """Event sequences start at one."""
    bad = events.where(F.col("sequence") < 1).select(
        F.lit("sequence").alias("rule"),
        F.col("run_id").alias("key"),
        F.col("sequence").cast("string").alias("detail"),
    )
    require_none(bad, "events")
