"""Published tables read back under contract: schema, version, checksum, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.splits import join_partitions, partition_faults
from flowloom.operators.validate import (
    ContractError,
    capture_group_violations,
    feature_violations,
    require_none,
    require_schema,
)
from flowloom.schemas import (
    ASSIGNMENTS,
    FEATURE_COLUMNS,
    FEATURE_TABLE_VERSION,
    FEATURES,
    PARTITIONS,
    SPLIT_MANIFEST_VERSION,
    WINDOW_TABLE_VERSION,
    WINDOWS,
)
from flowloom.sources.content import content_ranges, content_tree, tree_root


def content_fingerprint(spark: SparkSession, path: str, pattern: str = "part-*") -> str:
    """Root of the hash tree over a table's part files, in hexadecimal."""
    root = tree_root(content_tree(content_ranges(spark, path, pattern)))
    if root is None:
        raise ContractError(f"no part files under {path}")
    return root


def require_fingerprint(spark: SparkSession, path: str, expected: str) -> str:
    """Refuse a table whose content is not the expected one."""
    actual = content_fingerprint(spark, path)
    if actual != expected.lower():
        raise ContractError(f"SHA-256 mismatch for {path}: expected {expected}, got {actual}")
    return actual


def read_manifest(spark: SparkSession, table: str) -> DataFrame:
    """The one-row manifest written beside a table."""
    return spark.read.json(f"{table.rstrip('/')}.manifest/summary")


def _read_versioned(
    spark: SparkSession, path: str, schema: T.StructType, version: str, verify: bool
) -> DataFrame:
    """A published table whose schema, version and content its manifest confirms."""
    # The stored schema is checked first: reading with ours would hide a
    # different one behind nulls.
    require_schema(spark.read.parquet(path), schema, path)
    stated = read_manifest(spark, path).select("schema_version", "output.sha256").first()
    if stated["schema_version"] != version:
        raise ContractError(f"{path}: version {stated['schema_version']!r}, expected {version!r}")
    if verify:
        require_fingerprint(spark, path, stated["sha256"])
    return spark.read.parquet(path)


def read_windows(spark: SparkSession, path: str, *, verify: bool = True) -> DataFrame:
    """Window table with the exact schema, version and, unless told not to, content."""
    return _read_versioned(spark, path, WINDOWS, WINDOW_TABLE_VERSION, verify)


def read_features(spark: SparkSession, path: str, *, verify: bool = True) -> DataFrame:
    """Feature table with the exact schema, version and, unless told not to, content."""
    return _read_versioned(spark, path, FEATURES, FEATURE_TABLE_VERSION, verify)


def read_feature_labels(spark: SparkSession, path: str) -> DataFrame:
    """Only the label columns of a feature table; the scan reads nothing else."""
    return read_features(spark, path, verify=False).select(
        "capture_id", "vpn_status", "application", "category"
    )


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Assignments of a split manifest after its contract checks."""
    folder = path.rstrip("/")
    head = (
        spark.read.json(f"{folder}/summary")
        .select("schema_version", "summary.captures", "summary.windows")
        .first()
    )
    if head["schema_version"] != SPLIT_MANIFEST_VERSION:
        raise ContractError(f"unsupported split manifest version {head['schema_version']!r}")
    assignments = spark.read.schema(ASSIGNMENTS).json(f"{folder}/assignments")
    require_none(capture_group_violations(assignments), "split manifest")
    totals = assignments.agg(
        F.count(F.lit(1)).alias("captures"),
        F.sum("windows").alias("windows"),
        F.array_sort(F.collect_set("partition")).alias("partitions"),
    ).first()
    if (totals["captures"], totals["windows"]) != (head["captures"], head["windows"]):
        raise ContractError("the summary of the split disagrees with its assignments")
    if totals["partitions"] != sorted(PARTITIONS):
        raise ContractError(f"partitions without captures; found {totals['partitions']}")
    return assignments


def load_partitioned_features(
    spark: SparkSession, features_path: str, manifest_path: str
) -> DataFrame:
    """Feature rows with their partition and one feature array, fully checked."""
    features = read_features(spark, features_path)
    assignments = read_split_manifest(spark, manifest_path)
    require_none(feature_violations(features), "feature rows")
    require_none(partition_faults(features, assignments), "partitioned features")
    return join_partitions(features, assignments).select(
        "window_id",
        "capture_id",
        "vpn_status",
        "application",
        "category",
        "partition",
        F.array(*FEATURE_COLUMNS).alias("features"),
    )


def read_state(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One frozen state table (class statistics, scaler, covariance, densities)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")
