"""Validation as data: every rule set yields ``rule, key, detail`` rows.

An empty result means the input keeps the contract; :func:`require_none` turns
a non-empty one into an error.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.labels import capture_labels, category_of
from flowloom.functions.ordered import previous_value
from flowloom.operators.windows import WINDOW_KEY
from flowloom.schemas import (
    APPLICATIONS,
    CATEGORIES,
    CHUNK_ROWS,
    EMBEDDING_DIMENSION,
    FEATURE_COLUMNS,
    VPN_STATUSES,
)


class ContractError(ValueError):
    """Raised when data breaks a contract."""


def require_none(violations: DataFrame, what: str) -> None:
    """Raise when there is any violation, naming a few of them."""
    found = violations.limit(5).collect()
    if found:
        shown = "; ".join(f"{r['rule']} [{r['key']}] {r['detail']}" for r in found)
        raise ContractError(f"{what}: {shown}")


def require_schema(df: DataFrame, expected: T.StructType, what: str) -> None:
    """Names, order and types must equal the expected schema."""
    actual = [(f.name, f.dataType.simpleString()) for f in df.schema]
    wanted = [(f.name, f.dataType.simpleString()) for f in expected]
    if actual != wanted:
        raise ContractError(f"{what}: schema differs, got {actual}")


def broken_rules(
    df: DataFrame, key: Column, rules: Mapping[str, Column], detail: Column | None = None
) -> DataFrame:
    """One row per broken row-level rule; a null condition counts as kept."""
    fired = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]))
    return df.select(
        key.cast("string").alias("key"),
        (F.lit("") if detail is None else detail.cast("string")).alias("detail"),
        fired.alias("_rules"),
    ).select(F.explode("_rules").alias("rule"), "key", "detail")


def _not_finite(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def _bad_port(value: Column) -> Column:
    return value.isNull() | ~value.between(0, 65_535)


def raw_connection_violations(connections: DataFrame) -> DataFrame:
    """Nested connections: five-tuple ranges, aligned arrays, labels, no duplicates."""
    c = F.col("connection")
    lengths = [F.coalesce(F.size(n), F.lit(-1)) for n in ("timestamps", "sizes", "directions")]
    labeled = capture_labels(connections, "file_names")
    rules = {
        "connection_address": c["src"].isNull() | c["dst"].isNull(),
        "connection_port": _bad_port(c["sport"]) | _bad_port(c["dport"]),
        "connection_protocol": c["proto"].isNull() | ~c["proto"].between(0, 255),
        "array_length": (lengths[0] != lengths[1]) | (lengths[0] != lengths[2]),
        "array_empty": lengths[0] < 1,
        "timestamp_not_finite": F.exists("timestamps", _not_finite),
        "size_negative": F.exists("sizes", lambda s: s.isNull() | (s < 0)),
        "direction_value": F.exists("directions", lambda d: d.isNull() | ~d.isin(0, 1)),
        "file_name": F.col("label_fault").isNotNull() | F.col("file_names").isNull(),
    }
    key = F.concat_ws("|", F.col("file_names"), F.to_json("connection"))
    duplicates = (
        labeled.groupBy("capture_id", "connection")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
        .select(
            F.lit("connection_duplicate").alias("rule"),
            F.concat_ws("|", F.col("capture_id"), F.to_json("connection")).alias("key"),
            F.col("rows").cast("string").alias("detail"),
        )
    )
    return broken_rules(labeled, key, rules).unionByName(duplicates)


def _packet_rules(packets: DataFrame, chunk_rows: int) -> tuple[DataFrame, dict[str, Column]]:
    at = F.col("timestamp_seconds")
    ordered = previous_value(
        packets,
        ["capture_id"],
        "packet_number",
        "timestamp_seconds",
        "_before",
        chunk_rows=chunk_rows,
    )
    rules = {
        "address_missing": F.col("source_address").isNull()
        | F.col("destination_address").isNull(),
        "port_range": _bad_port(F.col("source_port")) | _bad_port(F.col("destination_port")),
        "protocol_range": F.col("protocol").isNull() | ~F.col("protocol").between(0, 255),
        "size_not_positive": F.col("size").isNull() | (F.col("size") <= 0),
        "timestamp_not_finite": _not_finite(at),
        "timestamp_regression": at < F.col("_before"),
    }
    return ordered, rules


def packet_violations(packets: DataFrame, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Packets: field ranges, positive sizes, finite nondecreasing timestamps.

    The timestamp is compared with the one before it in the capture; the
    comparison runs in bounded chunks, so a hot capture spreads over tasks.
    Packets without a capture or number are reported by a rule of their own.
    """
    placed = F.col("capture_id").isNotNull() & F.col("packet_number").isNotNull()
    key = F.concat_ws(":", F.col("capture_id"), F.col("packet_number").cast("string"))
    lost = broken_rules(packets.where(~placed), key, {"packet_key_missing": F.lit(True)})
    ordered, rules = _packet_rules(packets.where(placed), chunk_rows)
    return broken_rules(ordered, key, rules).unionByName(lost)


def sound_packets(
    packets: DataFrame, *, chunk_rows: int = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Packets that break no rule, and the violations of the others.

    Run it before windows and features: no bad packet is repaired, moved or
    dropped without a violation row.
    """
    placed = packets.where(F.col("capture_id").isNotNull() & F.col("packet_number").isNotNull())
    ordered, rules = _packet_rules(placed, chunk_rows)
    broken = F.lit(False)
    for condition in rules.values():
        broken = broken | F.coalesce(condition, F.lit(False))
    sound = ordered.where(~broken).select(*packets.columns)
    return sound, packet_violations(packets, chunk_rows=chunk_rows)


def feature_input_violations(
    packets: DataFrame, window_seconds: float, *, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Window packets: keys, offsets inside the window and in order, sizes, directions."""
    at = F.col("offset_seconds")
    ordered = previous_value(
        packets, WINDOW_KEY, "packet_number", "offset_seconds", "_before", chunk_rows=chunk_rows
    )
    rules = {
        "offset_not_finite": _not_finite(at),
        "offset_outside_window": (at < 0.0) | (at >= float(window_seconds)),
        "offset_regression": at < F.col("_before"),
        "size_negative": F.col("size").isNull() | (F.col("size") < 0),
        "direction_value": F.col("direction").isNull() | ~F.col("direction").isin(0, 1),
    }
    key = F.concat_ws(":", F.col("capture_id"), F.col("flow_id"), F.col("window_index"))
    rows = broken_rules(ordered, key, rules, F.col("packet_number"))
    unplaced = F.lit(False)
    for name in (*WINDOW_KEY, "packet_number"):
        unplaced = unplaced | F.col(name).isNull()
    rows = rows.unionByName(
        broken_rules(
            packets.where(unplaced), key, {"window_key_missing": F.lit(True)}, F.col("packet_number")
        )
    )
    silent = (
        packets.groupBy(*WINDOW_KEY)
        .agg(F.sum("size").alias("bytes"))
        .where(F.coalesce("bytes", F.lit(0)) <= 0)
        .select(
            F.lit("window_without_bytes").alias("rule"),
            key.alias("key"),
            F.col("bytes").cast("string").alias("detail"),
        )
    )
    return rows.unionByName(silent)


def window_violations(windows: DataFrame) -> DataFrame:
    """Stored windows: array lengths agree with each other and with packet_count."""
    lengths = [F.size(n) for n in ("timestamps", "sizes", "directions")]
    return broken_rules(
        windows,
        F.col("window_id"),
        {
            "array_length": (lengths[0] != lengths[1]) | (lengths[0] != lengths[2]),
            "packet_count": lengths[0] != F.col("packet_count"),
        },
        F.concat_ws("<>", lengths[0], F.col("packet_count")),
    )


def feature_violations(features: DataFrame) -> DataFrame:
    """Feature rows: every value finite, labels known and constant per capture."""
    bad = F.filter(
        F.array(*[F.when(_not_finite(F.col(n)), F.lit(n)) for n in FEATURE_COLUMNS]),
        lambda n: n.isNotNull(),
    )
    finite = broken_rules(
        features.withColumn("_bad", bad),
        F.col("window_id"),
        {"feature_not_finite": F.size("_bad") > 0},
        F.concat_ws(",", "_bad"),
    )
    return finite.unionByName(label_violations(features))


def label_violations(rows: DataFrame) -> DataFrame:
    """Labels of captured rows: known values, and the same in a whole capture."""
    labels = ("vpn_status", "application", "category")
    known = {"vpn_status": VPN_STATUSES, "application": APPLICATIONS, "category": CATEGORIES}
    seen = rows.groupBy("capture_id").agg(
        *[F.min(c).alias(f"{c}_low") for c in labels],
        *[F.max(c).alias(f"{c}_high") for c in labels],
    )
    rules: dict[str, Column] = {}
    for c in labels:
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        rules[f"{c}_inconsistent"] = low != high
        rules[f"{c}_unknown"] = low.isNull() | ~low.isin(*known[c]) | ~high.isin(*known[c])
    return broken_rules(seen, F.col("capture_id"), rules)


def capture_group_violations(groups: DataFrame) -> DataFrame:
    """Capture groups: unique non-empty ids, windows, application fits category."""
    rules = {
        "capture_id_empty": F.col("capture_id").isNull() | (F.col("capture_id") == ""),
        "windows_not_positive": F.col("windows").isNull() | (F.col("windows") < 1),
        "category_mismatch": ~F.col("category").eqNullSafe(category_of(F.col("application"))),
    }
    twice = (
        groups.groupBy("capture_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
        .select(
            F.lit("capture_id_duplicate").alias("rule"),
            F.col("capture_id").alias("key"),
            F.col("rows").cast("string").alias("detail"),
        )
    )
    return broken_rules(groups, F.col("capture_id"), rules).unionByName(twice)


def partition_violations(
    rows: DataFrame, partition: str, *, dimension: int, vector: str = "features"
) -> DataFrame:
    """A modeling partition: right role, full finite vectors, every category present."""
    spark = rows.sparkSession
    rules = {
        "partition_role": ~F.col("partition").eqNullSafe(F.lit(partition)),
        "vector_length": F.col(vector).isNull() | (F.size(vector) != dimension),
        "vector_not_finite": F.exists(vector, _not_finite),
        "capture_id_empty": F.col("capture_id").isNull() | (F.col("capture_id") == ""),
        "category_unknown": F.col("category").isNull() | ~F.col("category").isin(*CATEGORIES),
    }
    wanted = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    missing = wanted.join(rows.select("category").distinct(), "category", "left_anti").select(
        F.lit("category_missing").alias("rule"),
        F.col("category").alias("key"),
        F.lit(partition).alias("detail"),
    )
    return broken_rules(rows, F.col("capture_id"), rules).unionByName(missing)


def state_violations(
    statistics: DataFrame,
    scaler: DataFrame,
    *,
    maximum_support: int,
    dimension: int = EMBEDDING_DIMENSION,
) -> DataFrame:
    """Frozen model state: shapes, finite values, positive scale, support counts."""
    per_class = broken_rules(
        statistics,
        F.col("label"),
        {
            "mean_shape": F.size("mean") != dimension,
            "variance_shape": F.size("variance") != dimension,
            "mean_not_finite": F.exists("mean", _not_finite),
            "variance_negative": F.exists("variance", lambda v: _not_finite(v) | (v < 0)),
            "support_count": ~F.col("n").between(2, maximum_support),
        },
    )
    scaling = broken_rules(
        scaler,
        F.lit("scaler"),
        {
            "scaler_shape": F.size("mean") != F.size("scale"),
            "scaler_mean_not_finite": F.exists("mean", _not_finite),
            "scaler_scale": F.exists("scale", lambda v: _not_finite(v) | (v <= 0)),
        },
    )
    return per_class.unionByName(scaling)


def geometry_violations(covariance: DataFrame) -> DataFrame:
    """Covariance cells ``label, i, j, covariance``: symmetric, diagonal not negative."""
    mirrored = covariance.select(
        "label",
        F.col("i").alias("j"),
        F.col("j").alias("i"),
        F.col("covariance").alias("mirror"),
    )
    cells = covariance.join(mirrored, ["label", "i", "j"], "left")
    return broken_rules(
        cells,
        F.concat_ws(":", "label", F.col("i"), F.col("j")),
        {
            "not_finite": _not_finite(F.col("covariance")),
            "not_symmetric": ~F.col("covariance").eqNullSafe(F.col("mirror")),
            "diagonal_negative": (F.col("i") == F.col("j")) & (F.col("covariance") < 0),
        },
    )


def density_violations(densities: DataFrame, calibration_rows: DataFrame) -> DataFrame:
    """Stored densities: bandwidth reproduces and counts cover the calibration rows."""
    expected = F.col("deviation") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    rows = broken_rules(
        densities,
        F.col("label"),
        {
            "sample_count": F.col("n") < 2,
            "bandwidth": _not_finite(F.col("bandwidth")) | (F.col("bandwidth") <= 0),
            "bandwidth_not_reproduced": F.abs(F.col("bandwidth") - expected)
            > 1e-8 + 1e-5 * F.abs(expected),
        },
    )
    counted = calibration_rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    off = (
        densities.select("label", "n")
        .join(counted, "label", "full")
        .where(~F.col("n").eqNullSafe(F.col("rows")))
        .select(
            F.lit("count_total").alias("rule"),
            F.col("label").cast("string").alias("key"),
            F.concat_ws("<>", F.col("n"), F.col("rows")).alias("detail"),
        )
    )
    return rows.unionByName(off)


def binding_violations(model: DataFrame, calibration: DataFrame) -> DataFrame:
    """One-row provenance tables of model and calibration must name the same inputs."""
    m = model.select(F.struct("model_sha256", "feature_sha256", "split_sha256").alias("m"))
    c = calibration.select(F.struct("model_sha256", "feature_sha256", "split_sha256").alias("c"))
    paired = m.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one")
    return broken_rules(
        paired,
        F.lit("binding"),
        {
            name: ~F.col(f"m.{name}").eqNullSafe(F.col(f"c.{name}"))
            for name in ("model_sha256", "feature_sha256", "split_sha256")
        },
    )


def support_violations(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Stored class statistics must reproduce from the support rows."""

    def far(left: str, right: str) -> Column:
        return F.exists(
            F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b")),
            lambda p: F.coalesce(
                F.abs(p["a"] - p["b"]) > 1e-8 + 1e-5 * F.abs(p["b"]), F.lit(True)
            ),
        )

    paired = rebuilt.select("label", "n", "mean", "variance").join(
        stored.select(
            "label",
            F.col("n").alias("stored_n"),
            F.col("mean").alias("stored_mean"),
            F.col("variance").alias("stored_variance"),
        ),
        "label",
        "full",
    )
    return broken_rules(
        paired,
        F.col("label"),
        {
            "support_count": ~F.col("n").eqNullSafe(F.col("stored_n")),
            "mean": far("mean", "stored_mean"),
            "variance": far("variance", "stored_variance"),
        },
    )
