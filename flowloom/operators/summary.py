"""Dataset, window, feature and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.labels import capture_labels

LABELS = ("vpn_status", "application", "category")


def connection_counts(assigned: DataFrame) -> DataFrame:
    """Packets per connection, with the capture's labels."""
    counted = assigned.groupBy("capture_id", "flow_id").agg(F.count(F.lit(1)).alias("packets"))
    return capture_labels(counted, "capture_id")


def raw_connection_counts(connections: DataFrame) -> DataFrame:
    """Packets per nested connection row, with the capture's labels."""
    return capture_labels(connections, "file_names").select(
        "capture_id", *LABELS, F.size("timestamps").cast("bigint").alias("packets")
    )


def dataset_summary(connections: DataFrame) -> DataFrame:
    """Connections, packets, captures and packets-per-connection range and median.

    Connections are first reduced to a frequency table of packet counts, which
    an exact percentile can hold.
    """
    frequencies = connections.groupBy("packets", "capture_id").agg(
        F.count(F.lit(1)).alias("connections")
    )
    return frequencies.agg(
        F.sum("connections").alias("connections"),
        F.sum(F.col("packets") * F.col("connections")).alias("packets"),
        F.count_distinct("capture_id").alias("captures"),
        F.min("packets").alias("minimum_packets"),
        F.percentile("packets", F.lit(0.5), F.col("connections")).alias("median_packets"),
        F.max("packets").alias("maximum_packets"),
    )


def _by_label(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One pass over three groupings: each label column on its own."""
    return (
        df.groupingSets([[F.col(c)] for c in LABELS], *[F.col(c) for c in LABELS])
        .agg(*aggregates, F.grouping_id().alias("_set"))
        .withColumn(
            "label_kind",
            # bit set = column aggregated away; the kept one is the zero bit
            F.when(F.col("_set") == 3, F.lit("vpn_status"))
            .when(F.col("_set") == 5, F.lit("application"))
            .otherwise(F.lit("category")),
        )
        .withColumn("label", F.coalesce(*LABELS))
        .drop(*LABELS, "_set")
    )


def label_distributions(connections: DataFrame) -> DataFrame:
    """Captures and connections by VPN status, application and category."""
    captures = connections.groupBy("capture_id", *LABELS).agg(
        F.count(F.lit(1)).alias("connections")
    )
    return _by_label(
        captures,
        F.count(F.lit(1)).alias("captures"),
        F.sum("connections").alias("connections"),
    ).select("label_kind", "label", "captures", "connections")


def window_summary(windows: DataFrame) -> DataFrame:
    """Windows, packets and captures in total and by each label."""
    captures = windows.groupBy("capture_id", *LABELS).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("packet_count").alias("packets")
    )
    aggregates = [
        F.sum("windows").alias("windows"),
        F.sum("packets").alias("packets"),
        F.count(F.lit(1)).alias("captures"),
    ]
    by_label = _by_label(captures, *aggregates).select(
        "label_kind", "label", "windows", "packets", "captures"
    )
    # Every label kind covers all captures: one of them adds up to the total.
    total = by_label.where(F.col("label_kind") == "vpn_status").agg(
        F.lit("all").alias("label_kind"),
        F.lit("all").alias("label"),
        F.sum("windows").alias("windows"),
        F.sum("packets").alias("packets"),
        F.sum("captures").alias("captures"),
    )
    return by_label.unionByName(total)


def range_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Minimum, maximum, mean and population deviation; zeros for an empty set."""
    kept = {
        "minimum": F.min(value),
        "maximum": F.max(value),
        "mean": F.avg(value),
        "std_dev": F.stddev_pop(value),
    }
    grouped = df.groupBy(*keys) if keys else df
    return grouped.agg(
        *[F.coalesce(c, F.lit(0.0)).alias(name) for name, c in kept.items()],
        F.count(value).alias("values"),
    )


def run_summary(progress: DataFrame) -> DataFrame:
    """Rates and latencies of a run from its per-step progress log.

    ``progress`` has ``packets, events, processing_seconds, finalization`` (true
    on closing steps) and ``ended_seconds`` / ``started_seconds``.
    """
    step = ~F.col("finalization")
    totals = progress.agg(
        F.sum(F.when(step, F.col("packets")).otherwise(0)).alias("packets_processed"),
        F.sum("events").alias("events_emitted"),
        (F.max("ended_seconds") - F.min("started_seconds")).alias("elapsed_seconds"),
        F.coalesce(F.sum(F.when(step, F.col("processing_seconds"))), F.lit(0.0)).alias("busy"),
        F.coalesce(F.max(F.when(step, F.col("processing_seconds"))), F.lit(0.0)).alias("worst"),
        F.coalesce(F.sum(F.when(~step, F.col("processing_seconds"))), F.lit(0.0)).alias("closing"),
    )

    def rate(count: str) -> Column:
        return F.when(
            F.col("elapsed_seconds") > 0.0, F.col(count) / F.col("elapsed_seconds")
        ).otherwise(F.lit(0.0))

    return totals.select(
        "packets_processed",
        "events_emitted",
        "elapsed_seconds",
        rate("packets_processed").alias("packet_rate_per_second"),
        rate("events_emitted").alias("event_rate_per_second"),
        F.when(
            F.col("packets_processed") > 0, F.col("busy") / F.col("packets_processed") * 1000.0
        )
        .otherwise(F.lit(0.0))
        .alias("mean_processing_latency_ms"),
        (F.col("worst") * 1000.0).alias("max_processing_latency_ms"),
        (F.col("closing") * 1000.0).alias("finalization_latency_ms"),
        ((F.col("busy") + F.col("closing")) * 1000.0).alias("total_pipeline_processing_ms"),
    )


def frame_counters(frames: DataFrame) -> DataFrame:
    """Received, decoded, ignored and invalid frames from decode statuses."""
    return frames.agg(
        F.count(F.lit(1)).alias("frames_received"),
        F.count_if(F.col("status") == "decoded").alias("packets_decoded"),
        F.count_if(F.col("status") == "non_ipv4").alias("non_ipv4_frames"),
        F.count_if(F.col("status") == "invalid").alias("invalid_frames"),
    )


def session_counters(sessions: DataFrame, active_states: tuple[str, ...]) -> DataFrame:
    """Total and active sessions."""
    return sessions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state").isin(*active_states)).alias("active"),
    )
