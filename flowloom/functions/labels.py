"""Capture labels, categories and flow identity expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.schemas import APPLICATION_CATEGORY, APPLICATIONS, FLOW_ID_HEX_LENGTH


def category_of(application: Column) -> Column:
    """Category of an application name; null for an unknown one."""
    pairs = [F.lit(text) for pair in APPLICATION_CATEGORY.items() for text in pair]
    return F.element_at(F.create_map(*pairs), application)


def capture_labels(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Parse labels out of a capture file name.

    Adds ``capture_id`` (base name, case kept), ``vpn_status``, ``application``,
    ``category`` and ``label_fault``, which names the broken rule or is null.
    """
    base = F.element_at(F.split(F.col(file_name), "/"), -1)
    lowered = F.lower(base)
    matches = F.filter(
        F.array(*[F.lit(a) for a in APPLICATIONS]), lambda a: F.contains(F.col("_lowered"), a)
    )
    status = (
        F.when(F.startswith(F.col("_lowered"), F.lit("nonvpn_")), F.lit("nonvpn"))
        .when(F.startswith(F.col("_lowered"), F.lit("vpn_")), F.lit("vpn"))
    )
    fault = (
        F.when(~F.endswith(F.col("_lowered"), F.lit(".pcap")), F.lit("extension"))
        .when(F.col("_status").isNull(), F.lit("prefix"))
        .when(F.size("_matches") != 1, F.lit("application"))
    )
    return (
        df.withColumn("capture_id", base)
        .withColumn("_lowered", lowered)
        .withColumn("_status", status)
        .withColumn("_matches", matches)
        .withColumn("label_fault", fault)
        .withColumn("vpn_status", F.when(F.col("label_fault").isNull(), F.col("_status")))
        .withColumn(
            "application", F.when(F.col("label_fault").isNull(), F.element_at("_matches", 1))
        )
        .withColumn("category", category_of(F.col("application")))
        .drop("_lowered", "_status", "_matches")
    )


def reverse_connection(connection: str) -> Column:
    """The same five-tuple seen from the other end."""
    c = F.col(connection)
    return F.struct(
        c["dst"].alias("src"),
        c["dport"].alias("sport"),
        c["src"].alias("dst"),
        c["sport"].alias("dport"),
        c["proto"].alias("proto"),
    )


def flow_id(capture: str, connection: str) -> Column:
    """First hex digits of SHA-256 over the NUL-joined capture and five-tuple."""
    c = F.col(connection)
    text = F.concat_ws(
        "\0",
        F.col(capture),
        c["src"],
        c["sport"].cast("string"),
        c["dst"],
        c["dport"].cast("string"),
        c["proto"].cast("string"),
    )
    return F.substring(F.sha2(text, 256), 1, FLOW_ID_HEX_LENGTH)


def window_id() -> Column:
    """``capture:flow:index`` of the current row."""
    return F.concat_ws(":", "capture_id", "flow_id", F.col("window_index").cast("string"))


def fingerprint(sha: Column) -> Column:
    """Short form of a model hash for display."""
    return F.coalesce(F.substring(sha, 1, 12), F.lit("unavailable"))
