"""Newline-delimited JSON packet messages, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.plan import computed_once
from flowloom.schemas import SENSOR_MESSAGE_VERSION

_FIELDS = (
    "timestamp_seconds",
    "source_address",
    "source_port",
    "destination_address",
    "destination_port",
    "protocol",
    "size",
)
_PACKET = (
    "timestamp_seconds double, source_address string, source_port bigint, "
    "destination_address string, destination_port bigint, protocol bigint, size bigint"
)
_MESSAGE = (
    "schema_version string, type string, interface string, code string, message string, "
    f"packet struct<{_PACKET.replace(' ', ':').replace(',:', ',')}>, _corrupt string"
)
# The exact keys of each message type.
_KEYS = {
    "packet": ("packet", "schema_version", "type"),
    "start": ("interface", "schema_version", "type"),
    "ready": ("interface", "schema_version", "type"),
    "error": ("code", "message", "schema_version", "type"),
}
_INTEGERS = ("source_port", "destination_port", "protocol", "size")


def stream_lines(spark: SparkSession, folder: str, *, files_per_trigger: int = 16) -> DataFrame:
    """Text lines of a growing folder as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def _keys(text: Column) -> Column:
    return F.array_sort(F.json_object_keys(text))


def parse_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse and check messages; ``fault`` is null for a valid one.

    Keys must match the message type exactly, numbers must be numbers and in
    range.  All other columns of ``lines`` pass through.
    """
    text = F.col(value)
    parsed = F.from_json(
        text, _MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    p = F.col("_m.packet")
    # Every JSON scan of the text happens once, in its own column.
    scanned = (
        lines.withColumns(
            {"_m": parsed, "_keys": _keys(text), "_packet": F.get_json_object(text, "$.packet")}
        )
        .withColumn("_packet_keys", _keys(F.col("_packet")))
    )

    def out_of_range(field: str, low: int, high: int | None) -> Column:
        bad = p[field] < low
        return bad if high is None else bad | (p[field] > high)

    def exactly(names: tuple[str, ...], keys: str) -> Column:
        return F.coalesce(
            F.col(keys) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False)
        )

    # An integer written as 1.0 or "1" does not fit its type and reads as null.
    not_integer = F.lit(False)
    for field in _INTEGERS:
        not_integer = not_integer | p[field].isNull()
    keys = F.lit(False)
    for kind, names in _KEYS.items():
        keys = keys | ((F.col("_m.type") == kind) & exactly(names, "_keys"))
    is_packet = F.col("_m.type") == "packet"
    at = p["timestamp_seconds"]
    fault = (
        F.when(F.col("_keys").isNull() | F.col("_m").isNull(), F.lit("json"))
        .when(
            ~F.col("_m.schema_version").eqNullSafe(F.lit(SENSOR_MESSAGE_VERSION)),
            F.lit("schema_version"),
        )
        .when(F.col("_m.type").isNull() | ~F.col("_m.type").isin(*_KEYS), F.lit("type"))
        .when(~keys, F.lit("fields"))
        .when(is_packet & ~exactly(_FIELDS, "_packet_keys"), F.lit("packet_fields"))
        .when(
            is_packet & (at.isNull() | F.isnan(at) | (F.abs(at) == float("inf"))),
            F.lit("timestamp"),
        )
        .when(
            is_packet
            & (
                F.coalesce(p["source_address"], F.lit("")).eqNullSafe(F.lit(""))
                | F.coalesce(p["destination_address"], F.lit("")).eqNullSafe(F.lit(""))
            ),
            F.lit("address"),
        )
        .when(is_packet & not_integer, F.lit("integer"))
        .when(
            is_packet
            & (
                out_of_range("source_port", 0, 65_535)
                | out_of_range("destination_port", 0, 65_535)
            ),
            F.lit("port"),
        )
        .when(is_packet & out_of_range("protocol", 0, 255), F.lit("protocol"))
        .when(is_packet & out_of_range("size", 1, None), F.lit("size"))
        .when(
            F.col("_m.type").isin("start", "ready")
            & (F.trim(F.coalesce("_m.interface", F.lit(""))) == ""),
            F.lit("interface"),
        )
        # Whatever else did not fit the declared types.
        .when(F.col("_m._corrupt").isNotNull(), F.lit("value_type"))
    )
    return scanned.withColumn("fault", computed_once(fault)).drop("_keys", "_packet", "_packet_keys")


def packet_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """Packet fields of the valid packet messages."""
    rows = parse_messages(lines, value).where(
        F.col("fault").isNull() & (F.col("_m.type") == "packet")
    )
    passed = [c for c in lines.columns if c != value]
    integers = {"source_port", "destination_port", "protocol"}
    return rows.select(
        *passed,
        *[
            (F.col(f"_m.packet.{f}").cast("int") if f in integers else F.col(f"_m.packet.{f}")).alias(f)
            for f in _FIELDS
        ],
    )


def dead_letters(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rejected messages with the reason."""
    return parse_messages(lines, value).where(F.col("fault").isNotNull()).drop("_m")


def packet_message(packet_columns: tuple[str, ...] = _FIELDS) -> Column:
    """Message text of a packet row, keys in sorted order."""
    return F.to_json(
        F.struct(
            F.struct(*[F.col(c) for c in sorted(packet_columns)]).alias("packet"),
            F.lit(SENSOR_MESSAGE_VERSION).alias("schema_version"),
            F.lit("packet").alias("type"),
        )
    )
