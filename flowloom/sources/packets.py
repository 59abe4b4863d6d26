"""Packet rows from event tables and nested connection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.labels import capture_labels
from flowloom.functions.ordered import number_rows
from flowloom.functions.plan import computed_once
from flowloom.schemas import APPLICATIONS, RAW_CONNECTIONS

CAPTURES_IN_EVENTS = 40


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def capture_name(user: Column) -> Column:
    """Capture file name an event's user belongs to."""
    key = F.pmod(user, F.lit(CAPTURES_IN_EVENTS))
    status = F.when(F.pmod(F.floor(key / 10), F.lit(2)) == 1, F.lit("vpn")).otherwise(
        F.lit("nonvpn")
    )
    application = F.element_at(
        F.array(*[F.lit(a) for a in APPLICATIONS]), (F.pmod(key, F.lit(10)) + 1).cast("int")
    )
    return F.concat(
        status, F.lit("_"), application, F.lit("_capture"), key.cast("string"), F.lit(".pcap")
    )


def event_packets(events: DataFrame, *, numbered: bool = True) -> DataFrame:
    """Read an event table as packets between per-user clients and one server.

    ``event_id`` orders a capture's packets.  ``numbered`` replaces it by the
    dense 1-based position in the capture.
    """
    user = F.col("user_id")
    client = F.concat(
        F.lit("10.0."),
        F.floor(user / 256).cast("string"),
        F.lit("."),
        F.pmod(user, F.lit(256)).cast("string"),
    )
    client_port = (F.lit(1024) + F.pmod(user, F.lit(64511))).cast("int")
    server = F.lit("192.0.2.1")
    server_port = F.lit(443)
    forward = F.pmod(F.col("event_id"), F.lit(3)) != 1
    packets = events.select(
        capture_name(user).alias("capture_id"),
        F.col("event_id").alias("packet_number"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp_seconds"),
        F.when(forward, client).otherwise(server).alias("source_address"),
        F.when(forward, client_port).otherwise(server_port).alias("source_port"),
        F.when(forward, server).otherwise(client).alias("destination_address"),
        F.when(forward, server_port).otherwise(client_port).alias("destination_port"),
        F.when(F.pmod(user, F.lit(2)) == 0, F.lit(6)).otherwise(F.lit(17)).alias("protocol"),
        (F.lit(40) + F.floor(F.col("value") * 10).cast("bigint")).alias("size"),
    )
    if not numbered:
        return packets
    return number_rows(packets, ["capture_id"], "packet_number", "_number").withColumn(
        "packet_number", F.col("_number")
    ).drop("_number")


def read_raw_connections(spark: SparkSession, path: str) -> DataFrame:
    """Nested connection table: one row per connection with packet arrays."""
    return spark.read.schema(RAW_CONNECTIONS).parquet(path)


def connection_packets(connections: DataFrame) -> DataFrame:
    """Explode nested connections into flow-assigned packets.

    Packets are ordered by timestamp with ties in input order.  That sort is
    local to the row.  ``capture_origin`` is the earliest timestamp over all
    connections of a capture.
    """
    labeled = capture_labels(connections, "file_names")
    origins = labeled.groupBy("capture_id").agg(
        F.min(F.array_min("timestamps")).alias("capture_origin")
    )
    position = F.sequence(F.lit(0), F.size("timestamps") - 1)
    rows = F.arrays_zip(
        F.col("timestamps").alias("timestamp_seconds"),
        position.alias("position"),
        F.col("sizes").alias("size"),
        F.col("directions").alias("direction"),
    )
    nonempty = labeled.where(F.size("timestamps") > 0)
    return (
        nonempty.join(origins, "capture_id")
        .withColumn("_packets", computed_once(F.sort_array(rows)))
        .select(
            "capture_id",
            "capture_origin",
            "connection",
            F.posexplode("_packets").alias("packet_number", "p"),
        )
        .select(
            "capture_id",
            "capture_origin",
            "connection",
            F.col("packet_number").cast("bigint").alias("packet_number"),
            "p.timestamp_seconds",
            F.col("p.size").alias("size"),
            F.col("p.direction").alias("direction"),
        )
    )
