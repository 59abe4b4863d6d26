"""Classic capture files as packet rows.

Reading goes in two steps.  The index step finds byte ranges of whole records inside
the files (``sources.ranges``).  The read step spreads the ranges over the cluster and
reads each on its own.  Both split a huge file among many tasks.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.labels import capture_labels
from flowloom.operators.validate import packet_violations
from flowloom.session import cut_lineage
from flowloom.sources.frames import SIZE_RELEASE_COMPATIBLE, decode_ipv4
from flowloom.sources.ranges import RANGE_BYTES, RECORD_HEADER, index_captures, open_file

# Bytes of ranges for one task.
TASK_BYTES = 256 * 1024 * 1024

_RECORDS = "path string, packet_number bigint, timestamp_seconds double, raw binary"


def capture_records(index: DataFrame, *, records_per_batch: int = 8192) -> DataFrame:
    """Timestamped raw records of the indexed ranges, numbered per file."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[tuple] = []
                with open_file(row["path"]) as stream:
                    stream.seek(row["start"])
                    held = stream.read(row["stop"] - row["start"])
                    header = struct.Struct(row["byte_order"] + "IIII")
                    number, place = row["first_packet"], 0
                    while place < len(held):
                        seconds, part, size, _ = header.unpack_from(held, place)
                        place += RECORD_HEADER
                        if row["ticks"] == 1_000_000:
                            at = seconds + part / 1e6
                        else:
                            # one correctly rounded division of the whole tick count
                            at = (seconds * row["ticks"] + part) / row["ticks"]
                        rows.append((row["path"], number, at, held[place : place + size]))
                        place += size
                        number += 1
                        if len(rows) == records_per_batch:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    spark = index.sparkSession
    ranges = index.where(F.col("fault").isNull())
    # Tasks follow the bytes to be read, with some work for every core.
    total = ranges.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return ranges.repartition(parts, "path", "start").mapInArrow(read, _RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, numbers, times, bodies = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(paths, pa.string()),
            pa.array(numbers, pa.int64()),
            pa.array(times, pa.float64()),
            pa.array(bodies, pa.binary()),
        ],
        names=["path", "packet_number", "timestamp_seconds", "raw"],
    )


def read_captures(
    spark: SparkSession,
    path: str,
    *,
    size_policy: str = SIZE_RELEASE_COMPATIBLE,
    range_bytes: int = RANGE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Packets of all capture files under a path, and the faults found.

    Packets carry ``capture_id`` (file name) and decode ``reason``.  Faults are
    ``rule, key, detail`` rows of files and records that cannot be read, of
    packets whose time goes back, and of file names that occur in two folders.
    The files are walked and decoded once; what follows reads the stored packets.
    """
    index = cut_lineage(index_captures(spark, path, range_bytes=range_bytes))
    decoded = decode_ipv4(capture_records(index), size_policy=size_policy)
    named = capture_labels(decoded, "path").drop(
        "label_fault", "vpn_status", "application", "category"
    )
    packets = cut_lineage(named.select(
        "capture_id",
        "packet_number",
        "timestamp_seconds",
        "source_address",
        "source_port",
        "destination_address",
        "destination_port",
        "protocol",
        "size",
        "reason",
    ))
    name = F.element_at(F.split("path", "/"), -1)
    twice = (
        index.select("path")
        .distinct()
        .groupBy(name.alias("key"))
        .agg(F.count(F.lit(1)).alias("files"))
        .where(F.col("files") > 1)
        .select(
            F.lit("capture_name_duplicate").alias("rule"),
            "key",
            F.concat(F.lit("files "), F.col("files")).alias("detail"),
        )
    )
    order = packet_violations(valid_packets(packets)).where(
        F.col("rule").isin("timestamp_regression", "timestamp_not_finite")
    )
    faults = (
        index.where(F.col("fault").isNotNull())
        .select(
            F.col("fault").alias("rule"),
            F.element_at(F.split("path", "/"), -1).alias("key"),
            F.concat(F.lit("packet "), F.col("first_packet")).alias("detail"),
        )
        .unionByName(
            packets.where(F.col("reason").isNotNull()).select(
                F.col("reason").alias("rule"),
                F.col("capture_id").alias("key"),
                F.concat(F.lit("packet "), F.col("packet_number")).alias("detail"),
            )
        )
        .unionByName(order.select("rule", "key", "detail"))
        .unionByName(twice)
    )
    return packets, faults


def valid_packets(packets: DataFrame) -> DataFrame:
    """Decoded packets without the decode reason."""
    return packets.where(F.col("reason").isNull()).drop("reason")

