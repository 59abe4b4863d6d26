"""Window counts by event time: append mode, bounded state, late packets kept.

A window is over when the watermark (the latest packet of earlier triggers less the
allowed delay) has passed its end.  Spark drops late rows inside its stateful
operators without a trace, so a gate in front of them compares each packet's window
with the watermark of the running trigger and marks late packets as faults.  Marked
packets get a time of their own, just past the watermark, so they pass the operators
behind the gate and come out with the rows of the next trigger; the others carry
their window's end.  Packets that come again within the delay are dropped by packet
number, and the totals are an aggregation in append mode: a window's row comes out
once, when it is over, and its state is then gone.

The gate keeps no state.  It deals packets by a hash of capture and packet number,
so a hot capture or flow is spread over all tasks, and the aggregation combines a
task's packets before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowloom.operators.flows import with_flow_key
from flowloom.operators.windows import check_window

LATE = "late_packet"
_SHARDS = 256
_GATED = (
    "capture_id string, packet_number bigint, low_address string, low_port int, "
    "high_address string, high_port int, proto int, window_index bigint, size bigint, "
    "up_size bigint, timestamp_seconds double, settles timestamp, fault string"
)
_GATED_NAMES = [part.split()[0] for part in _GATED.split(", ")]
_KEYS = [
    "capture_id", "low_address", "low_port", "high_address", "high_port", "proto", "window_index",
    "settles", "fault", "late_packet_number",
]
_TOTALS = (
    "packet_count bigint, bytes bigint, low_to_high_bytes bigint, first_seconds double, "
    "last_seconds double"
)


class LateGate(StatefulProcessor):
    """Marks the packets whose window the watermark has passed; keeps no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Nothing is kept."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = pd.Timestamp(max(timerValues.getCurrentWatermarkInMs(), 0), unit="ms")
        for frame in rows:
            late = frame["settles"] <= passed
            marked = frame.assign(
                settles=frame["settles"].mask(late, passed + pd.Timedelta(milliseconds=1)),
                fault=late.map({True: LATE, False: None}).astype(object),
            )
            yield marked[_GATED_NAMES]

    def close(self) -> None:
        """Nothing to release."""


def _window_end(index: Column, origin: Column, width: Column) -> Column:
    """End of a window, at whole milliseconds as watermarks are."""
    seconds = origin + (index + 1) * width
    return F.timestamp_millis(F.ceil(seconds * 1000).cast("bigint"))


def gated_packets(packets: DataFrame, *, window_seconds: float, delay: str) -> DataFrame:
    """Packets with their window; the late ones carry a fault."""
    check_window(window_seconds)
    width = F.lit(float(window_seconds))
    index = F.floor((F.col("timestamp_seconds") - F.col("capture_origin")) / width)
    up = F.col("low_to_high")
    timed = (
        with_flow_key(packets)
        .select(
            "capture_id",
            "packet_number",
            F.col("flow_key.low.address").alias("low_address"),
            F.col("flow_key.low.port").alias("low_port"),
            F.col("flow_key.high.address").alias("high_address"),
            F.col("flow_key.high.port").alias("high_port"),
            F.col("flow_key.proto").alias("proto"),
            index.cast("bigint").alias("window_index"),
            "size",
            F.when(up, F.col("size")).otherwise(F.lit(0)).cast("bigint").alias("up_size"),
            "timestamp_seconds",
            _window_end(index, F.col("capture_origin"), width).alias("settles"),
            F.timestamp_seconds("timestamp_seconds").alias("event_time"),
        )
        .withWatermark("event_time", delay)
        # Spark drops late rows before it calls the gate only where they have this column.
        .drop("event_time")
        .withColumn("shard", F.pmod(F.xxhash64("capture_id", "packet_number"), F.lit(_SHARDS)))
    )
    return timed.groupBy("shard").transformWithStateInPandas(
        LateGate(), _GATED, "append", "eventTime", eventTimeColumnName="settles"
    )


def settled_counts(packets: DataFrame, *, window_seconds: float, delay: str) -> DataFrame:
    """Totals per flow key and window once the window is over, and late packets.

    ``packets`` carries ``capture_origin``; ``delay`` is how far a packet may lag
    behind the latest one, such as ``"10 minutes"``.  A row with a ``fault`` is one
    late packet and counted nowhere.  Windows the watermark has not passed stay in the
    state, where :func:`open_counts` reads them.
    """
    gated = gated_packets(packets, window_seconds=window_seconds, delay=delay)
    once = gated.dropDuplicatesWithinWatermark(["capture_id", "packet_number", "fault"])
    late = F.when(F.col("fault").isNotNull(), F.col("packet_number"))
    return (
        once.withColumn("late_packet_number", late)
        .groupBy(*_KEYS)
        .agg(
            F.count(F.lit(1)).alias("packet_count"),
            F.sum("size").alias("bytes"),
            F.sum("up_size").alias("low_to_high_bytes"),
            F.min("timestamp_seconds").alias("first_seconds"),
            F.max("timestamp_seconds").alias("last_seconds"),
        )
        .drop("settles")
    )


def open_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Totals of windows not over when a stream ended, read from its state."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    # Names of the stored totals repeat; the cast goes by position.
    totals = F.col("value").cast(f"struct<{_TOTALS.replace(' ', ':').replace(',:', ',')}>")
    return state.select("key.*", totals.alias("value")).select(
        *(name for name in _KEYS if name != "settles"), "value.*"
    )
