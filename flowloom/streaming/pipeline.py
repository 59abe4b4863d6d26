"""Streaming flow windows, counters and prediction events.

:func:`stream_windows` keeps one state per flow: the flow's orientation and the
totals of its open window.  Packets are combined per task, flow and window
before they are shuffled, so a flow holding a third of the stream reaches its
state as one row per task and window.  That is exact because a flow may not be
forgotten inside a window: no session can break between two packets of the same
window, and the orientation of a session is that of its lowest packet number.

Sources, scorers and event handlers are arguments: any streaming DataFrame of
the packet schema, any function from feature rows to prediction rows, any
``foreachBatch`` function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowloom.operators.flows import with_flow_key
from flowloom.operators.windows import check_window
from flowloom.sinks.tables import append_events

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

KEYS = ["capture_id", "low_address", "low_port", "high_address", "high_port", "proto"]
KEY_TYPES = (
    "capture_id string, low_address string, low_port int, high_address string, high_port int, "
    "proto int"
)
TOTALS = (
    "window_index bigint, packets bigint, up_packets bigint, bytes bigint, up_bytes bigint, "
    "first_packet bigint, last_packet bigint, first_seconds double, last_seconds double, "
    "opens_up boolean"
)
TOTAL_NAMES = [part.strip().split(" ")[0] for part in TOTALS.split(",")]
# Orientation of the session, its number, and the window it is in.
_OPEN_STATE = f"session bigint, session_up boolean, {TOTALS}"
_WINDOW_ROWS = f"{KEY_TYPES}, session bigint, session_up boolean, {TOTALS}, fault string"
_WINDOW_ROW = Row(*(part.strip().split(" ")[0] for part in _WINDOW_ROWS.split(",")))

# Combined rows a task holds before it passes them on.
_HELD_ROWS = 50_000


def check_stale(stale_after_seconds: float | None, window_seconds: float) -> None:
    """A flow may not be forgotten inside one of its windows."""
    check_window(window_seconds)
    if stale_after_seconds is not None and stale_after_seconds < window_seconds:
        raise ValueError(f"flows would go stale inside a window of {window_seconds} seconds")


_MERGES = [
    ("packets", "sum"),
    ("up_packets", "sum"),
    ("bytes", "sum"),
    ("up_bytes", "sum"),
    ("first_packet", "min"),
    ("last_packet", "max"),
    ("first_seconds", "min"),
    ("last_seconds", "max"),
    ("opens_up", "first"),
]


def _merge(parts: pa.Table) -> pa.Table:
    """One row per flow and window from rows of partial totals, in their schema."""
    ordered = parts.sort_by("first_packet")
    merged = ordered.group_by([*KEYS, "window_index"], use_threads=False).aggregate(_MERGES)
    merged = merged.select([*KEYS, "window_index", *(f"{name}_{how}" for name, how in _MERGES)])
    # Aggregates may be null by their own schema; only tables of one schema can be put together.
    return pa.Table.from_arrays(merged.columns, schema=parts.schema)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the rows of many batches at once; what is held stays bounded."""
    waiting: list[pa.Table] = []
    rows = 0
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= 4 * _HELD_ROWS:
            merged = _merge(pa.concat_tables(waiting))
            waiting, rows = [merged], merged.num_rows
            if rows >= _HELD_ROWS:
                yield from merged.to_batches()
                waiting, rows = [], 0
    if waiting:
        yield from _merge(pa.concat_tables(waiting)).to_batches()


def combine_packets(packets: DataFrame, window_seconds: float) -> DataFrame:
    """Totals per task, flow and window; stateless, so it runs before the shuffle."""
    width = F.lit(float(window_seconds))
    index = F.floor((F.col("timestamp_seconds") - F.col("capture_origin")) / width)
    up = F.col("low_to_high")
    single = with_flow_key(packets).select(
        "capture_id",
        F.col("flow_key.low.address").alias("low_address"),
        F.col("flow_key.low.port").alias("low_port"),
        F.col("flow_key.high.address").alias("high_address"),
        F.col("flow_key.high.port").alias("high_port"),
        F.col("flow_key.proto").alias("proto"),
        index.cast("bigint").alias("window_index"),
        F.lit(1).cast("bigint").alias("packets"),
        up.cast("bigint").alias("up_packets"),
        F.col("size").alias("bytes"),
        (up.cast("bigint") * F.col("size")).alias("up_bytes"),
        F.col("packet_number").alias("first_packet"),
        F.col("packet_number").alias("last_packet"),
        F.col("timestamp_seconds").alias("first_seconds"),
        F.col("timestamp_seconds").alias("last_seconds"),
        up.alias("opens_up"),
    )
    return single.mapInArrow(_combine, f"{KEY_TYPES}, {TOTALS}")


def joined(left: tuple, right: tuple) -> tuple:
    """Totals of the same window put together."""
    opening = left if left[5] <= right[5] else right
    return (
        left[0],
        *(left[i] + right[i] for i in range(1, 5)),
        min(left[5], right[5]),
        max(left[6], right[6]),
        min(left[7], right[7]),
        max(left[8], right[8]),
        opening[9],
    )


class FlowWindows(StatefulProcessor):
    """State of one flow: its session's orientation and its open window.

    Combined rows of a trigger are put in packet order first.  A row starting at
    or before the last packet of an earlier trigger is a regression: it comes
    out as a fault and changes nothing.
    """

    def __init__(
        self, window_seconds: float, stale_after_seconds: float | None, timers: bool
    ) -> None:
        self._width = float(window_seconds)
        self._stale = float("inf") if stale_after_seconds is None else float(stale_after_seconds)
        self._timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", _OPEN_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        merged: dict[int, tuple] = {}
        for row in rows:
            totals = tuple(row[name] for name in TOTAL_NAMES)
            held = merged.get(totals[0])
            merged[totals[0]] = totals if held is None else joined(held, totals)
        if not merged:
            return
        state = tuple(self._open.get()) if self._open.exists() else None
        out: list[tuple] = []
        for totals in sorted(merged.values(), key=lambda t: t[5]):
            state = self._step(key, state, totals, out)
        if state is not None:
            self._open.update(state)
            if self._timers and state[3] > 0:
                self._handle.registerTimer(int((state[10] + self._width) * 1000))
        yield from (_WINDOW_ROW(*row) for row in out)

    def _step(self, key, state, totals, out):
        index, first_packet, first_seconds = totals[0], totals[5], totals[7]
        if state is None:
            return (1, totals[9], *totals)
        session, session_up, *held = state
        if first_packet <= held[6] or first_seconds < held[8]:
            out.append((*key, session, session_up, *totals, "packet_regression"))
            return state
        if first_seconds - held[8] >= self._stale:
            self._close(key, state, out)
            return (session + 1, totals[9], *totals)
        if held[1] == 0 or index != held[0]:
            self._close(key, state, out)
            return (session, session_up, *totals)
        return (session, session_up, *joined(tuple(held), totals))

    def _close(self, key, state, out) -> None:
        if state[3] > 0:
            out.append((*key, *state, None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Close the window of a flow that went silent; keep its identity."""
        if not self._open.exists():
            return
        state = tuple(self._open.get())
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000.0
        out: list[tuple] = []
        if state[10] + self._width <= at:
            self._close(key, state, out)
            emptied = list(state)
            emptied[3:7] = [0, 0, 0, 0]
            self._open.update(tuple(emptied))
        yield from (_WINDOW_ROW(*row) for row in out)

    def close(self) -> None:
        """Nothing to release."""


def oriented(rows: DataFrame) -> DataFrame:
    """Window rows with connection and outgoing totals from the session's orientation."""
    up = F.col("session_up")

    def end(which: str, when_up: str, otherwise: str):
        return F.when(up, F.col(f"{when_up}_{which}")).otherwise(F.col(f"{otherwise}_{which}"))

    def outgoing(total: str, ups: str):
        return F.when(up, F.col(ups)).otherwise(F.col(total) - F.col(ups))

    return rows.select(
        "capture_id",
        F.struct(
            end("address", "low", "high").alias("src"),
            end("port", "low", "high").alias("sport"),
            end("address", "high", "low").alias("dst"),
            end("port", "high", "low").alias("dport"),
            F.col("proto").alias("proto"),
        ).alias("connection"),
        "session",
        "window_index",
        F.col("packets").alias("packet_count"),
        outgoing("packets", "up_packets").alias("outgoing_packets"),
        "bytes",
        outgoing("bytes", "up_bytes").alias("outgoing_bytes"),
        "first_packet",
        "last_packet",
        "first_seconds",
        "last_seconds",
        "fault",
    )


def stream_windows(
    packets: DataFrame,
    *,
    window_seconds: float,
    stale_after_seconds: float | None = None,
    silent_after: str | None = None,
) -> DataFrame:
    """Closed flow windows of a packet stream, in append mode.

    ``packets`` carries ``capture_origin``.  A window closes when its flow moves
    on; with ``silent_after`` (a watermark delay such as ``"1 minute"``) also
    when event time passes it.  That suits live captures on one clock; replays
    of captures from different times leave it out and end with
    :func:`finish_windows`.
    """
    check_stale(stale_after_seconds, window_seconds)
    combined = combine_packets(packets, window_seconds)
    if silent_after is not None:
        combined = combined.withColumn(
            "event_time", F.timestamp_seconds("last_seconds")
        ).withWatermark("event_time", silent_after)
    rows = combined.groupBy(*KEYS).transformWithState(
        statefulProcessor=FlowWindows(
            window_seconds, stale_after_seconds, silent_after is not None
        ),
        outputStructType=_WINDOW_ROWS,
        outputMode="append",
        timeMode="none" if silent_after is None else "eventTime",
    )
    return oriented(rows)


def finish_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows still open when a stream ended, read from its state.

    Called once for a completed run.  A cancelled run leaves its open windows
    unread.
    """
    state = (
        spark.read.format("statestore")
        .option("path", checkpoint)
        .option("stateVarName", "open")
        .load()
    )
    return oriented(
        state.select("key.*", "value.*")
        .where(F.col("packets") > 0)
        .withColumn("fault", F.lit(None).cast("string"))
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what a stream's source holds into a Parquet table and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


EventHandler = Callable[[DataFrame, int], None]


def run_handler(
    stream: DataFrame, handler: EventHandler, checkpoint: str, *, output_mode: str = "append"
) -> StreamingQuery:
    """Drain a stream through a batch handler and stop."""
    query = (
        stream.writeStream.foreachBatch(handler)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def event_appender(table: str, order: str) -> EventHandler:
    """Handler that appends events of a batch with their run sequence.

    A batch delivered again replaces its own rows, so nothing is stored twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_events(batch, table, batch_id, order)

    return handle


class ProgressRecorder(StreamingQueryListener):
    """Keeps a small row for every trigger of the queries that run inside it.

    A query's own ``recentProgress`` forgets all but its last triggers.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._rows = spark, []

    def __enter__(self) -> ProgressRecorder:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self._settle()
        self.spark.streams.removeListener(self)

    def _settle(self) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()

    def onQueryStarted(self, event) -> None:
        """Nothing to keep."""

    def onQueryIdle(self, event) -> None:
        """Nothing to keep."""

    def onQueryTerminated(self, event) -> None:
        """Nothing to keep."""

    def onQueryProgress(self, event) -> None:
        """Keep the trigger's figures."""
        p = event.progress
        took = p.durationMs.get("triggerExecution", 0) / 1000.0
        started = pd.Timestamp(p.timestamp).timestamp()
        self._rows.append(
            (p.batchId, int(p.numInputRows), int(p.sink.numOutputRows), took, started)
        )

    def log(self, events: DataFrame | None = None) -> DataFrame:
        """Progress in the layout of ``run_summary``.

        ``events`` (with ``batch_id``) counts the events of handlers that Spark
        reports no output rows for.
        """
        self._settle()
        rows = self.spark.createDataFrame(
            [(b, n, max(o, 0), t, False, s, s + t) for b, n, o, t, s in self._rows],
            "batch_id bigint, packets bigint, events bigint, processing_seconds double, "
            "finalization boolean, started_seconds double, ended_seconds double",
        )
        if events is not None:
            counted = events.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_stored"))
            rows = rows.join(counted, "batch_id", "left").withColumn(
                "events", F.coalesce("_stored", F.lit(0))
            )
        return rows.drop("batch_id", "_stored")
