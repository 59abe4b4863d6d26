"""Bidirectional flow assignment, flow tables, expiring flows and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.labels import flow_id
from flowloom.functions.ordered import chunk_of, number_rows
from flowloom.schemas import CHUNK_ROWS
from flowloom.session import cut_lineage

FLOW_KEY = ["capture_id", "flow_key"]


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add the orientation-free key of a packet and whether it runs low to high."""
    source = F.struct(
        F.col("source_address").alias("address"), F.col("source_port").alias("port")
    )
    target = F.struct(
        F.col("destination_address").alias("address"), F.col("destination_port").alias("port")
    )
    return packets.withColumn(
        "flow_key",
        F.struct(
            F.least(source, target).alias("low"),
            F.greatest(source, target).alias("high"),
            F.col("protocol").alias("proto"),
        ),
    ).withColumn("low_to_high", source <= target)


def _connection(opened_low_to_high: Column) -> Column:
    low, high = F.col("flow_key.low"), F.col("flow_key.high")
    first = F.when(opened_low_to_high, low).otherwise(high)
    second = F.when(opened_low_to_high, high).otherwise(low)
    return F.struct(
        first["address"].alias("src"),
        first["port"].alias("sport"),
        second["address"].alias("dst"),
        second["port"].alias("dport"),
        F.col("flow_key.proto").alias("proto"),
    )


def flow_directory(keyed: DataFrame) -> DataFrame:
    """One row per flow: opening orientation, connection, id and capture origin.

    The packets are aggregated map-side, so a flow holding a third of them costs
    one partial row per task.  Both uses of the flow rows need the same columns,
    so their shuffle is shared.
    """
    flows = keyed.groupBy(*FLOW_KEY).agg(
        F.min_by("low_to_high", "packet_number").alias("opened_low_to_high"),
        F.min("packet_number").alias("first_packet"),
        F.min("timestamp_seconds").alias("first_seconds"),
        F.count(F.lit(1)).alias("packet_count"),
    )
    origins = flows.groupBy("capture_id").agg(
        F.min(F.struct("first_seconds", "opened_low_to_high"))["first_seconds"].alias("_origin")
    )
    return (
        flows.join(origins, "capture_id")
        .withColumn("capture_origin", F.least("_origin", "first_seconds"))
        .drop("_origin")
        .withColumn("connection", _connection(F.col("opened_low_to_high")))
        .withColumn("flow_id", flow_id("capture_id", "connection"))
    )


def assign_flows(packets: DataFrame) -> DataFrame:
    """Assign each packet to its flow; direction 1 is the first seen orientation."""
    keyed = with_flow_key(packets)
    flows = flow_directory(keyed).select(
        *FLOW_KEY, "opened_low_to_high", "connection", "flow_id", "capture_origin"
    )
    return keyed.join(flows, FLOW_KEY).select(
        "capture_id",
        "packet_number",
        "timestamp_seconds",
        "size",
        (F.col("low_to_high") == F.col("opened_low_to_high")).cast("tinyint").alias("direction"),
        "connection",
        "flow_id",
        "capture_origin",
    )


def flow_table(assigned: DataFrame) -> DataFrame:
    """Flows, one row each, with all their packets as arrays in arrival order.

    ``flow_order`` is the first packet number, by which flows sort in first-seen
    order.  A flow's arrays are built in one task; :func:`flow_directory` has the
    flows of any size without them, :func:`assign_flows` their packets.
    """
    rows = F.sort_array(
        F.collect_list(F.struct("packet_number", "timestamp_seconds", "size", "direction"))
    )
    return (
        assigned.groupBy("capture_id", "flow_id", "connection")
        .agg(rows.alias("rows"))
        .select(
            "capture_id",
            "flow_id",
            "connection",
            F.element_at("rows", 1)["packet_number"].alias("flow_order"),
            F.size("rows").cast("bigint").alias("packet_count"),
            F.col("rows.timestamp_seconds").alias("timestamps"),
            F.col("rows.size").alias("sizes"),
            F.col("rows.direction").alias("directions"),
        )
    )


def raw_connections(flows: DataFrame) -> DataFrame:
    """Flow rows in the nested connection layout."""
    return flows.select(
        "connection",
        "timestamps",
        "sizes",
        "directions",
        F.col("capture_id").alias("file_names"),
    )


def assign_sessions(
    packets: DataFrame,
    stale_after_seconds: float | None,
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Flow assignment where a flow idle for ``>= stale`` seconds is forgotten.

    The next packet of a forgotten flow opens a new session and sets its own
    orientation.  Adds ``session`` (1-based per flow), ``direction`` and
    ``connection``.
    """
    if stale_after_seconds is not None and not stale_after_seconds > 0.0:
        raise ValueError(f"a flow goes stale after a positive time, not {stale_after_seconds}")
    keyed = with_flow_key(packets).withColumn("_chunk", chunk_of("packet_number", chunk_rows))
    stale = F.lit(float("inf") if stale_after_seconds is None else float(stale_after_seconds))
    inside = Window.partitionBy(*FLOW_KEY, "_chunk").orderBy("packet_number")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        keyed.withColumn("_gap", F.col("timestamp_seconds") - F.lag("timestamp_seconds").over(inside))
        .withColumn("_opens", F.coalesce(F.col("_gap") >= stale, F.lit(False)))
        .withColumn("_opened", F.sum(F.col("_opens").cast("bigint")).over(running))
        .withColumn(
            "_orientation",
            F.last(F.when(F.col("_opens"), F.col("low_to_high")), ignorenulls=True).over(running),
        )
    )
    summary = marked.groupBy(*FLOW_KEY, "_chunk").agg(
        F.min_by("low_to_high", "packet_number").alias("head"),
        F.min("timestamp_seconds").alias("from_seconds"),
        F.max("timestamp_seconds").alias("to_seconds"),
        F.sum(F.col("_opens").cast("bigint")).alias("inner"),
        F.max_by("_orientation", "packet_number").alias("tail"),
    )
    chunks = Window.partitionBy(*FLOW_KEY).orderBy("_chunk")
    so_far = chunks.rowsBetween(Window.unboundedPreceding, 0)
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    # A chunk opens a session itself when it is the flow's first or the gap to
    # the chunk before is stale; it hands on the orientation it ends with.
    carried = (
        summary.withColumn(
            "opens",
            F.coalesce(
                F.col("from_seconds") - F.lag("to_seconds").over(chunks) >= stale, F.lit(True)
            ),
        )
        .withColumn(
            "ends_with",
            F.coalesce(F.col("tail"), F.when(F.col("opens"), F.col("head"))),
        )
        .select(
            *FLOW_KEY,
            "_chunk",
            (
                F.sum(F.col("opens").cast("bigint")).over(so_far)
                + F.coalesce(F.sum("inner").over(earlier), F.lit(0))
            ).alias("_base"),
            F.when(F.col("opens"), F.col("head"))
            .otherwise(F.last("ends_with", ignorenulls=True).over(earlier))
            .alias("_carried"),
        )
    )
    joined = marked.join(carried, [*FLOW_KEY, "_chunk"]).withColumn(
        "_opened_low_to_high", F.coalesce("_orientation", "_carried")
    )
    return joined.select(
        *packets.columns,
        "flow_key",
        (F.col("_base") + F.col("_opened")).alias("session"),
        (F.col("low_to_high") == F.col("_opened_low_to_high")).cast("tinyint").alias("direction"),
        _connection(F.col("_opened_low_to_high")).alias("connection"),
    )


def sessions(assigned: DataFrame) -> DataFrame:
    """One row per flow session from :func:`assign_sessions` output."""
    return assigned.groupBy(*FLOW_KEY, "session").agg(
        F.min("packet_number").alias("first_packet"),
        F.min("timestamp_seconds").alias("first_seconds"),
        F.max("timestamp_seconds").alias("last_seconds"),
        F.count(F.lit(1)).alias("packet_count"),
        F.min_by("connection", "packet_number").alias("connection"),
    )


def _session_table(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and each capture's end and packet count.

    The sweep reads the sessions several times; they are written once so that
    the packets behind them are read once.
    """
    opened = cut_lineage(
        sessions(assigned).select(
            "capture_id", "first_packet", "first_seconds", "last_seconds", "packet_count"
        )
    )
    ends = opened.groupBy("capture_id").agg(
        F.max("last_seconds").alias("capture_end"), F.sum("packet_count").alias("packet_count")
    )
    return opened, ends


def _expiry(last: Column, stale: float) -> Column:
    """Least double ``e`` with ``e - last >= stale``: the instant a flow is dropped."""
    guess = last + F.lit(stale)
    # 1.2e-16 of a double lies between half and one and a bit units in the last
    # place, so adding or taking it away moves to the neighbouring double.
    step = F.abs(guess) * F.lit(1.2e-16)
    return (
        F.when(guess - last < F.lit(stale), guess + step)
        .when((guess - step) - last >= F.lit(stale), guess - step)
        .otherwise(guess)
    )


def _sweep(
    flow_sessions: DataFrame,
    capture_ends: DataFrame,
    stale_after_seconds: float | None,
    span_seconds: float,
) -> DataFrame:
    """Flows held before and opened at each instant where a flow opens or expires.

    Deltas are first summed per ``(capture, instant)``.  Instants are then cut
    into spans of fixed length, so a capture's running count is a scan inside
    each span plus one over span totals, and a span holds at most as many rows
    as the clock has ticks in it.
    """
    opened = flow_sessions.select(
        "capture_id",
        F.col("first_seconds").alias("at"),
        F.lit(1).alias("opened"),
        F.lit(0).alias("expired"),
    )
    if stale_after_seconds is not None:
        dropped = (
            flow_sessions.select(
                "capture_id", _expiry(F.col("last_seconds"), stale_after_seconds).alias("at")
            )
            .join(capture_ends, "capture_id")
            .where(F.col("at") <= F.col("capture_end"))
            .select("capture_id", "at", F.lit(0).alias("opened"), F.lit(1).alias("expired"))
        )
        opened = opened.unionByName(dropped)
    instants = (
        opened.groupBy("capture_id", "at")
        .agg(F.sum("opened").alias("opened"), F.sum("expired").alias("expired"))
        .withColumn("_span", F.floor(F.col("at") / F.lit(span_seconds)))
    )
    earlier = Window.partitionBy("capture_id").orderBy("_span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = (
        instants.groupBy("capture_id", "_span")
        .agg(F.sum(F.col("opened") - F.col("expired")).alias("net"))
        .select(
            "capture_id", "_span", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("_base")
        )
    )
    inside = Window.partitionBy("capture_id", "_span").orderBy("at")
    return instants.join(bases, ["capture_id", "_span"]).select(
        "capture_id",
        "at",
        "opened",
        "expired",
        (
            F.col("_base")
            + F.sum(F.col("opened") - F.col("expired")).over(
                inside.rowsBetween(Window.unboundedPreceding, 0)
            )
        ).alias("held"),
    )


def flow_concurrency(
    assigned: DataFrame, stale_after_seconds: float | None, *, span_seconds: float = 16.0
) -> DataFrame:
    """Per capture: packets, flows created, evicted, still held, and the peak held.

    Expiries at an instant apply before the packets at that instant.
    """
    opened, ends = _session_table(assigned)
    swept = _sweep(
        opened, ends.select("capture_id", "capture_end"), stale_after_seconds, span_seconds
    )
    return (
        swept.groupBy("capture_id")
        .agg(
            F.sum("opened").alias("flows_created"),
            F.sum("expired").alias("flows_evicted_stale"),
            F.max("held").alias("peak_tracked_flow_count"),
        )
        .join(ends, "capture_id")
        .select(
            "capture_id",
            "packet_count",
            (F.col("flows_created") - F.col("flows_evicted_stale")).alias("tracked_flow_count"),
            "flows_created",
            "flows_evicted_stale",
            "peak_tracked_flow_count",
        )
    )


def capacity_refusals(
    assigned: DataFrame,
    stale_after_seconds: float | None,
    max_tracked_flows: int,
    *,
    span_seconds: float = 16.0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """First packet of each capture that would open one flow too many.

    A capture's run ends there.  Returns ``capture_id, refused_packet_number,
    refused_seconds, failure_code`` for captures that hit the limit.
    """
    if max_tracked_flows < 1:
        raise ValueError("at least one flow has to fit")
    opened, ends = _session_table(assigned)
    # One row per refused capture, read by every branch below.
    over = cut_lineage(
        _sweep(opened, ends.select("capture_id", "capture_end"), stale_after_seconds, span_seconds)
        .where(F.col("held") > max_tracked_flows)
        .groupBy("capture_id")
        .agg(
            F.min("at").alias("refused_seconds"),
            F.min_by(F.col("held") - F.col("opened"), "at").alias("held_before"),
        )
    )
    candidates = opened.join(over, "capture_id").where(
        F.col("first_seconds") == F.col("refused_seconds")
    )
    return (
        number_rows(
            candidates.select("capture_id", "first_packet", "refused_seconds", "held_before"),
            ["capture_id"],
            "first_packet",
            "nth",
            chunk_rows=chunk_rows,
        )
        .where(F.col("nth") == F.lit(max_tracked_flows) - F.col("held_before") + 1)
        .select(
            "capture_id",
            F.col("first_packet").alias("refused_packet_number"),
            "refused_seconds",
            # Fixed value: the stored failure code.
            F.lit("flow_capacity_exceeded").alias("failure_code"),
        )
    )


def admit_packets(assigned: DataFrame, refusals: DataFrame) -> DataFrame:
    """Keep the packets each capture processed before it was refused."""
    limits = refusals.select("capture_id", "refused_packet_number")
    return (
        assigned.join(limits, "capture_id", "left")
        .where(
            F.col("refused_packet_number").isNull()
            | (F.col("packet_number") < F.col("refused_packet_number"))
        )
        .drop("refused_packet_number")
    )
