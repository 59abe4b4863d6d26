"""Capture-aligned tumbling observation windows."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.labels import capture_labels, flow_id, window_id
from flowloom.functions.ordered import number_rows, number_sorted
from flowloom.functions.plan import bind, computed_once, with_keys
from flowloom.schemas import MINIMUM_PACKETS, WINDOW_SECONDS, WINDOWS

WINDOW_KEY = ["capture_id", "flow_id", "window_index"]
WINDOW_LABELS = ("vpn_status", "application", "category")
PACKET_ARRAYS = ("timestamps", "sizes", "directions")
# Names of the threshold policies.
RELEASE_COMPATIBLE = "release-compatible"
PAPER_LITERAL = "paper-literal"


def check_window(window_seconds: float, minimum_packets: int = 1) -> None:
    """Reject window parameters no window can have."""
    if not isfinite(window_seconds) or window_seconds <= 0:
        raise ValueError(f"a window lasts a positive number of seconds, not {window_seconds}")
    if minimum_packets < 1:
        raise ValueError(f"a window holds one packet or more, not {minimum_packets}")


def retained(packet_count: Column, minimum_packets: int, policy: str) -> Column:
    """Whether a window has enough packets under the threshold policy."""
    if policy == RELEASE_COMPATIBLE:
        return packet_count > minimum_packets
    if policy == PAPER_LITERAL:
        return packet_count >= minimum_packets
    raise ValueError(f"unknown threshold policy {policy!r}")


def capture_origins(packets: DataFrame) -> DataFrame:
    """Earliest timestamp over all packets of each capture."""
    return packets.groupBy("capture_id").agg(
        F.min("timestamp_seconds").alias("capture_origin")
    )


def window_packets(assigned: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Add the window index and the packet's offset inside its window.

    A packet on a boundary belongs to the later window.
    """
    check_window(window_seconds)
    width = F.lit(float(window_seconds))
    relative = F.col("timestamp_seconds") - F.col("capture_origin")
    if "flow_id" not in assigned.columns:
        assigned = assigned.withColumn("flow_id", flow_id("capture_id", "connection"))
    return (
        assigned.withColumn("window_index", F.floor(relative / width).cast("bigint"))
        .withColumn("offset_seconds", relative - F.col("window_index") * width)
    )


def window_counts(
    packets: DataFrame,
    *,
    minimum_packets: int = MINIMUM_PACKETS,
    policy: str = RELEASE_COMPATIBLE,
) -> DataFrame:
    """Retained windows with their packet counts and connection."""
    return (
        with_keys(packets, *WINDOW_KEY).groupBy(*WINDOW_KEY)
        .agg(F.count(F.lit(1)).alias("packet_count"), F.first("connection").alias("connection"))
        .where(retained(F.col("packet_count"), minimum_packets, policy))
    )


def with_bounds(windows: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Add window id and start / end offsets from the capture origin."""
    width = F.lit(float(window_seconds))
    return (
        windows.withColumn("window_id", window_id())
        .withColumn("start_offset_seconds", F.col("window_index") * width)
        .withColumn("end_offset_seconds", (F.col("window_index") + 1) * width)
    )


def window_table(
    windowed: DataFrame,
    *,
    window_seconds: float = WINDOW_SECONDS,
    minimum_packets: int = MINIMUM_PACKETS,
    policy: str = RELEASE_COMPATIBLE,
    labeled: bool = True,
) -> DataFrame:
    """One row per retained window: identity, bounds, labels and packet count.

    Packets are counted before they are shuffled, so windows of any size fit.
    """
    counted = window_counts(windowed, minimum_packets=minimum_packets, policy=policy)
    found = with_bounds(counted, window_seconds)
    if labeled:
        found = capture_labels(found, "capture_id")
    return found.select(
        *[
            name
            for name in WINDOWS.names
            if name not in PACKET_ARRAYS and (labeled or name not in WINDOW_LABELS)
        ]
    )


def window_packet_rows(windowed: DataFrame, retained_windows: DataFrame) -> DataFrame:
    """One row per packet of the retained windows, keyed by window and position.

    The form for windows of unbounded size: no row or task holds a whole window.
    """
    numbered = number_rows(
        with_keys(windowed, *WINDOW_KEY, "packet_number").select(
            *WINDOW_KEY, "packet_number", "offset_seconds", "size", "direction"
        ),
        WINDOW_KEY,
        "packet_number",
        "_number",
    )
    return numbered.join(retained_windows.select("window_id", *WINDOW_KEY), WINDOW_KEY).select(
        "window_id",
        (F.col("_number") - 1).alias("position"),
        "packet_number",
        "offset_seconds",
        "size",
        "direction",
    )


def observation_windows(
    assigned: DataFrame,
    *,
    window_seconds: float = WINDOW_SECONDS,
    minimum_packets: int = MINIMUM_PACKETS,
    policy: str = RELEASE_COMPATIBLE,
    labeled: bool = True,
) -> DataFrame:
    """Retained windows, one row each, with all their packets as arrays.

    A window's arrays are built in one task; :func:`window_table` with
    :func:`window_packet_rows` is the form without that limit.
    """
    check_window(window_seconds, minimum_packets)
    rows = F.sort_array(
        F.collect_list(F.struct("packet_number", "offset_seconds", "size", "direction"))
    )
    held = (
        with_keys(window_packets(assigned, window_seconds), *WINDOW_KEY)
        .groupBy(*WINDOW_KEY)
        .agg(rows.alias("rows"))
        .withColumn("packet_count", F.size("rows").cast("bigint"))
        .where(retained(F.col("packet_count"), minimum_packets, policy))
    )
    found = with_bounds(held, window_seconds)
    if labeled:
        found = capture_labels(found, "capture_id")
    columns = {
        "timestamps": F.col("rows.offset_seconds"),
        "sizes": F.col("rows.size"),
        "directions": F.col("rows.direction"),
    }
    return found.select(
        *[
            columns.get(name, F.col(name)).alias(name)
            for name in WINDOWS.names
            if labeled or name not in WINDOW_LABELS
        ]
    )


def connection_windows(
    connections: DataFrame,
    *,
    window_seconds: float = WINDOW_SECONDS,
    minimum_packets: int = MINIMUM_PACKETS,
    policy: str = RELEASE_COMPATIBLE,
) -> DataFrame:
    """Retained windows of a nested connection table, without shuffling packets.

    A connection is one row, so its packets are sorted and cut into windows
    inside the row; only the capture origins are aggregated and joined.
    """
    check_window(window_seconds, minimum_packets)
    width = F.lit(float(window_seconds))
    labeled = capture_labels(connections, "file_names").where(F.size("timestamps") > 0)
    origins = labeled.groupBy("capture_id").agg(
        F.min(F.array_min("timestamps")).alias("capture_origin")
    )
    rows = F.sort_array(
        F.arrays_zip(
            F.transform("timestamps", lambda t: t - F.col("capture_origin")).alias("at"),
            F.sequence(F.lit(0), F.size("timestamps") - 1).alias("position"),
            F.col("sizes").alias("size"),
            F.col("directions").alias("direction"),
        )
    )

    def cut(packets: Column, indexes: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(packets) - 1),
            lambda i: (i == 0) | (F.get(indexes, i) != F.get(indexes, i - 1)),
        )
        return bind(
            starts,
            lambda edges: F.transform(
                edges,
                lambda start, k: F.struct(
                    F.get(indexes, start).alias("window_index"),
                    F.slice(
                        packets,
                        start + 1,
                        F.coalesce(F.get(edges, k + 1), F.size(packets)) - start,
                    ).alias("rows"),
                ),
            ),
        )

    pieces = bind(
        rows,
        lambda packets: bind(
            F.transform(packets, lambda p: F.floor(p["at"] / width).cast("bigint")),
            lambda indexes: cut(packets, indexes),
        ),
    )
    kept = F.filter(pieces, lambda w: retained(F.size(w["rows"]), minimum_packets, policy))
    found = (
        labeled.join(origins, "capture_id")
        .withColumn("flow_id", flow_id("capture_id", "connection"))
        .withColumn("_windows", computed_once(kept))
        .select(
            "capture_id",
            "flow_id",
            "vpn_status",
            "application",
            "category",
            F.explode("_windows").alias("w"),
        )
        .withColumn("window_index", F.col("w.window_index"))
        .withColumn("packet_count", F.size("w.rows").cast("bigint"))
        .withColumn("_rows", F.col("w.rows"))
    )
    start = F.col("window_index") * width
    columns = {
        "timestamps": F.transform("_rows", lambda p: p["at"] - start),
        "sizes": F.col("_rows.size"),
        "directions": F.col("_rows.direction"),
    }
    bounded = with_bounds(found, window_seconds)
    return bounded.select(*[columns.get(n, F.col(n)).alias(n) for n in WINDOWS.names])


def packets_of_windows(windows: DataFrame) -> DataFrame:
    """Explode stored windows back into packets, order kept.

    ``packet_number`` is the position in the window.
    """
    packed = F.arrays_zip("timestamps", "sizes", "directions")
    return windows.select(
        "capture_id",
        "flow_id",
        "window_index",
        F.posexplode(packed).alias("position", "p"),
    ).select(
        "capture_id",
        "flow_id",
        "window_index",
        F.col("position").cast("bigint").alias("packet_number"),
        F.col("p.timestamps").alias("offset_seconds"),
        F.col("p.sizes").alias("size"),
        F.col("p.directions").alias("direction"),
    )


def runtime_order(windows: DataFrame, name: str = "emit_position") -> DataFrame:
    """Position at which a live run emits each window.

    Within a capture all flows of a window index are emitted together, by
    connection tuple.
    """
    return number_sorted(windows, ["capture_id"], ["window_index", "connection"], name)


def windows_per_capture(captures: DataFrame, windows: DataFrame) -> DataFrame:
    """Window count of every capture, zero for omitted ones."""
    counted = windows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("windows"))
    return captures.select("capture_id").distinct().join(counted, "capture_id", "left").select(
        "capture_id",
        F.coalesce("windows", F.lit(0)).alias("windows"),
        F.col("windows").isNull().alias("omitted"),
    )
