"""Capture-wide windows and flow limits in one stateful stream.

Two stateful operators follow each other.  The capture clock, keyed by capture,
knows the current window, the flows that are tracked and which of them have packets
in the window.  It admits packets, forgets stale flows, refuses the flow that is one
too many, and says when a window is over: then every flow with packets in it gets a
closing row, so a flow that went silent is closed in the trigger in which its
capture moves on.  The second operator, keyed by flow, holds the totals of the one
open window and gives them out when its closing row comes.

Packets are combined per task, flow and window before they reach the clock, so a
capture with a third of all packets reaches it as one row per task, flow and window.
That is exact: a flow may not go stale inside a window, so all that the clock asks of
a flow is its first and last packet in each window; and a refusal ends the capture,
whose open window is then given up, so no combined row has to be split.

Flows are entries of a map state; which of them were seen in a window is listed in
blocks, one per trigger and window.  A trigger reads and writes the flows it touches
and the blocks that come due, not the capture's whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowloom.streaming.pipeline import (
    KEY_TYPES,
    KEYS,
    TOTAL_NAMES,
    TOTALS,
    check_stale,
    combine_packets,
    joined,
    oriented,
)

FLOW_KEY = KEYS[1:]
_FLOW_KEY_TYPES = KEY_TYPES.split(", ", 1)[1]
#: What the clock tells a flow: totals, end of a window, end of the capture's run;
#: or a fault of a row that changes nothing.
PART, CLOSE, DROP, FAULT = range(4)
#: Failure codes of refused packets.
CAPACITY, REGRESSION = "flow_capacity_exceeded", "packet_regression"

_CLOCK = (
    "origin double, window bigint, last_packet bigint, last_seconds double, packets bigint, "
    "held bigint, created bigint, evicted bigint, peak bigint, refused bigint"
)
_CLOCK_NAMES = [part.split()[0] for part in _CLOCK.split(", ")]
_FLOW = "session bigint, session_up boolean, last_seconds double, window bigint"
_BLOCK = f"flows array<struct<{_FLOW_KEY_TYPES.replace(' ', ':').replace(',:', ',')}>>"
_SIGNALS = f"{KEY_TYPES}, kind int, session bigint, session_up boolean, {TOTALS}, fault string"
_SIGNAL_NAMES = [part.split()[0] for part in _SIGNALS.split(", ")]
_WINDOWS = f"{KEY_TYPES}, session bigint, session_up boolean, {TOTALS}, fault string"
_WINDOW_NAMES = [part.split()[0] for part in _WINDOWS.split(", ")]
_OPEN = f"session bigint, session_up boolean, {TOTALS}"
_NO_TOTALS = (None,) * (len(TOTAL_NAMES) - 1)


class _Capture:
    """State of one capture during a trigger: read when needed, written once."""

    def __init__(self, clock, flows, seen):
        self._clock, self._flows, self._seen = clock, flows, seen
        held = clock.get() if clock.exists() else None
        names = dict.fromkeys(_CLOCK_NAMES)
        self.at = {**names, "packets": 0, "held": 0, "created": 0, "evicted": 0, "peak": 0}
        if held is not None:
            self.at = dict(zip(_CLOCK_NAMES, held, strict=True))
        self._known: dict[tuple, tuple | None] = {}
        self._changed: set[tuple] = set()
        self._blocks: dict[int, list[int]] = {}
        for window, block in seen.keys() if held is not None else ():
            self._blocks.setdefault(window, []).append(block)
        #: Flows last seen in a window: lists that are read, and their least time.
        self._listed: dict[int, list[tuple]] = {}
        self._least: dict[int, float] = {}
        self._fresh: dict[int, list[tuple]] = {}

    def flow(self, key: tuple) -> tuple | None:
        """``session, session_up, last_seconds, window`` of a tracked flow."""
        if key not in self._known:
            found = self._flows.getValue(key) if self.at["created"] else None
            self._known[key] = None if found is None else tuple(found)
        return self._known[key]

    def track(self, key: tuple, value: tuple | None) -> None:
        """Change or forget a flow."""
        before = self.flow(key)
        self._known[key] = value
        self._changed.add(key)
        if value is not None and (before is None or before[3] != value[3]):
            self._fresh.setdefault(value[3], []).append(key)
        if value is not None and value[3] in self._least:
            self._least[value[3]] = min(self._least[value[3]], value[2])

    def seen_in(self, window: int) -> list[tuple]:
        """Flows last seen in a window or in a later one."""
        if window not in self._listed:
            found: list[tuple] = []
            for block in self._blocks.get(window, ()):
                found += map(tuple, self._seen.getValue((window, block))[0])
            self._listed[window] = found
        self._listed[window] += self._fresh.pop(window, [])
        return self._listed[window]

    def forget_stale(self, now: float, stale: float, width: float) -> None:
        """Forget flows that were silent for as long as ``stale``."""
        bound = (now - stale - self.at["origin"]) / width + 1
        for window in sorted({*self._blocks, *self._listed, *self._fresh}):
            if window > bound:
                break
            if now - self._least.get(window, float("-inf")) < stale:
                continue
            left, least = [], float("inf")
            for key in self.seen_in(window):
                held = self.flow(key)
                if held is None or held[3] != window:
                    continue
                if now - held[2] >= stale:
                    self.track(key, None)
                    self.at["held"] -= 1
                    self.at["evicted"] += 1
                else:
                    left.append(key)
                    least = min(least, held[2])
            self._listed[window], self._least[window] = left, least

    def save(self) -> None:
        """Write what changed."""
        for key in self._changed:
            value = self._known[key]
            if value is None:
                self._flows.removeKey(key)
            else:
                self._flows.updateValue(key, value)
        for window in {*self._listed, *self._fresh}:
            blocks = self._blocks.get(window, [])
            if window in self._listed:  # read as a whole, so written as a whole
                for block in blocks:
                    self._seen.removeKey((window, block))
                blocks = []
            fresh = self._listed.get(window, []) + self._fresh.get(window, [])
            if fresh:
                self._seen.updateValue((window, max(blocks, default=-1) + 1), (fresh,))
        self._clock.update(tuple(self.at[name] for name in _CLOCK_NAMES))


class CaptureClock(StatefulProcessor):
    """Admits the packets of a capture in order; see the module text."""

    def __init__(
        self,
        window_seconds: float,
        stale_after_seconds: float | None = None,
        max_tracked_flows: int | None = None,
    ) -> None:
        self._width = float(window_seconds)
        self._stale = stale_after_seconds
        self._most = max_tracked_flows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._clock = handle.getValueState("clock", _CLOCK)
        self._flows = handle.getMapState("flows", _FLOW_KEY_TYPES, _FLOW)
        self._seen = handle.getMapState("seen", "window bigint, block bigint", _BLOCK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        capture = _Capture(self._clock, self._flows, self._seen)
        if capture.at["refused"] is not None:
            return
        parts: dict[tuple, tuple] = {}
        for row in rows:
            own = tuple(row[name] for name in FLOW_KEY)
            totals = tuple(row[name] for name in TOTAL_NAMES)
            held = parts.get((own, totals[0]))
            parts[own, totals[0]] = totals if held is None else joined(held, totals)
        signal = Row(*_SIGNAL_NAMES)
        for out in self._run(capture, sorted(parts.items(), key=lambda p: p[1][5])):
            yield signal(*key, *out)
        capture.save()

    def _run(self, capture: _Capture, parts: list) -> Iterator[tuple]:
        at = capture.at
        before = at["last_packet"] if at["last_packet"] is not None else float("-inf")
        now = at["last_seconds"] if at["last_seconds"] is not None else float("-inf")
        last_packet, last_seconds = before, now
        for (own, _), totals in parts:
            window, first_packet, first_seconds = totals[0], totals[5], totals[7]
            if first_packet <= before or first_seconds < now:
                yield (*own, FAULT, None, None, *totals, REGRESSION)
                continue
            now = first_seconds
            at["origin"] = first_seconds if at["origin"] is None else at["origin"]
            if at["window"] is not None and window > at["window"]:
                yield from self._tell(capture, CLOSE)
            at["window"] = window if at["window"] is None else max(window, at["window"])
            if self._stale is not None:
                capture.forget_stale(now, self._stale, self._width)
            held = capture.flow(own)
            if held is None:
                if self._most is not None and at["held"] >= self._most:
                    at["refused"] = first_packet
                    yield (*own, FAULT, None, None, *totals, CAPACITY)
                    yield from self._tell(capture, DROP)
                    return
                held = (first_packet, totals[9])
                at["held"] += 1
                at["created"] += 1
                at["peak"] = max(at["peak"], at["held"])
            capture.track(own, (*held[:2], totals[8], window))
            at["packets"] += totals[1]
            last_packet, last_seconds = max(last_packet, totals[6]), max(last_seconds, totals[8])
            yield (*own, PART, *held[:2], *totals, None)
        if last_packet > before:
            at["last_packet"], at["last_seconds"] = last_packet, last_seconds
            if self._stale is not None:
                capture.forget_stale(last_seconds, self._stale, self._width)

    def _tell(self, capture: _Capture, kind: int) -> Iterator[tuple]:
        """A row to each flow with packets in the current window."""
        window = capture.at["window"]
        for own in dict.fromkeys(capture.seen_in(window)):
            held = capture.flow(own)
            if held is not None and held[3] == window:
                yield (*own, kind, *held[:2], window, *_NO_TOTALS, None)

    def close(self) -> None:
        """Nothing to release."""


class OpenWindow(StatefulProcessor):
    """Totals of a flow's open window, given out when the clock closes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = tuple(self._open.get()) if self._open.exists() else None
        held = state
        window = Row(*_WINDOW_NAMES)
        signals = sorted(
            (tuple(row[name] for name in ("kind", *_OPEN_NAMES, "fault")) for row in rows),
            key=lambda s: (s[3], s[0]),
        )
        for kind, *totals, fault in signals:
            totals = tuple(totals)
            if kind == FAULT:
                yield window(*key, *totals, fault)
            elif kind == PART:
                same = held is not None and held[2] == totals[2]
                held = (*held[:2], *joined(held[2:], totals[2:])) if same else totals
            elif held is not None and held[2] == totals[2]:
                if kind == CLOSE:
                    yield window(*key, *held, None)
                held = None
        if held is None and state is not None:
            self._open.clear()
        elif held is not None and held != state:
            self._open.update(held)

    def close(self) -> None:
        """Nothing to release."""


_OPEN_NAMES = ["session", "session_up", *TOTAL_NAMES]


def stream_capture_windows(
    packets: DataFrame,
    *,
    window_seconds: float,
    stale_after_seconds: float | None = None,
    max_tracked_flows: int | None = None,
) -> DataFrame:
    """Closed windows of all flows, and faults, of a packet stream in append mode.

    ``packets`` carries ``capture_origin``.  ``session`` is the packet number that
    opened the flow.  A row with a ``fault`` is a regression (a part that starts at or
    before the last packet of an earlier trigger, or goes back in time), which changes
    nothing, or the packet that was refused, with which the capture's run ends: its
    open window and later packets are given up.
    """
    check_stale(stale_after_seconds, window_seconds)
    if max_tracked_flows is not None and max_tracked_flows < 1:
        raise ValueError("at least one flow has to fit")
    clock = CaptureClock(window_seconds, stale_after_seconds, max_tracked_flows)
    signals = (
        combine_packets(packets, window_seconds)
        .groupBy("capture_id")
        .transformWithState(clock, _SIGNALS, "append", "none")
    )
    closed = signals.groupBy(*KEYS).transformWithState(OpenWindow(), _WINDOWS, "append", "none")
    return oriented(closed)


def _state(spark: SparkSession, checkpoint: str, operator: int, name: str) -> DataFrame:
    return (
        spark.read.format("statestore")
        .option("path", checkpoint)
        .option("operatorId", operator)
        .option("stateVarName", name)
        .load()
    )


def finish_captures(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows still open when a stream ended, read from its state."""
    rows = _state(spark, checkpoint, 0, "open").select("key.*", "value.*")
    return oriented(rows.withColumn("fault", F.lit(None).cast("string")))


def capture_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Packets and flows of each capture so far, and the packet that was refused."""
    return _state(spark, checkpoint, 1, "clock").select(
        "key.capture_id",
        F.col("value.packets").alias("packet_count"),
        F.col("value.held").alias("tracked_flow_count"),
        F.col("value.created").alias("flows_created"),
        F.col("value.evicted").alias("flows_evicted_stale"),
        F.col("value.peak").alias("peak_tracked_flow_count"),
        F.col("value.refused").alias("refused_packet_number"),
    )
