"""The capture clock against a packet-by-packet run."""

from __future__ import annotations

import random

import pytest
from flowloom.schemas import PACKETS
from flowloom.session import scratch_path
from flowloom.streaming import captures, pipeline
from flowloom.operators.windows import capture_origins

WIDTH = 10.0


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipeline.STATE_STORE)


def traffic(captures_=3, packets=160, seed=5, ends=5):
    source = random.Random(seed)
    rows = []
    for c in range(captures_):
        t = 1_000.0 * c
        hosts = [(f"10.{c}.0.{i}", 1000 + i) for i in range(ends)]
        for n in range(packets):
            t += source.choice([0.0, 0.1, 0.5, 1.0, 3.0, 14.0 if source.random() < 0.2 else 0.2])
            a, b = source.sample(hosts, 2)
            rows.append((f"vpn_ssh_capture{c}.pcap", n + 1, t, *a, *b, 6, 40 + n % 90))
    return rows


class Run:
    """One capture, a packet at a time: flows, windows, refusal."""

    def __init__(self, stale, most):
        self.stale, self.most = stale, most
        self.origin = self.window = self.refused = None
        self.flows, self.open, self.closed = {}, {}, []
        self.packets = self.created = self.evicted = self.peak = 0

    def push(self, number, t, source, target, size):
        if self.refused is not None:
            return
        self.origin = t if self.origin is None else self.origin
        window = int((t - self.origin) // WIDTH)
        if self.window is not None and window > self.window:
            self.flush()
        self.window = window
        if self.stale is not None:
            for flow in [f for f, (_, _, last) in self.flows.items() if t - last >= self.stale]:
                del self.flows[flow]
                self.evicted += 1
        flow = min((source, target), (target, source))
        if flow not in self.flows:
            if self.most is not None and len(self.flows) >= self.most:
                self.refused = number
                self.open.clear()
                return
            self.flows[flow] = (number, source, t)
            self.created += 1
            self.peak = max(self.peak, len(self.flows))
        session, opener, _ = self.flows[flow]
        self.flows[flow] = (session, opener, t)
        self.packets += 1
        held = self.open.setdefault(flow, [opener, session, window, 0, 0, 0, 0, number])
        held[3] += 1
        held[4] += source == opener
        held[5] += size
        held[6] += size * (source == opener)

    def flush(self):
        self.closed += [tuple(h) for h in self.open.values()]
        self.open.clear()


def simulate(rows, stale, most):
    runs = {}
    for capture, number, t, a, ap, b, bp, _, size in rows:
        runs.setdefault(capture, Run(stale, most)).push(number, t, (a, ap), (b, bp), size)
    return runs


def drain(spark, rows, parts, **options):
    """Windows that each trigger gave out, those left open, and the checkpoint."""
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    path = scratch_path(spark, "windows")
    origins = capture_origins(spark.createDataFrame(rows, PACKETS))
    ordered = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // parts)
    triggers = []
    for i in range(parts):
        part = spark.createDataFrame(ordered[i * size : (i + 1) * size], PACKETS)
        part.repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PACKETS).parquet(source).join(origins, "capture_id")
        pipeline.run_to_table(
            captures.stream_capture_windows(stream, window_seconds=WIDTH, **options), path, checkpoint
        )
        triggers.append(spark.read.parquet(path).count())
    return spark.read.parquet(path), checkpoint, triggers


def rows_of(df):
    return sorted(
        (r.capture_id, (r.connection.src, r.connection.sport), r.session, r.window_index, r.packet_count,
         r.outgoing_packets, r.bytes, r.outgoing_bytes, r.first_packet)
        for r in df.where("fault IS NULL").collect()
    )


@pytest.mark.parametrize(
    ("stale", "most", "parts"), [(None, None, 4), (12.0, None, 5), (12.0, 4, 4), (25.0, 9, 3), (None, 6, 3)]
)
def test_equal_to_a_run_packet_by_packet(spark, stale, most, parts):
    rows = traffic()
    runs = simulate(rows, stale, most)
    if most is not None:
        assert any(r.refused for r in runs.values())
    got, checkpoint, _ = drain(
        spark, rows, parts, stale_after_seconds=stale, max_tracked_flows=most
    )
    closed = sorted((c, *w) for c, r in runs.items() for w in r.closed)
    assert rows_of(got) == closed
    left = sorted((c, *w) for c, r in runs.items() for w in map(tuple, r.open.values()))
    assert rows_of(captures.finish_captures(spark, checkpoint)) == left
    faults = {(r.capture_id, r.first_packet, r.fault) for r in got.where("fault IS NOT NULL").collect()}
    assert faults == {
        (c, r.refused, "flow_capacity_exceeded") for c, r in runs.items() if r.refused
    }
    counters = {r.capture_id: tuple(r)[1:] for r in captures.capture_counters(spark, checkpoint).collect()}
    for c, r in runs.items():
        mine = counters[c]
        assert mine[2] == r.created and mine[4] == r.peak and mine[5] == r.refused
        if not r.refused:
            assert mine[:2] == (r.packets, len(r.flows)) and mine[3] == r.evicted


def test_a_silent_flow_closes_when_its_capture_moves_on(spark):
    name = "vpn_ssh_capture0.pcap"
    a, b, s = ("10.0.0.1", 1), ("10.0.0.2", 1), ("10.0.1.1", 2)
    rows = [
        (name, 1, 1000.0, *a, *s, 6, 50),
        (name, 2, 1001.0, *b, *s, 6, 60),
        (name, 3, 1011.0, *b, *s, 6, 70),
        (name, 4, 1012.0, *b, *s, 6, 80),
    ]
    got, checkpoint, triggers = drain(spark, rows, 4)
    assert triggers == [0, 0, 2, 2]
    assert {(r.connection.src, r.bytes) for r in got.collect()} == {(a[0], 50), (b[0], 60)}
    assert [r.bytes for r in captures.finish_captures(spark, checkpoint).collect()] == [150]


def test_regressions_change_nothing(spark):
    name = "vpn_ssh_capture0.pcap"
    a, s = ("10.0.0.1", 1), ("10.0.1.1", 2)
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    path = scratch_path(spark, "windows")
    origins = spark.createDataFrame([(name, 1000.0)], "capture_id string, capture_origin double")
    for part in ([(5, 1005.0), (6, 1006.0)], [(2, 1002.0)], [(7, 1001.0)], [(8, 1015.0)]):
        rows = [(name, n, t, *a, *s, 6, 50) for n, t in part]
        spark.createDataFrame(rows, PACKETS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PACKETS).parquet(source).join(origins, "capture_id")
        pipeline.run_to_table(
            captures.stream_capture_windows(stream, window_seconds=WIDTH), path, checkpoint
        )
    got = spark.read.parquet(path).collect()
    assert {(r.first_packet, r.fault) for r in got} == {
        (2, "packet_regression"), (7, "packet_regression"), (5, None),
    }
    assert [r.packet_count for r in got if r.fault is None] == [2]


def test_arguments():
    with pytest.raises(ValueError):
        captures.stream_capture_windows(None, window_seconds=10.0, stale_after_seconds=5.0)
    with pytest.raises(ValueError):
        captures.stream_capture_windows(None, window_seconds=10.0, max_tracked_flows=0)
