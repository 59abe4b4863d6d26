"""Event-time counts: one row per window when it is over, late packets as faults."""

from __future__ import annotations

import random
from collections import defaultdict

from flowloom.schemas import PACKETS
from flowloom.session import scratch_path
from flowloom.streaming import event_time, pipeline

WIDTH, DELAY = 10.0, 6.0
NAMES = ["vpn_ssh_capture0.pcap", "vpn_ssh_capture1.pcap"]


def delivered(seed=3, parts=5):
    """Deliveries in which some packets lag and some come twice."""
    source = random.Random(seed)
    rows, t = [], 1000.0
    for n in range(1, 301):
        t += source.choice([0.0, 0.2, 0.4])
        a, b = source.sample([(f"10.0.0.{i}", i) for i in range(4)], 2)
        rows.append((source.choice(NAMES), n, t, *a, *b, 6, 40 + n))
    size = len(rows) // parts
    out = [rows[i * size : (i + 1) * size] for i in range(parts)]
    for i in range(parts - 1):
        lag = [r for r in out[i] if source.random() < 0.1]
        out[i] = [r for r in out[i] if r not in lag]
        out[source.randint(i + 1, parts - 1)] += lag
        out[i + 1] += source.sample(out[i], 3)
    return out


def test_totals_late_packets_and_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipeline.STATE_STORE)
    path, source, checkpoint = (scratch_path(spark, n) for n in ("counts", "source", "checkpoint"))
    origins = spark.createDataFrame([(n, 1000.0) for n in NAMES], "capture_id string, capture_origin double")
    totals, late, seen = defaultdict(lambda: [0, 0]), set(), set()
    watermark, kept, removed = float("-inf"), [], 0
    for part in delivered():
        for name, n, t, *ends, _, size in part:
            window = int((t - 1000.0) // WIDTH)
            key = (name, *min((tuple(ends[:2]), tuple(ends[2:])), (tuple(ends[2:]), tuple(ends[:2]))), window)
            if 1000.0 + (window + 1) * WIDTH <= watermark:
                late.add((name, n))
            elif (name, n) not in seen:
                totals[key][0] += 1
                totals[key][1] += size
                seen.add((name, n))
        watermark = max(watermark, int((max(r[2] for r in part)) * 1000) / 1000 - DELAY)
        spark.createDataFrame(part, PACKETS).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PACKETS).parquet(source).join(origins, "capture_id")
        query = pipeline.run_to_table(
            event_time.settled_counts(stream, window_seconds=WIDTH, delay=f"{int(DELAY)} seconds"),
            path,
            checkpoint,
        )
        last = query.lastProgress.stateOperators[0]
        kept.append(last.numRowsTotal)
        removed += sum(p.stateOperators[0].numRowsRemoved for p in query.recentProgress)
        # What comes out is over, and nothing of it is kept.
        for row in spark.read.parquet(path).where("fault IS NULL").collect():
            assert 1000.0 + (row.window_index + 1) * WIDTH <= watermark
    assert late
    closed = spark.read.parquet(path)
    left = event_time.open_counts(spark, checkpoint)
    assert closed.columns == left.columns
    assert kept[-1] == left.count() and removed == closed.count() > 0
    every = closed.unionByName(left).collect()
    assert {(r.capture_id, r.late_packet_number) for r in every if r.fault == event_time.LATE} == late
    got = {
        (r.capture_id, (r.low_address, r.low_port), (r.high_address, r.high_port), r.window_index):
        [r.packet_count, r.bytes]
        for r in every if r.fault is None
    }
    assert got == totals
    assert sum(r.fault is None for r in every) == len(got)
