"""Streaming operators against their batch twins over several triggers."""

from __future__ import annotations

import random

import pytest
from flowloom.operators import flows, windows
from flowloom.operators.features import flow_statistics
from flowloom.operators.history import number_events
from flowloom.operators.summary import run_summary
from flowloom.schemas import PACKETS
from flowloom.session import scratch_path
from flowloom.streaming import pipeline
from flowloom.streaming.predictions import PredictionRun
from pyspark.sql import functions as F

SECONDS = 10.0
OPTIONS = {"minimum_packets": 2, "window_seconds": SECONDS}


def traffic(captures=2, packets=240, seed=5):
    source = random.Random(seed)
    rows = []
    for c in range(captures):
        t = 1_000.0 * c
        ends = [(f"10.{c}.0.{i}", 1000 + i) for i in range(4)]
        for n in range(packets):
            t += source.choice([0.0, 0.1, 0.4, 1.0, 12.0 if source.random() < 0.2 else 0.2])
            a, b = (ends[0], ends[1]) if source.random() < 0.4 else source.sample(ends, 2)
            a, b = (a, b) if source.random() < 0.6 else (b, a)
            rows.append((f"vpn_ssh_capture{c}.pcap", n + 1, t, *a, *b, 6, 40 + n % 90))
    return rows


def drain(spark, rows, parts, start):
    """Feed the rows in ``parts`` triggers, one file each, through ``start``."""
    source = scratch_path(spark, "source")
    checkpoint = scratch_path(spark, "checkpoint")
    size = -(-len(rows) // parts)
    # Captures advance together, as on a live interface.
    ordered = sorted(rows, key=lambda r: r[1])
    for i in range(parts):
        spark.createDataFrame(ordered[i * size : (i + 1) * size], PACKETS).coalesce(
            1
        ).write.mode("append").parquet(source)
        start(spark.readStream.schema(PACKETS).parquet(source), checkpoint)
    return checkpoint


def batch_sessions(spark, rows, stale):
    df = spark.createDataFrame(rows, PACKETS)
    origins = windows.capture_origins(df)
    return windows.window_packets(
        flows.assign_sessions(df, stale).join(origins, "capture_id"), SECONDS
    )


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipeline.STATE_STORE)


def test_flow_windows_over_triggers_equal_the_batch(spark):
    rows = traffic()
    path = scratch_path(spark, "windows")
    origins = windows.capture_origins(spark.createDataFrame(rows, PACKETS))

    def start(stream, checkpoint):
        closed = pipeline.stream_windows(
            stream.join(origins, "capture_id"),
            window_seconds=SECONDS,
            stale_after_seconds=SECONDS,
        )
        pipeline.run_to_table(closed, path, checkpoint)

    checkpoint = drain(spark, rows, 5, start)
    got = spark.read.parquet(path).unionByName(pipeline.finish_windows(spark, checkpoint))
    assert got.where("fault is not null").count() == 0
    expected = batch_sessions(spark, rows, SECONDS).groupBy(
        "capture_id", "connection", "session", "window_index"
    ).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(F.col("direction").cast("bigint")).alias("outgoing_packets"),
        F.sum("size").alias("bytes"),
        F.sum(F.col("direction") * F.col("size")).alias("outgoing_bytes"),
    )
    listed = {tuple(r) for r in expected.collect()}
    assert {tuple(r) for r in got.select(*expected.columns).collect()} == listed
    assert got.count() == len(listed)


@pytest.mark.parametrize("clients, most", [(40, 40), (90_000, 300_000)])
def test_a_task_combines_more_packets_than_it_holds(spark, clients, most):
    """What is merged is held on with later packets, or passed on where it is much."""

    def combined(tasks):
        n = F.col("id")
        rows = spark.range(450_000, numPartitions=tasks).select(
            F.lit("vpn_ssh_capture0.pcap").alias("capture_id"),
            n.alias("packet_number"),
            (n / 50_000).alias("timestamp_seconds"),
            F.when(n % 7 == 1, "10.0.0.2").otherwise("10.0.0.1").alias("source_address"),
            (n % clients).cast("int").alias("source_port"),
            F.when(n % 7 == 1, "10.0.0.1").otherwise("10.0.0.2").alias("destination_address"),
            (n % clients).cast("int").alias("destination_port"),
            F.lit(6).alias("protocol"),
            (40 + n % 90).alias("size"),
            F.lit(0.0).alias("capture_origin"),
        )
        return pipeline.combine_packets(rows, SECONDS)

    def totals(rows):
        return rows.groupBy(*pipeline.KEYS, "window_index").agg(
            *(F.sum(c).alias(c) for c in ("packets", "up_packets", "bytes", "up_bytes")),
            *(F.min(c).alias(c) for c in ("first_packet", "first_seconds")),
            *(F.max(c).alias(c) for c in ("last_packet", "last_seconds")),
            F.min_by("opens_up", "first_packet").alias("opens_up"),
        )

    one = combined(1).localCheckpoint()
    got, wanted = totals(one), totals(combined(9))
    assert clients == wanted.count() == got.count() <= one.count() <= most
    assert got.exceptAll(wanted).count() == 0
    assert got.agg(F.sum("packets")).first()[0] == 450_000


def test_late_packets_are_faults_and_change_nothing(spark):
    rows = traffic(captures=1, packets=60)
    path = scratch_path(spark, "windows")
    origins = windows.capture_origins(spark.createDataFrame(rows, PACKETS))
    a, b = ("10.0.0.0", 1000), ("10.0.0.1", 1001)
    parts = [
        [("vpn_ssh_capture0.pcap", n, float(n), *a, *b, 6, 50) for n in (5, 6)],
        [("vpn_ssh_capture0.pcap", n, float(n), *a, *b, 6, 50) for n in (2, 3)],
    ]
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    for part in parts:
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PACKETS).parquet(source).join(origins, "capture_id")
        pipeline.run_to_table(
            pipeline.stream_windows(stream, window_seconds=SECONDS), path, checkpoint
        )
    assert spark.read.parquet(path).select("fault").collect()[0][0] == "packet_regression"
    assert pipeline.finish_windows(spark, checkpoint).first()["packet_count"] == 2


def test_stale_limit_must_cover_a_window():
    with pytest.raises(ValueError):
        pipeline.check_stale(5.0, 10.0)


def scorer(rows):
    return rows.select(
        "window_id",
        "capture_id",
        "flow_id",
        "window_index",
        "packet_count",
        "flow_iat_max",
        F.lit("CHAT").alias("predicted"),
    )


def prediction_run(spark, rows, parts, **options):
    run = PredictionRun(
        spark,
        scratch_path(spark, "run"),
        scorer,
        bin_seconds=SECONDS / 4096,
        **OPTIONS,
        **options,
    )
    drain(
        spark, rows, parts, lambda stream, at: pipeline.run_handler(stream, run.handle, at)
    )
    return run


def test_predictions_over_triggers_equal_the_batch(spark):
    rows = traffic()
    run = prediction_run(spark, rows, 4, stale_after_seconds=SECONDS)
    early = run.events().count()
    run.finish()
    got = run.events().cache()
    expected = flow_statistics(batch_sessions(spark, rows, SECONDS), **OPTIONS)
    want = {
        (r["capture_id"], r["flow_id"], r["window_index"], r["packet_count"])
        for r in expected.collect()
    }
    have = [
        (r["capture_id"], r["flow_id"], r["window_index"], r["packet_count"])
        for r in got.collect()
    ]
    assert early < len(have) == len(want) and set(have) == want
    for c in {r[0] for r in have}:
        own = got.where(F.col("run_id") == c).orderBy("sequence").collect()
        assert [r["sequence"] for r in own] == list(range(1, len(own) + 1))
        assert [r["window_index"] for r in own] == sorted(r["window_index"] for r in own)
    assert run.faults().count() == 0


def test_a_cancelled_run_keeps_its_open_windows(spark):
    rows = [
        ("vpn_ssh_capture0.pcap", n, n * 0.1, "10.0.0.1", 1, "10.0.0.2", 2, 6, 50)
        for n in range(1, 31)
    ]
    run = prediction_run(spark, rows, 1)
    # All packets are in the first window, which nothing has closed.
    assert not (run.events().count() if run_has_events(run) else 0)
    run.finish()
    assert run.events().count() == 1


def run_has_events(run):
    try:
        return run.events() is not None
    except Exception:  # noqa: BLE001
        return False


def test_run_stops_at_the_flow_limit(spark):
    rows = [
        ("vpn_ssh_capture0.pcap", n, n * 1.0, f"10.0.0.{1 + n % 2 if n < 26 else 9}", 1, "10.0.1.1", 2, 6, 50)
        for n in range(1, 50)
    ]
    run = prediction_run(spark, rows, 3, max_tracked_flows=2)
    run.finish()
    found = {r["window_index"] for r in run.events().collect()}
    # The third flow opens at second 26, in window 2 counted from second 1.
    assert found == {0, 1}


def test_events_keep_their_numbers_when_delivered_again(spark):
    path = scratch_path(spark, "events")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "run_id string, n bigint")
    second = spark.createDataFrame([("a", 4), ("b", 5)], "run_id string, n bigint")
    handle = pipeline.event_appender(path, "n")
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        handle(batch, number)
    got = {(r["run_id"], r["n"]): r["sequence"] for r in spark.read.parquet(path).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("b", 3): 1, ("a", 4): 3, ("b", 5): 2}
    whole = number_events(first.unionByName(second), "n")
    assert {(r["run_id"], r["n"]): r["sequence"] for r in whole.collect()} == got


def test_run_summary_from_progress(spark):
    path, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    source = scratch_path(spark, "source")
    spark.createDataFrame(traffic(1, 40), PACKETS).write.parquet(source)
    stream = spark.readStream.schema(PACKETS).parquet(source)
    with pipeline.ProgressRecorder(spark) as recorder:
        pipeline.run_to_table(stream, path, checkpoint)
    row = run_summary(recorder.log()).first()
    assert row["packets_processed"] == 40 and row["packet_rate_per_second"] > 0


def test_silent_flows_close_when_event_time_passes(spark):
    name = "vpn_ssh_capture0.pcap"
    a, b, s = ("10.0.0.1", 1), ("10.0.0.2", 1), ("10.0.1.1", 2)
    parts = [
        [(name, 1, 1000.0, *a, *s, 6, 50), (name, 2, 1001.0, *b, *s, 6, 60)],
        [(name, 3, 1100.0, *b, *s, 6, 70)],
        [(name, 4, 1200.0, *b, *s, 6, 80)],
        [(name, 5, 1300.0, *b, *s, 6, 90)],
    ]
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    path = scratch_path(spark, "windows")
    origins = spark.createDataFrame([(name, 1000.0)], "capture_id string, capture_origin double")
    for part in parts:
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PACKETS).parquet(source).join(origins, "capture_id")
        pipeline.run_to_table(
            pipeline.stream_windows(stream, window_seconds=SECONDS, silent_after="1 second"),
            path,
            checkpoint,
        )
    closed = spark.read.parquet(path).collect()
    silent = [r for r in closed if r["connection"]["src"] == a[0]]
    assert [(r["window_index"], r["packet_count"], r["bytes"]) for r in silent] == [(0, 1, 50)]
    every = spark.read.parquet(path).unionByName(pipeline.finish_windows(spark, checkpoint))
    assert sorted((r["window_index"], r["bytes"]) for r in every.collect()) == [
        (0, 50), (0, 60), (10, 70), (20, 80), (30, 90),
    ]


def test_message_stream_feeds_packets(spark):
    from flowloom.sources.messages import packet_message, packet_messages, stream_lines

    rows = spark.createDataFrame(traffic(1, 30), PACKETS)
    source, path = scratch_path(spark, "lines"), scratch_path(spark, "packets")
    text = rows.select(packet_message().alias("value"))
    broken = spark.createDataFrame([("not json",)], "value string")
    text.unionByName(broken).write.text(source)
    pipeline.run_to_table(
        packet_messages(stream_lines(spark, source)), path, scratch_path(spark, "checkpoint")
    )
    got = spark.read.parquet(path)
    assert got.count() == 30
    assert got.exceptAll(rows.select(*got.columns)).count() == 0


@pytest.mark.parametrize("files, step", [(3, 1), (20, 1), (20, -1)])
def test_event_table_may_be_a_folder_of_files(spark, files, step):
    """Also of more files than a trigger takes, written against the order of events."""
    from flowloom.plans import streams

    whole = "/root/testdata/sf0.001"
    folder = scratch_path(spark, "tables")
    events = spark.read.parquet(f"{whole}/events.parquet")
    share = -(-events.count() // files)
    for part in range(files)[::step]:
        rows = events.where(F.floor(F.col("event_id") / share) == part).coalesce(1)
        rows.write.mode("append").parquet(f"{folder}/events.parquet")
    stored = spark.read.parquet(f"{folder}/events.parquet")
    # Files in the order of their events still come sixteen at a time.
    assert streams.files_per_trigger(stored) == (20 if step < 0 else 16)
    got = streams.stream_window_query(spark, folder)
    wanted = streams.stream_window_query(spark, whole)
    assert got.count() == wanted.count() > 0
    assert got.exceptAll(wanted).count() == 0
