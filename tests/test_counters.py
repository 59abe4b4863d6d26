"""Counters inside batch and streaming runs."""

from __future__ import annotations

import pytest
from flowloom.operators.summary import frame_counters
from flowloom.session import scratch_path
from flowloom.streaming import counters, pipeline
from pyspark.sql import Observation
from pyspark.sql import functions as F

STATUS = ["decoded", "decoded", "invalid", "non_ipv4", "decoded"]


def frames(spark, first, count):
    rows = spark.range(first, first + count)
    return rows.select("id", F.element_at(F.array(*map(F.lit, STATUS)), (F.col("id") % 5 + 1).cast("int")).alias("status"))


def test_batch_counters_need_no_second_pass(spark):
    seen = Observation("frames")
    rows = counters.observed(frames(spark, 0, 103), seen, counters.frame_counters())
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == frame_counters(frames(spark, 0, 103)).first().asDict()


def test_every_trigger_counts_once_over_restarts_and_failures(spark):
    source, path, checkpoint, log = (scratch_path(spark, n) for n in ("s", "p", "c", "l"))
    failed = []

    def handle(batch, number):
        batch.write.mode("append").parquet(path)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    for start, count in enumerate((50, 31, 0, 12)):
        if count:
            frames(spark, 100 * start, count).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint, status string").parquet(source)
        rows = counters.observed(stream, "frames", counters.frame_counters())
        with counters.CounterLog(spark) as kept:
            if start == 1:
                with pytest.raises(Exception):  # noqa: B017, PT011
                    pipeline.run_handler(rows, handle, checkpoint)
            else:
                pipeline.run_handler(rows, handle, checkpoint)
        kept.store(log)
    found = counters.counted_once(spark.read.parquet(log)).orderBy("batch_id").collect()
    assert [(r.batch_id, r.frames_received) for r in found] == [(0, 50.0), (1, 31.0), (2, 12.0)]
    assert [r.packets_decoded for r in found] == [30.0, 19.0, 8.0]
    assert len({r.query_id for r in found}) == 1


def test_packet_counters(spark, make_packets):
    rows = make_packets([(1.0, ("10.0.0.1", 1), ("10.0.0.2", 2), 40), (5.5, ("10.0.0.2", 2), ("10.0.0.1", 1), 60)])
    seen = Observation("packets")
    counters.observed(rows, seen, counters.packet_counters()).collect()
    assert seen.get == {"packets": 2, "bytes": 100, "first_seconds": 1.0, "last_seconds": 5.5}
