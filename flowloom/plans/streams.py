"""Registered streaming queries over the event table, with batch SQL twins.

Each drains the table as a file stream into the shared folder and returns what
the sink holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.windows import capture_origins
from flowloom.plans.sessions import EVENTS_SQL
from flowloom.plans.settings import (
    ACTIVITY,
    BIN,
    CLOCK_FLOWS,
    CLOCK_SESSIONS_SQL,
    CLOCK_STALE,
    CLOCK_WINDOW,
    MINIMUM,
    PACKETS_SQL,
    SESSIONS_SQL,
    STALE,
    WINDOW,
    as_float,
    float_sql,
    packets,
    table,
)
from flowloom.session import scratch_path
from flowloom.plans.traffic import event_frames
from flowloom.sources.frames import decode_frames
from flowloom.sources.packets import event_packets
from flowloom.streaming import captures, counters, event_time, pipeline
from flowloom.streaming.predictions import PredictionRun

QUERIES = {}
SQL = {}


def _register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


_FILES_PER_TRIGGER = 16


def files_per_trigger(events: DataFrame) -> int:
    """Files of the event table that one trigger may take.

    Files come by modification time.  Where that is not the order of their events, a
    trigger that ends between files would make the events of later ones regressions;
    such a table comes in one trigger, inside which the operators order rows by themselves.
    """
    count = len(events.inputFiles())
    if count <= _FILES_PER_TRIGGER:
        return _FILES_PER_TRIGGER
    files = (
        events.groupBy("_metadata.file_path", "_metadata.file_modification_time")
        .agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
        .orderBy("file_modification_time", "first")
        .collect()  # one row per file
    )
    ordered = all(
        a["file_modification_time"] < b["file_modification_time"] and a["last"] < b["first"]
        for a, b in zip(files, files[1:], strict=False)
    )
    return _FILES_PER_TRIGGER if ordered else count


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table, one file or a folder of files, as a file stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipeline.STATE_STORE)
    events = table(spark, folder, "events")
    return (
        spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", files_per_trigger(events))
        # Only as a pattern may the path be a file as well as a folder.
        .parquet(f"{folder}/{{events.parquet}}")
    )


def packet_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of the event stream with their capture's known origin."""
    origins = capture_origins(packets(spark, folder))
    return event_packets(event_stream(spark, folder), numbered=False).join(origins, "capture_id")


_ORIGINS_SQL = "origins AS (SELECT capture_id, min(sec) AS origin FROM packets GROUP BY 1)"


@_register(
    "stream_flow_windows",
    f"""WITH {SESSIONS_SQL}, {_ORIGINS_SQL}
SELECT s.capture_id, any_value(c_src) AS src, any_value(c_sport) AS sport,
  any_value(c_dst) AS dst, any_value(c_dport) AS dport, any_value(proto) AS proto, session,
  CAST(floor((sec - origin) / {WINDOW}::DOUBLE) AS BIGINT) AS window_index,
  count(*) AS packet_count,
  count(*) FILTER (WHERE src = c_src AND sport = c_sport) AS outgoing_packets,
  CAST(sum(size) AS BIGINT) AS bytes,
  CAST(coalesce(sum(size) FILTER (WHERE src = c_src AND sport = c_sport), 0) AS BIGINT)
    AS outgoing_bytes,
  min(packet_number) AS first_packet, max(packet_number) AS last_packet,
  min(sec) AS first_seconds, max(sec) AS last_seconds
FROM in_sessions s JOIN origins USING (capture_id)
GROUP BY s.capture_id, flow_key, session, 8""",
)
def stream_window_query(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "stream")
    closed = pipeline.stream_windows(
        packet_stream(spark, folder), window_seconds=WINDOW, stale_after_seconds=STALE
    )
    pipeline.run_to_table(closed, path, checkpoint)
    whole = spark.read.schema(closed.schema).parquet(path).unionByName(
        pipeline.finish_windows(spark, checkpoint)
    )
    return whole.where(F.col("fault").isNull()).select(
        "capture_id", "connection.*", *closed.columns[2:-1]
    )


@_register(
    "stream_window_counts",
    f"""WITH {PACKETS_SQL}, {_ORIGINS_SQL}
SELECT p.capture_id, least(src, dst) AS low_address, greatest(src, dst) AS high_address, proto,
  CAST(floor((sec - origin) / {WINDOW}::DOUBLE) AS BIGINT) AS window_index,
  count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS bytes,
  CAST(coalesce(sum(size) FILTER (WHERE src < dst), 0) AS BIGINT) AS low_to_high_bytes,
  min(sec) AS first_seconds, max(sec) AS last_seconds
FROM packets p JOIN origins USING (capture_id) GROUP BY 1, 2, 3, 4, 5""",
)
def stream_count_query(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "stream")
    counts = event_time.settled_counts(
        packet_stream(spark, folder), window_seconds=WINDOW, delay="1 hour"
    )
    pipeline.run_to_table(counts, path, checkpoint)
    return (
        spark.read.schema(counts.schema)
        .parquet(path)
        .unionByName(event_time.open_counts(spark, checkpoint))
        .drop("low_port", "high_port", "fault", "late_packet_number")
    )


# Packets behind this one come in a second delivery, with one in fifty of those before.
_DELIVERED = "(packet_number % 50 <> 7 AND packet_number < (SELECT 0.9 * max(packet_number) FROM packets))"
_DELAY = 86_400.0


@_register(
    "stream_late_packets",
    f"""WITH {PACKETS_SQL}, {_ORIGINS_SQL},
timed AS (
  SELECT p.*, {_DELIVERED} AS early,
    CAST(floor((sec - origin) / {CLOCK_WINDOW}::DOUBLE) AS BIGINT) AS window_index,
    ceil((origin + (floor((sec - origin) / {CLOCK_WINDOW}::DOUBLE) + 1) * {CLOCK_WINDOW}::DOUBLE)
      * 1000) AS ends
  FROM packets p JOIN origins USING (capture_id)),
judged AS (
  SELECT *, NOT early AND ends <= (SELECT floor(max(sec) * 1000) - {_DELAY} * 1000 FROM timed
    WHERE early) AS late FROM timed)
SELECT capture_id, least(src, dst) AS low_address, greatest(src, dst) AS high_address, proto,
  window_index, CASE WHEN late THEN 'late_packet' END AS fault,
  CASE WHEN late THEN packet_number END AS late_packet_number,
  count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS bytes,
  CAST(coalesce(sum(size) FILTER (WHERE src < dst), 0) AS BIGINT) AS low_to_high_bytes,
  min(sec) AS first_seconds, max(sec) AS last_seconds
FROM judged GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
def stream_late_query(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipeline.STATE_STORE)
    path, checkpoint = scratch_path(spark, "late"), scratch_path(spark, "stream")
    source = scratch_path(spark, "deliveries")
    rows = packets(spark, folder)
    early = (F.col("packet_number") % 50 != 7) & (
        F.col("packet_number") < F.lit(0.9) * F.lit(rows.agg(F.max("packet_number")).first()[0])
    )
    origins = capture_origins(rows)
    for delivery in (rows.where(early), rows.where(~early)):
        delivery.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source).join(origins, "capture_id")
        counts = event_time.settled_counts(
            stream, window_seconds=CLOCK_WINDOW, delay=f"{int(_DELAY)} seconds"
        )
        pipeline.run_to_table(counts, path, checkpoint)
    return (
        spark.read.schema(counts.schema)
        .parquet(path)
        .unionByName(event_time.open_counts(spark, checkpoint))
        .drop("low_port", "high_port")
    )


@_register(
    "stream_capture_windows",
    f"""WITH {CLOCK_SESSIONS_SQL}, {_ORIGINS_SQL},
opens AS (
  SELECT capture_id, first_packet, first_seconds FROM sessions),
spans AS (
  SELECT o.capture_id, o.first_packet, count(h.first_packet) AS held
  FROM opens o LEFT JOIN sessions h ON h.capture_id = o.capture_id
    AND h.first_packet < o.first_packet AND o.first_seconds - h.last_seconds < {CLOCK_STALE}::DOUBLE
  GROUP BY 1, 2),
refused AS (
  SELECT capture_id, min(first_packet) AS refused FROM spans WHERE held >= {CLOCK_FLOWS} GROUP BY 1),
cut AS (
  SELECT s.*, CAST(floor((sec - origin) / {CLOCK_WINDOW}::DOUBLE) AS BIGINT) AS window_index,
    first_value(packet_number) OVER (PARTITION BY s.capture_id, flow_key, session
      ORDER BY packet_number) AS opened
  FROM in_sessions s JOIN origins USING (capture_id)),
ends AS (
  SELECT r.capture_id, refused, window_index AS last_window
  FROM refused r JOIN cut c ON c.capture_id = r.capture_id AND c.packet_number = r.refused)
SELECT c.capture_id, any_value(c_src) AS src, any_value(c_sport) AS sport, any_value(c_dst) AS dst,
  any_value(c_dport) AS dport, any_value(proto) AS proto, opened AS session, window_index,
  count(*) AS packet_count,
  count(*) FILTER (WHERE src = c_src AND sport = c_sport) AS outgoing_packets,
  CAST(sum(size) AS BIGINT) AS bytes,
  CAST(coalesce(sum(size) FILTER (WHERE src = c_src AND sport = c_sport), 0) AS BIGINT)
    AS outgoing_bytes,
  min(packet_number) AS first_packet, max(packet_number) AS last_packet,
  min(sec) AS first_seconds, max(sec) AS last_seconds, max(refused) AS refused_packet_number
FROM cut c LEFT JOIN ends e ON e.capture_id = c.capture_id
WHERE refused IS NULL OR (packet_number < refused AND window_index < last_window)
GROUP BY c.capture_id, flow_key, opened, window_index""",
)
def stream_capture_query(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "stream")
    closed = captures.stream_capture_windows(
        packet_stream(spark, folder),
        window_seconds=CLOCK_WINDOW,
        stale_after_seconds=CLOCK_STALE,
        max_tracked_flows=CLOCK_FLOWS,
    )
    pipeline.run_to_table(closed, path, checkpoint)
    whole = spark.read.schema(closed.schema).parquet(path).unionByName(
        captures.finish_captures(spark, checkpoint)
    )
    refused = captures.capture_counters(spark, checkpoint).select(
        "capture_id", "refused_packet_number"
    )
    return (
        whole.where(F.col("fault").isNull())
        .select("capture_id", "connection.*", *closed.columns[2:-1])
        .join(refused, "capture_id")
    )


@_register(
    "stream_events_sink",
    f"WITH {EVENTS_SQL} SELECT * FROM log",
)
def stream_event_query(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "events"), scratch_path(spark, "stream")
    log = event_stream(spark, folder).select(
        F.col("user_id").cast("string").alias("run_id"),
        "event_id",
        F.to_json(
            F.struct(
                F.col("event_type").alias("kind"), F.floor(F.col("value") * 10).alias("level")
            )
        ).alias("payload_json"),
    )
    pipeline.run_handler(log, pipeline.event_appender(path, "event_id"), checkpoint)
    return spark.read.parquet(path).select("run_id", "sequence", "payload_json")


_STARTS = 3


@_register(
    "stream_frame_counters",
    f"""WITH s AS (
  SELECT event_id * {_STARTS} // ((SELECT max(event_id) FROM events) + 1) AS batch_id,
    CASE WHEN event_id % 19 = 6 THEN 'invalid' WHEN event_id % 11 = 3 THEN 'non_ipv4'
      WHEN event_id % 13 = 4 OR event_id % 17 = 5 THEN 'invalid' ELSE 'decoded' END AS status
  FROM events)
SELECT batch_id::BIGINT AS batch_id, count(*) AS frames_received,
  count(*) FILTER (WHERE status = 'decoded') AS packets_decoded,
  count(*) FILTER (WHERE status = 'non_ipv4') AS non_ipv4_frames,
  count(*) FILTER (WHERE status = 'invalid') AS invalid_frames
FROM s GROUP BY 1""",
)
def stream_counter_query(spark: SparkSession, folder: str) -> DataFrame:
    """Frames counted while a stream decodes them, over several starts of it."""
    source, path, checkpoint, log = (
        scratch_path(spark, n) for n in ("frames", "decoded", "stream", "counters")
    )
    rows = table(spark, folder, "events")
    ids = F.lit(rows.agg(F.max("event_id")).first()[0] + 1)
    for start in range(_STARTS):
        part = rows.where(F.floor(F.col("event_id") * _STARTS / ids) == start)
        event_frames(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id bigint, frame binary").parquet(source)
        decoded = counters.observed(decode_frames(stream), "frames", counters.frame_counters())
        with counters.CounterLog(spark) as kept:
            pipeline.run_to_table(decoded, path, checkpoint)
        kept.store(log)
    found = counters.counted_once(spark.read.parquet(log))
    names = list(counters.frame_counters())
    return found.select("batch_id", *(F.col(n).cast("bigint").alias(n) for n in names))


def _rate_scorer(rows: DataFrame) -> DataFrame:
    """A scorer of one feature: the byte rate decides the class."""
    rate = F.col("log_bytes_per_sec")
    return rows.select(
        "window_id",
        "capture_id",
        "flow_id",
        "window_index",
        "packet_count",
        as_float(rate).alias("rate"),
        F.when(rate > -5.0, F.lit("busy")).otherwise(F.lit("quiet")).alias("predicted"),
    )


@_register(
    "stream_predictions",
    f"""WITH {SESSIONS_SQL}, {_ORIGINS_SQL},
held AS (
  SELECT s.capture_id, c_src, c_sport, c_dst, c_dport, proto,
    CAST(floor((sec - origin) / {WINDOW}::DOUBLE) AS BIGINT) AS window_index,
    count(*) AS packet_count, {float_sql(f"ln(sum(size) / {WINDOW}::DOUBLE)")} AS rate
  FROM in_sessions s JOIN origins USING (capture_id) GROUP BY 1, 2, 3, 4, 5, 6, 7
  HAVING count(*) > {MINIMUM}),
named AS (
  SELECT *, substr(sha256(capture_id || chr(0) || c_src || chr(0) || c_sport || chr(0) || c_dst
      || chr(0) || c_dport || chr(0) || proto), 1, 24) AS flow_id FROM held)
SELECT capture_id AS run_id, row_number() OVER (PARTITION BY capture_id
    ORDER BY window_index, c_src, c_sport, c_dst, c_dport, proto) AS sequence,
  capture_id || ':' || flow_id || ':' || window_index AS window_id, window_index, packet_count,
  rate, CASE WHEN rate > -5 THEN 'busy' ELSE 'quiet' END AS predicted,
  window_index * {WINDOW}::DOUBLE AS start_offset_seconds
FROM named""",
)
def stream_prediction_query(spark: SparkSession, folder: str) -> DataFrame:
    run = PredictionRun(
        table(spark, folder, "events").sparkSession,
        scratch_path(spark, "predictions"),
        _rate_scorer,
        window_seconds=WINDOW,
        bin_seconds=BIN,
        minimum_packets=MINIMUM,
        stale_after_seconds=STALE,
        feature_options={"activity_timeout": ACTIVITY},
    )
    stream = event_packets(event_stream(spark, folder), numbered=False)
    pipeline.run_handler(stream, run.handle, scratch_path(spark, "stream"))
    run.finish()
    return run.events().select(
        "run_id",
        "sequence",
        "window_id",
        "window_index",
        "packet_count",
        "rate",
        "predicted",
        "start_offset_seconds",
    )
