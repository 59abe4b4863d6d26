"""Registered queries on stored tables, nested connections, runs and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import features, flows, history, model, summary, validate, windows
from flowloom.plans.roles import ROWS_SQL, assignments
from flowloom.plans.sessions import EVENTS_SQL, REPLAY, changes, changes_sql, events
from flowloom.plans.settings import (
    ACTIVITY,
    ASSIGNED_SQL,
    BIN,
    MINIMUM,
    WINDOW,
    WINDOWED_SQL,
    assigned,
    category_sql,
    packets,
    table,
)
from flowloom.schemas import FEATURE_COLUMNS
from flowloom.session import scratch_path
from flowloom.sinks import tables
from flowloom.sources import artifacts
from flowloom.sources.packets import read_raw_connections

QUERIES = {}
SQL = {}


def _register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


@_register(
    "raw_connections",
    f"""WITH {ASSIGNED_SQL},
f AS (SELECT capture_id, flow_id, count(*) AS n FROM assigned GROUP BY 1, 2)
SELECT 'violation' AS kind, 'connection_port' AS name, count(*) AS n FROM f WHERE n % 7 = 3
  HAVING count(*) > 0
UNION ALL SELECT 'violation', 'array_length', count(*) FROM f WHERE n % 5 = 2 HAVING count(*) > 0
UNION ALL SELECT 'violation', 'direction_value', count(*) FROM f WHERE n % 11 = 4
  HAVING count(*) > 0
UNION ALL SELECT 'rows', 'connections', count(*) FROM f
UNION ALL SELECT 'rows', 'packets', CAST(sum(n) AS BIGINT) FROM f""",
)
def raw_connection_query(spark: SparkSession, folder: str) -> DataFrame:
    """Flows written as nested connections, read back, counted and checked."""
    path = scratch_path(spark, "connections")
    flows.raw_connections(flows.flow_table(assigned(spark, folder))).write.parquet(path)
    stored = read_raw_connections(spark, path)
    size = F.size("timestamps")
    c = F.col("connection")
    broken = stored.withColumns(
        {
            "connection": F.when(
                F.pmod(size, F.lit(7)) == 3, c.withField("sport", F.lit(70_000))
            ).otherwise(c),
            "sizes": F.when(
                F.pmod(size, F.lit(5)) == 2, F.slice("sizes", F.lit(1), size - 1)
            ).otherwise(F.col("sizes")),
            "directions": F.when(
                F.pmod(size, F.lit(11)) == 4,
                F.transform("directions", lambda d: F.lit(2).cast("tinyint")),
            ).otherwise(F.col("directions")),
        }
    )
    faults = validate.raw_connection_violations(broken)
    found = faults.groupBy(F.col("rule").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    counts = summary.raw_connection_counts(stored)
    totals = {"connections": F.count(F.lit(1)), "packets": F.coalesce(F.sum("packets"), F.lit(0))}
    found = found.select(F.lit("violation").alias("kind"), "name", "n")
    for name, total in totals.items():
        found = found.unionByName(
            counts.agg(total.alias("n")).select(
                F.lit("rows").alias("kind"), F.lit(name).alias("name"), "n"
            )
        )
    return found


@_register(
    "published_tables",
    f"""WITH {WINDOWED_SQL},
held AS (
  SELECT capture_id, flow_id, window_index, count(*) AS n FROM windowed GROUP BY 1, 2, 3
  HAVING count(*) > {MINIMUM})
SELECT {category_sql("capture_id")} AS category, count(*) AS windows,
  CAST(sum(n) AS BIGINT) AS packets, count(*) AS vectors FROM held GROUP BY 1""",
)
def published_query(spark: SparkSession, folder: str) -> DataFrame:
    """Windows and features published, checked against their manifests and read."""
    held = windows.observation_windows(
        assigned(spark, folder), window_seconds=WINDOW, minimum_packets=MINIMUM
    )
    base = scratch_path(spark, "published")
    window_path, feature_path = f"{base}/windows.parquet", f"{base}/features.parquet"
    tables.export_windows(
        held, packets(spark, folder), window_path, window_seconds=WINDOW, minimum_packets=MINIMUM
    )
    stored = artifacts.read_windows(spark, window_path)
    vectors = features.feature_vectors(
        windows.packets_of_windows(stored),
        window_seconds=WINDOW,
        bin_seconds=BIN,
        activity_timeout=ACTIVITY,
        minimum_packets=MINIMUM,
    )
    tables.export_features(vectors, feature_path, configuration={"window_seconds": WINDOW})
    read = artifacts.read_features(spark, feature_path)
    own = stored.groupBy("category").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("packet_count").alias("packets")
    )
    return own.join(read.groupBy("category").agg(F.count(F.lit(1)).alias("vectors")), "category")


@_register(
    "split_manifest",
    f"""WITH {ROWS_SQL}
SELECT capture_id, partition, vpn_status, application, category, windows FROM assignments""",
)
def split_manifest_query(spark: SparkSession, folder: str) -> DataFrame:
    """A split published and read back after its contract checks."""
    path = f"{scratch_path(spark, 'split')}/split.json"
    tables.export_split_manifest(assignments(spark, folder), path, source_sha256="", seeds=1)
    return artifacts.read_split_manifest(spark, path)


@_register(
    "partitioned_features",
    f"""WITH {ROWS_SQL}
SELECT window_id, capture_id, r.vpn_status, r.application, r.category, partition,
  {len(FEATURE_COLUMNS)}::INTEGER AS features
FROM window_rows r JOIN assignments a USING (capture_id)""",
)
def partitioned_query(spark: SparkSession, folder: str) -> DataFrame:
    """Features and a split published, checked row by row and loaded together."""
    base = scratch_path(spark, "partitioned")
    vectors = features.feature_vectors(
        windows.window_packets(assigned(spark, folder), WINDOW),
        window_seconds=WINDOW,
        bin_seconds=BIN,
        activity_timeout=ACTIVITY,
        minimum_packets=MINIMUM,
    )
    feature_path, split_path = f"{base}/features.parquet", f"{base}/split.json"
    tables.export_features(vectors, feature_path, configuration={"window_seconds": WINDOW})
    tables.export_split_manifest(assignments(spark, folder), split_path, source_sha256="", seeds=1)
    loaded = artifacts.load_partitioned_features(spark, feature_path, split_path)
    return loaded.withColumn("features", F.size("features"))


@_register(
    "parsed_events",
    """SELECT user_id::VARCHAR AS run_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence,
  event_type AS kind, CAST(floor(value * 10) AS BIGINT) AS level FROM events""",
)
def parsed_query(spark: SparkSession, folder: str) -> DataFrame:
    """Event payloads parsed back into columns."""
    return history.parsed_payloads(events(spark, folder), "kind string, level bigint").select(
        "run_id", F.col("sequence").cast("bigint").alias("sequence"), "payload.kind", "payload.level"
    )


@_register(
    "run_lookup",
    f"""WITH {changes_sql(REPLAY)}, {EVENTS_SQL}
SELECT l.run_id, s.state, l.sequence, l.payload_json FROM log l JOIN sessions s USING (run_id)
WHERE l.run_id = '7'""",
)
def lookup_query(spark: SparkSession, folder: str) -> DataFrame:
    """One session with its events."""
    session = history.get_session(history.upsert_sessions(changes(spark, folder, REPLAY)), "7")
    own = history.run_events(events(spark, folder), "7")
    return own.join(session.select("run_id", "state"), "run_id").select(
        "run_id", "state", F.col("sequence").cast("bigint").alias("sequence"), "payload_json"
    )


_TRIGGER = 500


@_register(
    "run_metrics",
    f"""WITH steps AS (
  SELECT event_id // {_TRIGGER} AS step, count(*) AS packets,
    count(*) FILTER (WHERE event_id % 10 = 0) AS events,
    sum(CAST(floor(value * 10) AS BIGINT)) / 10000.0::DOUBLE AS seconds
  FROM events GROUP BY 1),
sums AS (
  SELECT coalesce(sum(packets) FILTER (WHERE step % 7 <> 6), 0)::BIGINT AS packets_processed,
    sum(events)::BIGINT AS events_emitted,
    (max(step) + 0.5 - min(step))::DOUBLE AS elapsed_seconds,
    coalesce(sum(seconds) FILTER (WHERE step % 7 <> 6), 0) AS busy,
    coalesce(max(seconds) FILTER (WHERE step % 7 <> 6), 0) AS worst,
    coalesce(sum(seconds) FILTER (WHERE step % 7 = 6), 0) AS closing FROM steps)
SELECT packets_processed, events_emitted, elapsed_seconds,
  round(packets_processed / elapsed_seconds, 6) AS packet_rate_per_second,
  round(events_emitted / elapsed_seconds, 6) AS event_rate_per_second,
  round(busy / packets_processed * 1000, 6) AS mean_processing_latency_ms,
  round(worst * 1000, 6) AS max_processing_latency_ms,
  round(closing * 1000, 6) AS finalization_latency_ms,
  round((busy + closing) * 1000, 6) AS total_pipeline_processing_ms FROM sums""",
)
def run_metric_query(spark: SparkSession, folder: str) -> DataFrame:
    """Rates and latencies of a run whose triggers are blocks of events."""
    step = F.floor(F.col("event_id") / _TRIGGER)
    progress = (
        table(spark, folder, "events")
        .groupBy(step.alias("step"))
        .agg(
            F.count(F.lit(1)).alias("packets"),
            F.count_if(F.pmod("event_id", F.lit(10)) == 0).alias("events"),
            (F.sum(F.floor(F.col("value") * 10).cast("bigint")) / F.lit(10_000.0)).alias(
                "processing_seconds"
            ),
        )
        .withColumns(
            {
                "finalization": F.pmod("step", F.lit(7)) == 6,
                "started_seconds": F.col("step").cast("double"),
                "ended_seconds": F.col("step") + F.lit(0.5),
            }
        )
    )
    found = summary.run_summary(progress)
    exact = ("packets_processed", "events_emitted", "elapsed_seconds")
    return found.select(
        *[c if c in exact else F.round(c, 6).alias(c) for c in found.columns]
    )


_WIDTH = 64


def _step_layers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Fixed weights: rectified steps between neighbours, then sums of two."""
    steps = np.eye(_WIDTH, dtype=np.float32) - np.roll(np.eye(_WIDTH, dtype=np.float32), 1, axis=1)
    pairs = np.repeat(np.eye(_WIDTH // 2, dtype=np.float32), 2, axis=1)
    return [(w, np.zeros(len(w), np.float32)) for w in (steps, pairs)]


@_register(
    "embedded_vectors",
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::FLOAT) AS x FROM embeddings),
y AS (SELECT vec_id, list_transform(range(1, {_WIDTH + 1}),
    lambda i: greatest(x[i] - x[i % {_WIDTH} + 1], 0::FLOAT)) AS y FROM e)
SELECT vec_id, j::INTEGER AS i, greatest(y[2 * j + 1] + y[2 * j + 2], 0::FLOAT)::DOUBLE AS value
FROM y, (SELECT unnest(range(0, {_WIDTH // 2})) AS j)""",
)
def embedded_query(spark: SparkSession, folder: str) -> DataFrame:
    """Forward pass of a frozen network over all vectors."""
    found = model.embed(table(spark, folder, "embeddings"), _step_layers(), vector="embedding", name="out")
    return found.select("vec_id", F.posexplode("out").alias("i", "value")).withColumn(
        "value", F.col("value").cast("double")
    )
