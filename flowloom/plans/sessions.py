"""Registered queries on session and event history, with SQL twins.

Orders are read as the change log of sessions (one session per customer) and
events as the prediction events of runs (one run per user).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.labels import fingerprint
from flowloom.operators import history, summary
from flowloom.plans.settings import WINDOW, table

QUERIES = {}
SQL = {}
RETENTION = 20


def _register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def _states(names: tuple[str, ...]) -> Column:
    return F.element_at(
        F.array(*[F.lit(n) for n in names]),
        (F.pmod("o_orderkey", F.lit(len(names))) + 1).cast("int"),
    )


def changes(spark: SparkSession, folder: str, states: tuple[str, ...]) -> DataFrame:
    """Session changes: state cycles with the order key, some failures lack details."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("run_id"),
        key.alias("change_seq"),
        _states(states).alias("state"),
        F.when((_states(states) == "failed") & (F.pmod(key, F.lit(7)) != 1), F.lit("stopped")).alias(
            "failure_code"
        ),
        F.when(
            (_states(states) == "failed") | (F.pmod(key, F.lit(11)) == 2),
            F.concat(F.lit("change "), key),
        ).alias("failure_message"),
    )


REPLAY = tuple(history.REPLAY_TRANSITIONS)
LIVE = tuple(history.LIVE_TRANSITIONS)


def changes_sql(states: tuple[str, ...]) -> str:
    """SQL twin of :func:`changes`."""
    state = f"([{', '.join(repr(s) for s in states)}])[(o_orderkey % {len(states)}) + 1]"
    return f"""stated AS (SELECT *, {state} AS state FROM orders),
changes AS (
  SELECT o_custkey::VARCHAR AS run_id, o_orderkey AS change_seq, state,
    CASE WHEN state = 'failed' AND o_orderkey % 7 <> 1 THEN 'stopped' END AS failure_code,
    CASE WHEN state = 'failed' OR o_orderkey % 11 = 2 THEN 'change ' || o_orderkey END
      AS failure_message
  FROM stated),
sessions AS (
  SELECT run_id, min(change_seq) AS created_seq, max(change_seq) AS updated_seq,
    arg_max(state, change_seq) AS state,
    arg_max({{code: failure_code}}, change_seq).code AS failure_code,
    arg_max({{m: failure_message}}, change_seq).m AS failure_message
  FROM changes GROUP BY 1)"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Event log: one run per user, sequenced by event id."""
    log = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id"),
        F.to_json(
            F.struct(
                F.col("event_type").alias("kind"), F.floor(F.col("value") * 10).alias("level")
            )
        ).alias("payload_json"),
    )
    return history.number_events(log, "event_id").select(
        "run_id", F.col("sequence").cast("bigint").alias("sequence"), "payload_json"
    )


EVENTS_SQL = """log AS (
  SELECT user_id::VARCHAR AS run_id,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence,
    '{"kind":"' || event_type || '","level":' || CAST(floor(value * 10) AS BIGINT) || '}'
      AS payload_json
  FROM events)"""


@_register("session_upsert", f"WITH {changes_sql(REPLAY)} SELECT * FROM sessions")
def upsert_query(spark: SparkSession, folder: str) -> DataFrame:
    return history.upsert_sessions(changes(spark, folder, REPLAY))


@_register(
    "session_list",
    f"""WITH {changes_sql(REPLAY)} SELECT run_id, created_seq, state FROM sessions
ORDER BY created_seq DESC LIMIT 100""",
)
def list_query(spark: SparkSession, folder: str) -> DataFrame:
    found = history.upsert_sessions(changes(spark, folder, REPLAY))
    return history.list_sessions(found).select("run_id", "created_seq", "state")


@_register(
    "session_counters",
    f"""WITH {changes_sql(REPLAY)}
SELECT count(*) AS total, count(*) FILTER (WHERE state IN ('created', 'running', 'paused'))
  AS active FROM sessions""",
)
def counter_query(spark: SparkSession, folder: str) -> DataFrame:
    found = history.upsert_sessions(changes(spark, folder, REPLAY))
    return summary.session_counters(found, history.REPLAY_ACTIVE)


_HIT = "state IN ('starting', 'running', 'stopping')"


@_register(
    "interrupted_sessions",
    f"""WITH {changes_sql(LIVE)}
SELECT run_id, created_seq, updated_seq, {_HIT} AS changed,
  CASE WHEN {_HIT} THEN 'failed' ELSE state END AS state,
  CASE WHEN {_HIT} THEN '{history.RESTART_CODE}' ELSE failure_code END AS failure_code,
  CASE WHEN {_HIT} THEN '{history.RESTART_MESSAGE}' ELSE failure_message END AS failure_message
FROM sessions""",
)
def interrupted_query(spark: SparkSession, folder: str) -> DataFrame:
    return history.fail_interrupted(history.upsert_sessions(changes(spark, folder, LIVE)))


@_register(
    "session_snapshot",
    f"""WITH {changes_sql(REPLAY)}, {EVENTS_SQL},
counted AS (SELECT run_id, max(sequence) AS n FROM log GROUP BY 1)
SELECT run_id, created_seq, state, coalesce(n, 0) AS event_count,
  least(coalesce(n, 0), {RETENTION}) AS retained_event_count,
  CASE WHEN failure_message IS NOT NULL THEN failure_code END AS shown_code,
  CASE WHEN failure_code IS NOT NULL THEN failure_message END AS shown_message
FROM sessions LEFT JOIN counted USING (run_id)""",
)
def snapshot_query(spark: SparkSession, folder: str) -> DataFrame:
    found = history.session_snapshot(
        history.upsert_sessions(changes(spark, folder, REPLAY)), events(spark, folder), RETENTION
    )
    return found.select(
        "run_id",
        "created_seq",
        "state",
        "event_count",
        F.col("retained_event_count").cast("bigint").alias("retained_event_count"),
        F.col("failure.code").alias("shown_code"),
        F.col("failure.message").alias("shown_message"),
    )


@_register(
    "lifecycle_violations",
    f"""WITH {changes_sql(REPLAY)},
ordered AS (
  SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY change_seq) AS before FROM changes),
fired AS (
  SELECT *, unnest(list_filter([
    CASE WHEN before IS NOT NULL AND before || '>' || state NOT IN ({", ".join(
        repr(f"{a}>{b}") for a, t in history.REPLAY_TRANSITIONS.items() for b in t)})
      THEN 'transition' END,
    CASE WHEN before IS NULL AND state <> 'created' THEN 'first_state' END,
    CASE WHEN state = 'failed' AND (failure_code IS NULL OR failure_message IS NULL)
      THEN 'failure_missing' END,
    CASE WHEN state <> 'failed' AND (failure_code IS NOT NULL OR failure_message IS NOT NULL)
      THEN 'failure_unexpected' END], lambda r: r IS NOT NULL)) AS rule
  FROM ordered)
SELECT rule, run_id || ':' || change_seq AS key, coalesce(before, '') || '>' || state AS detail
FROM fired""",
)
def lifecycle_query(spark: SparkSession, folder: str) -> DataFrame:
    return history.lifecycle_violations(
        changes(spark, folder, REPLAY), history.REPLAY_TRANSITIONS
    )


@_register("event_sequence", f"WITH {EVENTS_SQL} SELECT * FROM log")
def sequence_query(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder)


@_register(
    "event_retention",
    f"""WITH {EVENTS_SQL}
SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC)
  <= {RETENTION}""",
)
def retention_query(spark: SparkSession, folder: str) -> DataFrame:
    return history.retained_events(events(spark, folder), RETENTION)


@_register(
    "latest_event",
    f"""WITH {EVENTS_SQL}
SELECT run_id, max(sequence) AS sequence, arg_max(payload_json, sequence) AS payload_json
FROM log GROUP BY 1""",
)
def latest_query(spark: SparkSession, folder: str) -> DataFrame:
    return history.latest_events(events(spark, folder))


@_register(
    "session_events",
    f"""WITH {changes_sql(REPLAY)}, {EVENTS_SQL}
SELECT (run_id IN (SELECT run_id FROM sessions)) AS has_session, count(*) AS events
FROM log GROUP BY 1""",
)
def session_event_query(spark: SparkSession, folder: str) -> DataFrame:
    found = history.upsert_sessions(changes(spark, folder, REPLAY))
    log = events(spark, folder)
    kept = history.session_events(found, log).select(F.lit(True).alias("has_session"))
    orphaned = history.orphan_events(found, log).select(F.lit(False).alias("has_session"))
    return kept.unionByName(orphaned).groupBy("has_session").agg(
        F.count(F.lit(1)).alias("events")
    )


# Cursors run from before the log to past its end.
_CURSOR_SQL = f"""cursors AS (
  SELECT DISTINCT user_id::VARCHAR AS run_id, (user_id * 7) % 90 - 1 AS after_sequence
  FROM events),
bounds AS (
  SELECT run_id, max(sequence) AS last, greatest(max(sequence) - {RETENTION} + 1, 1) AS first
  FROM log GROUP BY 1)"""


def _cursors(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, folder, "events").select(
        user.cast("string").alias("run_id"),
        (F.pmod(user * 7, F.lit(90)) - 1).alias("after_sequence"),
    ).distinct()


@_register(
    "event_cursor",
    f"""WITH {EVENTS_SQL}, {_CURSOR_SQL}
SELECT l.*, c.after_sequence FROM log l JOIN cursors c USING (run_id) JOIN bounds b USING (run_id)
WHERE l.sequence > c.after_sequence AND l.sequence >= b.first""",
)
def cursor_query(spark: SparkSession, folder: str) -> DataFrame:
    return history.events_after(events(spark, folder), _cursors(spark, folder), RETENTION)


@_register(
    "cursor_violations",
    f"""WITH {EVENTS_SQL}, {_CURSOR_SQL},
fired AS (
  SELECT run_id, after_sequence, unnest(list_filter([
    CASE WHEN after_sequence < 0 THEN 'cursor_negative' END,
    CASE WHEN after_sequence > last THEN 'cursor_ahead' END,
    CASE WHEN after_sequence >= 0 AND after_sequence < first - 1 THEN 'cursor_not_retained' END],
    lambda r: r IS NOT NULL)) AS rule FROM cursors JOIN bounds USING (run_id))
SELECT rule, run_id AS key, after_sequence::VARCHAR AS detail FROM fired""",
)
def cursor_violation_query(spark: SparkSession, folder: str) -> DataFrame:
    return history.cursor_violations(events(spark, folder), _cursors(spark, folder), RETENTION)


_SHA = "sha256(user_id::VARCHAR)"


@_register(
    "event_payload",
    f"""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'unavailable'
    ELSE substr({_SHA}, 1, 12) END AS model,
  '{{"classification":{{"category_order":["VOIP","CHAT"],"class_probabilities":[0.25,0.75],'
  || '"predicted_category":"CHAT","predicted_class_index":1,"raw_confidence":0.75}},'
  || '"provenance":{{"calibration_artifact_sha256":"c","feature_artifact_sha256":"f",'
  || '"model_bundle_sha256":"' || {_SHA} || '","split_manifest_sha256":"s"}},'
  || '"run_id":"' || user_id || '","schema_version":"runtime-prediction-1",'
  || '"uncertainty":{{"ood_score":0.5,"relative_mahalanobis_distance":-1.5}},'
  || '"window":{{"capture_id":"' || event_type || '","end_offset_seconds":'
  || ((event_id % 5 + 1) * {int(WINDOW)})::VARCHAR || '.0,"flow_id":"x","packet_count":'
  || (event_id % 9)::VARCHAR || ',"start_offset_seconds":'
  || ((event_id % 5) * {int(WINDOW)})::VARCHAR || '.0,"window_id":"' || event_type || ':x:'
  || (event_id % 5)::VARCHAR || '","window_index":' || (event_id % 5)::VARCHAR || '}}}}'
  AS payload_json
FROM events""",
)
def payload_query(spark: SparkSession, folder: str) -> DataFrame:
    index = F.pmod("event_id", F.lit(5))
    sha = F.sha2(F.col("user_id").cast("string"), 256)
    rows = table(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.array(F.lit(0.25), F.lit(0.75)).alias("class_probabilities"),
        F.lit("CHAT").alias("predicted"),
        F.lit(1).alias("predicted_index"),
        F.lit(0.75).alias("raw_confidence"),
        F.lit("c").alias("calibration_sha256"),
        F.lit("f").alias("feature_sha256"),
        sha.alias("model_sha256"),
        F.lit("s").alias("split_sha256"),
        F.col("user_id").cast("string").alias("run_id"),
        F.lit(0.5).alias("ood_score"),
        F.lit(-1.5).alias("relative_distance"),
        F.col("event_type").alias("capture_id"),
        ((index + 1) * F.lit(WINDOW)).alias("end_offset_seconds"),
        F.lit("x").alias("flow_id"),
        F.pmod("event_id", F.lit(9)).alias("packet_count"),
        (index * F.lit(WINDOW)).alias("start_offset_seconds"),
        F.concat_ws(":", F.col("event_type"), F.lit("x"), index.cast("string")).alias("window_id"),
        index.alias("window_index"),
    )
    shown = F.when(F.pmod("user_id", F.lit(4)) != 0, F.col("model_sha256"))
    return rows.select(
        "event_id",
        fingerprint(shown).alias("model"),
        history.prediction_payload(("VOIP", "CHAT")).alias("payload_json"),
    )
