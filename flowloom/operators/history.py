"""Session and event history kept as change logs and event tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.ordered import number_rows, previous_value
from flowloom.operators.validate import broken_rules
from flowloom.schemas import CHUNK_ROWS, EVENT_RETENTION, PREDICTION_EVENT_VERSION

# Allowed next states of replay and live sessions.
REPLAY_TRANSITIONS: Mapping[str, tuple[str, ...]] = {
    "created": ("running", "failed", "cancelled"),
    "running": ("paused", "completed", "failed", "cancelled"),
    "paused": ("running", "failed", "cancelled"),
    "completed": (),
    "failed": (),
    "cancelled": (),
}
LIVE_TRANSITIONS: Mapping[str, tuple[str, ...]] = {
    "starting": ("running", "stopping", "failed"),
    "running": ("stopping", "failed"),
    "stopping": ("completed", "failed"),
    "completed": (),
    "failed": (),
}
REPLAY_ACTIVE = ("created", "running", "paused")
LIVE_ACTIVE = ("starting", "running", "stopping")
# Failure recorded for a live session cut off by a restart.
RESTART_CODE = "operator_restart"
RESTART_MESSAGE = "operator process restarted before the live session reached a terminal state"


def number_events(
    events: DataFrame, order: str, *, run: str = "run_id", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Give each event of a run its 1-based ``sequence``."""
    return number_rows(events, [run], order, "sequence", chunk_rows=chunk_rows)


def upsert_sessions(changes: DataFrame, *, change: str = "change_seq") -> DataFrame:
    """Latest state of every run and the change that created it.

    Aggregates combine map-side, so a run with many changes stays cheap.
    """
    carried = [c for c in changes.columns if c not in ("run_id", change)]
    return (
        changes.groupBy("run_id")
        .agg(
            F.min(change).alias("created_seq"),
            F.max(change).alias("updated_seq"),
            F.max_by(F.struct(*carried), change).alias("_latest"),
        )
        .select("run_id", "created_seq", "updated_seq", "_latest.*")
    )


def get_session(sessions: DataFrame, run_id: str) -> DataFrame:
    """The one session of a run id (empty when unknown)."""
    return sessions.where(F.col("run_id") == run_id)


def list_sessions(sessions: DataFrame, limit: int = 100) -> DataFrame:
    """Newest sessions first."""
    if limit < 1:
        raise ValueError(f"a history shows one session or more, not {limit}")
    return sessions.orderBy(F.desc("created_seq")).limit(limit)


def fail_interrupted(sessions: DataFrame) -> DataFrame:
    """Live sessions left in a running state become failed; ``changed`` marks them."""
    hit = F.col("state").isin(*LIVE_ACTIVE)
    return sessions.withColumns(
        {
            "changed": hit,
            "failure_code": F.when(hit, F.lit(RESTART_CODE)).otherwise(F.col("failure_code")),
            "failure_message": F.when(hit, F.lit(RESTART_MESSAGE)).otherwise(
                F.col("failure_message")
            ),
            "state": F.when(hit, F.lit("failed")).otherwise(F.col("state")),
        }
    )


def failure_details() -> Column:
    """Failure struct, null unless both parts are present."""
    code, message = F.col("failure_code"), F.col("failure_message")
    return F.when(
        code.isNotNull() & message.isNotNull(), F.struct(code.alias("code"), message.alias("message"))
    )


def run_events(events: DataFrame, run_id: str) -> DataFrame:
    """Events of one run in sequence order."""
    return events.where(F.col("run_id") == run_id).orderBy("sequence")


def parsed_payloads(events: DataFrame, schema: str) -> DataFrame:
    """Events with their payload as a struct; null where it is no such JSON."""
    return events.withColumn("payload", F.from_json("payload_json", schema))


def payload_violations(parsed: DataFrame) -> DataFrame:
    """Events whose payload could not be parsed."""
    key = F.concat_ws(":", F.col("run_id"), F.col("sequence"))
    return broken_rules(parsed, key, {"payload_unreadable": F.col("payload").isNull()})


def session_events(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Events whose session exists."""
    return events.join(sessions.select("run_id"), "run_id", "left_semi")


def orphan_events(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Events left behind by a removed session."""
    return events.join(sessions.select("run_id"), "run_id", "left_anti")


def retained_events(events: DataFrame, retention: int = EVENT_RETENTION) -> DataFrame:
    """Last ``retention`` events of every run.

    Sequences of a run have no holes, so the cut is a comparison with the run's
    last sequence instead of a ranking of the run's events.
    """
    if retention < 1:
        raise ValueError("one event or more has to be kept")
    last = events.groupBy("run_id").agg(F.max("sequence").alias("_last"))
    return (
        events.join(last, "run_id")
        .where(F.col("sequence") > F.col("_last") - retention)
        .drop("_last")
    )


def event_bounds(events: DataFrame, retention: int = EVENT_RETENTION) -> DataFrame:
    """Last sequence and first retained sequence of every run."""
    return events.groupBy("run_id").agg(
        F.max("sequence").alias("last_sequence"),
        F.greatest(F.max("sequence") - F.lit(retention) + 1, F.lit(1)).alias("first_sequence"),
    )


def events_after(
    events: DataFrame, cursors: DataFrame, retention: int = EVENT_RETENTION
) -> DataFrame:
    """Retained events after each run's cursor (``run_id, after_sequence``)."""
    return (
        retained_events(events, retention)
        .join(cursors, "run_id")
        .where(F.col("sequence") > F.col("after_sequence"))
    )


def cursor_violations(
    events: DataFrame, cursors: DataFrame, retention: int = EVENT_RETENTION
) -> DataFrame:
    """Cursors that are negative, ahead of the run, or no longer retained."""
    bounds = event_bounds(events, retention)
    placed = cursors.join(bounds, "run_id", "left").withColumn(
        "last", F.coalesce("last_sequence", F.lit(0))
    )
    after = F.col("after_sequence")
    return broken_rules(
        placed,
        F.col("run_id"),
        {
            "cursor_negative": after < 0,
            "cursor_ahead": after > F.col("last"),
            "cursor_not_retained": (after >= 0) & (after < F.col("first_sequence") - 1),
        },
        after,
    )


def latest_events(events: DataFrame) -> DataFrame:
    """Last event of every run."""
    return events.groupBy("run_id").agg(
        F.max("sequence").alias("sequence"),
        F.max_by("payload_json", "sequence").alias("payload_json"),
    )


def session_snapshot(
    sessions: DataFrame, events: DataFrame, retention: int = EVENT_RETENTION
) -> DataFrame:
    """Sessions with event count, retained count and failure details."""
    counts = events.groupBy("run_id").agg(F.max("sequence").alias("event_count"))
    total = F.coalesce("event_count", F.lit(0)).cast("bigint")
    return (
        sessions.drop("event_count")
        .join(counts, "run_id", "left")
        .withColumn("event_count", total)
        .withColumn("retained_event_count", F.least(F.col("event_count"), F.lit(retention)))
        .withColumn("failure", failure_details())
    )


def lifecycle_violations(
    changes: DataFrame,
    transitions: Mapping[str, tuple[str, ...]],
    *,
    change: str = "change_seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """State changes a session may not make, and failure details out of place."""
    ordered = previous_value(
        changes, ["run_id"], change, "state", "_before", chunk_rows=chunk_rows
    )
    allowed = F.array(
        *[F.lit(f"{a}>{b}") for a, targets in transitions.items() for b in targets]
    )
    step = F.concat_ws(">", "_before", "state")
    details = F.col("failure_code").isNotNull() & F.col("failure_message").isNotNull()
    partial = F.col("failure_code").isNotNull() | F.col("failure_message").isNotNull()
    return broken_rules(
        ordered,
        F.concat_ws(":", F.col("run_id"), F.col(change)),
        {
            "state_unknown": F.col("state").isNull() | ~F.col("state").isin(*transitions),
            "transition": F.col("_before").isNotNull() & ~F.array_contains(allowed, step),
            "first_state": F.col("_before").isNull()
            & (F.col("state") != F.lit(next(iter(transitions)))),
            "failure_missing": (F.col("state") == "failed") & ~details,
            "failure_unexpected": (F.col("state") != "failed") & partial,
        },
        F.concat_ws(">", F.coalesce("_before", F.lit("")), F.col("state")),
    )


def prediction_payload(labels: tuple[str, ...]) -> Column:
    """Compact JSON of a prediction row; struct fields are declared in key order."""
    return F.to_json(
        F.struct(
            F.struct(
                F.array(*[F.lit(v) for v in labels]).alias("category_order"),
                "class_probabilities",
                F.col("predicted").alias("predicted_category"),
                F.col("predicted_index").alias("predicted_class_index"),
                "raw_confidence",
            ).alias("classification"),
            F.struct(
                F.col("calibration_sha256").alias("calibration_artifact_sha256"),
                F.col("feature_sha256").alias("feature_artifact_sha256"),
                F.col("model_sha256").alias("model_bundle_sha256"),
                F.col("split_sha256").alias("split_manifest_sha256"),
            ).alias("provenance"),
            "run_id",
            F.lit(PREDICTION_EVENT_VERSION).alias("schema_version"),
            F.struct(
                "ood_score", F.col("relative_distance").alias("relative_mahalanobis_distance")
            ).alias("uncertainty"),
            F.struct(
                "capture_id",
                "end_offset_seconds",
                "flow_id",
                "packet_count",
                "start_offset_seconds",
                "window_id",
                "window_index",
            ).alias("window"),
        )
    )


def replay_schedule(packets: DataFrame, time_scale: float | None = 1.0) -> DataFrame:
    """Source and scheduled offsets of each packet; no time scale means no delay."""
    if time_scale is not None and not 0.0 < time_scale < float("inf"):
        raise ValueError("a replay runs at a positive, finite speed")
    origins = packets.groupBy("capture_id").agg(
        F.min_by("timestamp_seconds", "packet_number").alias("_origin")
    )
    offset = F.col("timestamp_seconds") - F.col("_origin")
    scheduled = F.lit(0.0) if time_scale is None else offset / F.lit(float(time_scale))
    return packets.join(origins, "capture_id").select(
        "capture_id",
        "packet_number",
        F.col("timestamp_seconds").alias("source_timestamp_seconds"),
        offset.alias("source_offset_seconds"),
        scheduled.alias("scheduled_offset_seconds"),
    )
