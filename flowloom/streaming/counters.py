"""Counters taken inside a run: no second pass over its rows.

:func:`observed` attaches counters to a plan; Spark works them out in the tasks that
run it anyway and reports them once per action or trigger.  :class:`CounterLog` keeps
those of streams, one row per query, trigger and counter.  A trigger that failed
reports nothing and one that is run again reports under its old number, so logs of
several starts of a query, put together by :func:`counted_once`, count each trigger
once.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_LOG = "query_id string, batch_id bigint, name string, counter string, value double, ended double"


def frame_counters() -> dict[str, Column]:
    """Received, decoded, ignored and invalid frames, by their decode status."""
    status = F.col("status")
    return {
        "frames_received": F.count(F.lit(1)),
        "packets_decoded": F.count_if(status == "decoded"),
        "non_ipv4_frames": F.count_if(status == "non_ipv4"),
        "invalid_frames": F.count_if(status == "invalid"),
    }


def packet_counters() -> dict[str, Column]:
    """Packets, their bytes and the time they span."""
    return {
        "packets": F.count(F.lit(1)),
        "bytes": F.coalesce(F.sum("size"), F.lit(0)),
        "first_seconds": F.min("timestamp_seconds"),
        "last_seconds": F.max("timestamp_seconds"),
    }


def observed(
    rows: DataFrame, name: str | Observation, counters: Mapping[str, Column]
) -> DataFrame:
    """The rows, whose counters are reported when they are worked out.

    Streams take a name, under which a :class:`CounterLog` finds them; a batch takes
    an ``Observation``, whose ``get`` has them after the action.
    """
    return rows.observe(name, *(value.alias(key) for key, value in counters.items()))


class CounterLog(StreamingQueryListener):
    """Keeps the counters of every trigger of the streams that run inside it."""

    def __init__(self, spark: SparkSession):
        self.spark, self._rows = spark, []

    def __enter__(self) -> CounterLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self._settle()
        self.spark.streams.removeListener(self)

    def _settle(self) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()

    def onQueryStarted(self, event) -> None:
        """Nothing to keep."""

    def onQueryIdle(self, event) -> None:
        """Nothing to keep."""

    def onQueryTerminated(self, event) -> None:
        """Nothing to keep."""

    def onQueryProgress(self, event) -> None:
        """Keep the trigger's counters."""
        progress = event.progress
        for name, row in (progress.observedMetrics or {}).items():
            for counter, value in row.asDict().items():
                kept = None if value is None else float(value)
                self._rows.append(
                    (str(progress.id), progress.batchId, name, counter, kept, time.time())
                )

    def rows(self) -> DataFrame:
        """``query_id, batch_id, name, counter, value, ended`` so far."""
        self._settle()
        return self.spark.createDataFrame(self._rows, _LOG)

    def store(self, path: str) -> None:
        """Add what was counted to a table that outlives the session."""
        self.rows().coalesce(1).write.mode("append").parquet(path)


def counted_once(log: DataFrame) -> DataFrame:
    """``query_id, batch_id, name`` and a column per counter: the last report counts."""
    last = log.groupBy("query_id", "batch_id", "name", "counter").agg(
        F.max_by("value", "ended").alias("value")
    )
    return last.groupBy("query_id", "batch_id", "name").pivot("counter").agg(F.first("value"))
