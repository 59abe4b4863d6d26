"""Packet stream to prediction events: flow, window, feature, score, record.

Each trigger stores its packets, works out which capture windows are complete,
and runs the batch operators over the packets of just those windows.  A
capture's windows complete together when any packet of it enters a later window,
so flows that went silent are closed too.  All state is tables in a shared
folder, one part per trigger; a trigger delivered again rewrites its own parts
from the parts before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.ordered import number_sorted
from flowloom.operators.features import feature_vectors
from flowloom.operators.flows import admit_packets, assign_sessions, capacity_refusals
from flowloom.operators.windows import RELEASE_COMPATIBLE, window_packets, with_bounds
from flowloom.schemas import BIN_SECONDS, MINIMUM_PACKETS, PACKETS, WINDOW_SECONDS
from flowloom.session import cut_lineage
from flowloom.streaming.pipeline import check_stale

_PROGRESS = (
    "capture_id string, capture_origin double, open_index bigint, open_batch bigint, "
    "last_packet bigint, last_seconds double, refused_packet_number bigint, last_sequence bigint"
)
_CARRY = (
    "capture_id string, packet_number bigint, timestamp_seconds double, source_address string, "
    "source_port int, destination_address string, destination_port int, protocol int, size bigint"
)
_FAULTS = "capture_id string, rule string, detail string"


@dataclass
class PredictionRun:
    """One run of the pipeline over a packet stream.

    ``scorer`` turns feature rows into prediction rows; their columns are kept in
    the event table next to ``run_id`` (the capture) and ``sequence``.
    """

    spark: SparkSession
    folder: str
    scorer: Callable[[DataFrame], DataFrame]
    window_seconds: float = WINDOW_SECONDS
    bin_seconds: float = BIN_SECONDS
    minimum_packets: int = MINIMUM_PACKETS
    policy: str = RELEASE_COMPATIBLE
    stale_after_seconds: float | None = None
    max_tracked_flows: int | None = None
    feature_options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_stale(self.stale_after_seconds, self.window_seconds)

    def _part(self, table: str, batch: int) -> str:
        return f"{self.folder.rstrip('/')}/{table}/batch_id={batch}"

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self._part(table, batch))

    def _read(self, table: str, batch: int, schema: str) -> DataFrame:
        """One part of a state table; empty before the first trigger."""
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._part(table, batch))

    def _index(self, seconds: str, origin: str = "capture_origin") -> Column:
        width = F.lit(float(self.window_seconds))
        return F.floor((F.col(seconds) - F.col(origin)) / width).cast("bigint")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        """Process one trigger; the ``foreachBatch`` entry point."""
        self._write(batch.select(*PACKETS.names), "packets", batch_id)
        arrived = self._read("packets", batch_id, _CARRY)
        before = self._read("progress", batch_id - 1, _PROGRESS)
        seen = arrived.groupBy("capture_id").agg(
            F.min_by("timestamp_seconds", "packet_number").alias("first_seconds"),
            F.min("packet_number").alias("first_packet"),
            F.max("packet_number").alias("end_packet"),
            F.max("timestamp_seconds").alias("end_seconds"),
            F.count(F.lit(1)).alias("arrived"),
        )
        joined = cut_lineage(
            before.join(seen, "capture_id", "full")
            .withColumn("origin", F.coalesce("capture_origin", "first_seconds"))
            .withColumn("end_seconds", F.coalesce("end_seconds", "last_seconds"))
            .withColumn("next_index", self._index("end_seconds", "origin"))
            .withColumn("from_index", F.coalesce("open_index", F.lit(0)))
        )
        faults = self._regressions(joined).unionByName(self._late(arrived, joined))
        self._write(faults, "faults", batch_id)
        refused, numbered = self._close(joined, batch_id, batch_id - 1, flush=False)
        moved = F.col("open_index").isNull() | (F.col("next_index") > F.col("open_index"))
        told = joined.drop("refused_packet_number").join(refused, "capture_id", "left")
        progress = told.join(numbered, "capture_id", "left").select(
            "capture_id",
            F.col("origin").alias("capture_origin"),
            F.col("next_index").alias("open_index"),
            F.when(moved, F.lit(batch_id)).otherwise(F.col("open_batch")).cast("bigint").alias(
                "open_batch"
            ),
            F.coalesce("end_packet", "last_packet").alias("last_packet"),
            F.col("end_seconds").alias("last_seconds"),
            "refused_packet_number",
            F.coalesce("numbered", "last_sequence").alias("last_sequence"),
        )
        self._write(progress, "progress", batch_id)

    def finish(self) -> None:
        """Close the windows still open; for a completed run only.

        What is open is read from the stored state, so a process started after
        the one that ran the triggers can close them too.
        """
        last = self._stored_batch()
        if last < 0:
            return
        joined = (
            self._read("progress", last, _PROGRESS)
            .withColumn("origin", F.col("capture_origin"))
            .withColumn("end_seconds", F.col("last_seconds"))
            .withColumn("from_index", F.col("open_index"))
            .withColumn("next_index", F.col("open_index") + 1)
        )
        self._close(cut_lineage(joined), last + 1, last, flush=True)

    def _late(self, arrived: DataFrame, joined: DataFrame) -> DataFrame:
        """Packets whose window was closed in an earlier trigger, one row each."""
        opened = joined.where(F.col("open_index").isNotNull()).select(
            "capture_id", F.col("origin").alias("capture_origin"), "open_index"
        )
        return (
            arrived.join(opened, "capture_id")
            .where(self._index("timestamp_seconds") < F.col("open_index"))
            .select(
                "capture_id",
                F.lit("late_packet").alias("rule"),
                F.col("packet_number").cast("string").alias("detail"),
            )
        )

    def _stored_batch(self) -> int:
        """The last trigger whose progress is stored, also by an earlier process."""
        try:
            parts = self.spark.read.parquet(f"{self.folder.rstrip('/')}/progress")
        except AnalysisException:  # no trigger yet
            return -1
        found = parts.agg(F.max("batch_id")).first()[0]
        return -1 if found is None else int(found)

    @staticmethod
    def _regressions(joined: DataFrame) -> DataFrame:
        """Packets out of order against earlier triggers, and holes in the numbers."""
        late = (F.col("first_packet") <= F.col("last_packet")) | (
            F.col("first_seconds") < F.col("last_seconds")
        )
        hole = (F.col("first_packet") > F.col("last_packet") + 1) | (
            F.col("arrived") != F.col("end_packet") - F.col("first_packet") + 1
        )
        rules = F.array_compact(
            F.array(
                F.when(late, F.lit("packet_regression")), F.when(hole, F.lit("packet_gap"))
            )
        )
        return joined.select(
            "capture_id",
            F.explode(rules).alias("rule"),
            F.concat_ws("..", "first_packet", "end_packet").alias("detail"),
        )

    def _close(self, joined: DataFrame, batch_id: int, state: int, *, flush: bool) -> tuple[DataFrame, DataFrame]:
        """Emit the windows from ``from_index`` up to ``next_index`` of each capture.

        Returns the captures refused for holding too many flows, and the last
        event number of the captures that had events.
        """
        none = self.spark.createDataFrame([], "capture_id string, numbered bigint")
        refused_before = joined.where(F.col("refused_packet_number").isNotNull()).select(
            "capture_id", "refused_packet_number"
        )
        due = joined.where(
            (F.col("next_index") > F.col("from_index")) & F.col("refused_packet_number").isNull()
        ).select(
            "capture_id", "origin", "from_index", "next_index", "open_batch", "last_sequence"
        )
        carried = self._read("flows", state, _CARRY)
        earliest = due.agg(F.min(F.coalesce("open_batch", F.lit(batch_id)))).first()[0]
        if earliest is None:
            self._write(carried, "flows", batch_id)
            return refused_before, none
        stored = (
            self.spark.read.schema(_CARRY + ", batch_id bigint")
            .parquet(f"{self.folder.rstrip('/')}/packets")
            .where(F.col("batch_id").between(earliest, batch_id))
            .drop("batch_id")
        )
        span = due.select("capture_id", F.col("origin").alias("capture_origin"),
                          "from_index", "next_index", "last_sequence")
        pending = (
            stored.join(span, "capture_id")
            .withColumn("_at", self._index("timestamp_seconds"))
            .where((F.col("_at") >= F.col("from_index")) & (F.col("_at") < F.col("next_index")))
            .select(*PACKETS.names, F.lit(False).alias("carried"))
        )
        # A flow seen before is replayed as its last packet in its own direction.
        replayed = carried.join(due.select("capture_id"), "capture_id", "left_semi").select(
            *PACKETS.names, F.lit(True).alias("carried")
        )
        assigned = cut_lineage(
            assign_sessions(replayed.unionByName(pending), self.stale_after_seconds)
        )
        refused = refused_before
        admitted = assigned
        if self.max_tracked_flows is not None:
            fresh = cut_lineage(
                capacity_refusals(assigned, self.stale_after_seconds, self.max_tracked_flows)
            )
            at = fresh.join(span, "capture_id").withColumn("_cut", self._index("refused_seconds"))
            # The run ended inside that window, so only earlier windows came out.
            admitted = (
                admit_packets(assigned, fresh)
                .join(at.select("capture_id", "_cut"), "capture_id", "left")
                .join(span.select("capture_id", "capture_origin"), "capture_id")
                .where(F.col("_cut").isNull() | (self._index("timestamp_seconds") < F.col("_cut")))
                .drop("_cut", "capture_origin")
            )
            refused = refused.unionByName(fresh.select("capture_id", "refused_packet_number"))
        numbered = self._emit(admitted.where(~F.col("carried")), span, batch_id)
        if not flush:
            kept = carried.join(due.select("capture_id"), "capture_id", "left_anti")
            self._write(kept.unionByName(self._carry(assigned, span)), "flows", batch_id)
        return refused, numbered

    def _carry(self, assigned: DataFrame, span: DataFrame) -> DataFrame:
        """Live flows as their last packet, written in the session's direction."""
        last = assigned.groupBy("capture_id", "flow_key").agg(
            F.max("packet_number").alias("packet_number"),
            F.max("timestamp_seconds").alias("timestamp_seconds"),
            F.max_by("connection", "packet_number").alias("c"),
        )
        opens = F.col("capture_origin") + F.col("next_index") * F.lit(float(self.window_seconds))
        live = last.join(span, "capture_id")
        if self.stale_after_seconds is not None:
            live = live.where(
                opens - F.col("timestamp_seconds") < F.lit(float(self.stale_after_seconds))
            )
        return live.select(
            "capture_id",
            "packet_number",
            "timestamp_seconds",
            F.col("c.src").alias("source_address"),
            F.col("c.sport").alias("source_port"),
            F.col("c.dst").alias("destination_address"),
            F.col("c.dport").alias("destination_port"),
            F.col("c.proto").alias("protocol"),
            F.lit(0).cast("bigint").alias("size"),
        )

    def _emit(self, packets: DataFrame, span: DataFrame, batch_id: int) -> DataFrame:
        origins = span.select("capture_id", "capture_origin")
        windowed = window_packets(packets.join(origins, "capture_id"), self.window_seconds)
        vectors = feature_vectors(
            windowed,
            window_seconds=self.window_seconds,
            bin_seconds=self.bin_seconds,
            minimum_packets=self.minimum_packets,
            policy=self.policy,
            labeled=False,
            **self.feature_options,
        )
        ends = windowed.groupBy("capture_id", "flow_id").agg(
            F.first("connection").alias("connection")
        )
        scored = with_bounds(
            self.scorer(vectors).join(ends, ["capture_id", "flow_id"]), self.window_seconds
        )
        ordered = number_sorted(scored, ["capture_id"], ["window_index", "connection"], "_nth")
        events = (
            ordered.join(span.select("capture_id", "last_sequence"), "capture_id")
            .withColumn("run_id", F.col("capture_id"))
            .withColumn(
                "sequence", (F.coalesce("last_sequence", F.lit(0)) + F.col("_nth")).cast("bigint")
            )
            .drop("_nth", "last_sequence", "connection")
        )
        self._write(events, "events", batch_id)
        return (
            self.spark.read.schema("capture_id string, sequence bigint")
            .parquet(self._part("events", batch_id))
            .groupBy("capture_id")
            .agg(F.max("sequence").alias("numbered"))
        )

    def events(self) -> DataFrame:
        """All prediction events so far."""
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/events").drop("batch_id")

    def faults(self) -> DataFrame:
        """Order faults found so far."""
        return self.spark.read.schema(_FAULTS).parquet(f"{self.folder.rstrip('/')}/faults")
