"""Packets written as classic capture files, one file per capture."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.sources.ranges import RAW_IP_LINK

# Magic number of nanosecond files, format version, longest body.
_NANO, _VERSION, _SNAP = 0xA1B23C4D, (2, 4), 262_144
_WRITTEN = "path string, packets bigint, bytes bigint"


def _target(path: str):
    """File system and inner path of a target."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_captures(records: DataFrame, folder: str) -> DataFrame:
    """Write ``capture_id, packet_number, ticks, raw`` as files; ``path, packets, bytes``.

    ``ticks`` are whole nanoseconds.  A capture's packets are written in order of
    their number by one task, which holds one batch of them; the file appears under
    its name when it is complete, and a task that runs again writes it again.
    """
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        done: list[tuple] = []
        current = stream = system = inner = None
        packets = size = 0

        def finish() -> None:
            stream.close()
            system.move(f"{inner}.{attempt}.tmp", inner)
            done.append((f"{root}/{current}", packets, size))

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("capture_id", "ticks", "raw"))
            for capture, ticks, raw in zip(*columns, strict=True):
                if capture != current:
                    if current is not None:
                        finish()
                    current, packets, size = capture, 0, 24
                    system, inner = _target(f"{root}/{capture}")
                    stream = system.open_output_stream(f"{inner}.{attempt}.tmp")
                    stream.write(struct.pack("<IHHiIII", _NANO, *_VERSION, 0, 0, _SNAP, RAW_IP_LINK))
                seconds, part = divmod(ticks, 1_000_000_000)
                stream.write(struct.pack("<IIII", seconds, part, len(raw), len(raw)) + raw)
                packets, size = packets + 1, size + 16 + len(raw)
        if current is not None:
            finish()
        columns = zip(*done, strict=True) if done else ((), (), ())
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
            names=["path", "packets", "bytes"],
        )

    system, inner = _target(root)
    system.create_dir(inner, recursive=True)
    ordered = (
        records.where(F.col("capture_id").isNotNull())
        .select("capture_id", "packet_number", "ticks", "raw")
        .repartition("capture_id")
        .sortWithinPartitions("capture_id", "packet_number")
    )
    return ordered.drop("packet_number").mapInArrow(run, _WRITTEN)
