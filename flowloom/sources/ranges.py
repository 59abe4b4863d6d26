"""Record ranges of capture files, found inside the files by many tasks.

A capture file has no marks between its records: where one ends follows from the
header it starts with.  A file is cut into slices of equal length all the same.  Each
slice proposes a place where a record starts: the first one from which a chain of
``CHAIN`` sound headers follows.  A walk over the records from an entry to the first
one that starts behind the slice gives an exit and a count.  The exit is an entry of
the slice it lies in; where that slice was not walked from there, it is, and so on.  Walks that start wrongly, in a body that imitates headers,
soon run into right ones or end, and cost a second look; a record that covers many
slices leads past them at once.  The walks that follow from the first record on are
the file's, whatever was proposed, and a file is done when they reach its end; a
record that reaches beyond the file ends it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.session import cut_lineage

# File magic numbers, header sizes and the raw-IP link type.
MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
}
FILE_HEADER, RECORD_HEADER = 24, 16
RAW_IP_LINK = 101

# Bytes of a slice, and bytes fetched at a time while headers are walked.
RANGE_BYTES = 64 * 1024 * 1024
PIECE_BYTES = 4 * 1024 * 1024
#: Sound headers in a row that make a proposal, and the largest body that is sound.
CHAIN, SOUND_BODY = 12, 256 * 1024
#: Exit of a slice in which the file ends in the middle of a record.
ENDED = -1

_FILES = "path string, length bigint, byte_order string, ticks bigint, fault string"
_FILE_NAMES = [part.split()[0] for part in _FILES.split(", ")]
_FILE_TYPES = [
    pa.int64() if part.endswith("bigint") else pa.string() for part in _FILES.split(", ")
]
_SLICE = (
    "path string, slice bigint, low bigint, high bigint, length bigint, byte_order string, "
    "ticks bigint, entry bigint, exit bigint, records bigint, cut bigint"
)
_SLICE_NAMES = [part.split()[0] for part in _SLICE.split(", ")]
_SLICE_TYPES = [
    pa.int64() if part.endswith("bigint") else pa.string() for part in _SLICE.split(", ")
]
INDEX = (
    "path string, start bigint, stop bigint, first_packet bigint, byte_order string, "
    "ticks bigint, fault string"
)


def open_file(path: str):
    """Open a file for random reads on any file system Arrow knows."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


Pieces = Callable[[int, int], bytes]


def _pieces(stream) -> Pieces:
    """A function that gives bytes at a place, fetched in large pieces."""
    base, held = 0, b""

    def at(place: int, size: int) -> bytes:
        nonlocal base, held
        if place < base or place + size > base + len(held):
            stream.seek(place)
            base, held = place, stream.read(max(size, PIECE_BYTES))
        return held[place - base : place - base + size]

    return at


def sound_places(data: bytes, byte_order: str, ticks: int) -> np.ndarray:
    """Places in the bytes at which a sound record header can stand."""
    found = []
    for phase in range(4):
        words = np.frombuffer(data[phase : phase + (len(data) - phase) // 4 * 4], f"{byte_order}u4")
        if len(words) < 4:
            continue
        part, body, original = words[1:-2], words[2:-1], words[3:]
        sound = (part < ticks) & (body > 0) & (body <= SOUND_BODY)
        sound &= (original >= body) | (original == 0)
        found.append(np.flatnonzero(sound) * 4 + phase)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def proposed_entry(
    piece: Pieces, low: int, high: int, length: int, byte_order: str, ticks: int
) -> int | None:
    """The first place of a slice from which a chain of sound headers follows."""
    header = struct.Struct(byte_order + "IIII")
    # A record that starts before the slice ends within the largest sound body.
    for place in sound_places(
        piece(low, min(high, low + SOUND_BODY + RECORD_HEADER) - low + RECORD_HEADER), byte_order, ticks
    ).tolist():
        at = low + place
        if at >= high:
            break
        links = 0
        while links < CHAIN and at < length:
            record = piece(at, RECORD_HEADER)
            if len(record) < RECORD_HEADER:
                break
            _, part, body, original = header.unpack(record)
            if part >= ticks or not 0 < body <= SOUND_BODY or 0 < original < body:
                break
            at += RECORD_HEADER + body
            links += 1
        if links == CHAIN or at == length:
            return low + place
    return None


def walk(piece: Pieces, entry: int, high: int, length: int, byte_order: str) -> tuple:
    """Exit, number of records, and the place of a record that the file cuts."""
    body = struct.Struct(byte_order + "I")
    at, records = entry, 0
    while at < high:
        record = piece(at, RECORD_HEADER)
        size = body.unpack_from(record, 8)[0] if len(record) == RECORD_HEADER else 0
        if len(record) < RECORD_HEADER or at + RECORD_HEADER + size > length:
            return ENDED, records, at
        at += RECORD_HEADER + size
        records += 1
    return at, records, None


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte order, ticks and faults of files."""
    for batch in batches:
        rows = []
        for path, length in zip(*(batch.column(n).to_pylist() for n in ("path", "length")), strict=True):
            with open_file(path) as stream:
                header = stream.read(FILE_HEADER)
            order, ticks = MAGIC.get(header[:4], ("", 0))
            fault = None
            if len(header) < FILE_HEADER or not order:
                fault = "file_header"
            elif struct.unpack(order + "I", header[20:24])[0] != RAW_IP_LINK:
                fault = "link_type"
            rows.append((path, length, order, ticks, fault))
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, _FILE_TYPES, strict=True)],
                names=_FILE_NAMES,
            )


def _walk_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks of slices; a slice without an entry proposes one, if it can."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            with open_file(row["path"]) as stream:
                piece, entry = _pieces(stream), row["entry"]
                shape = (row["length"], row["byte_order"])
                if entry is None:
                    entry = proposed_entry(piece, row["low"], row["high"], *shape, row["ticks"])
                if entry is not None:
                    exit_, records, cut = walk(piece, entry, row["high"], *shape)
                    found = {"entry": entry, "exit": exit_, "records": records, "cut": cut}
                    rows.append({**row, **found})
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[n] for r in rows], t)
                    for n, t in zip(_SLICE_NAMES, _SLICE_TYPES, strict=True)
                ],
                names=_SLICE_NAMES,
            )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of walks sorted by file and entry, those that follow from the first record."""
    path, wanted = None, FILE_HEADER
    for batch in batches:
        kept = []
        columns = (batch.column(n).to_pylist() for n in ("path", "entry", "exit"))
        for n, (own, entry, exit_) in enumerate(zip(*columns, strict=True)):
            if own != path:
                path, wanted = own, FILE_HEADER
            if entry == wanted:
                kept.append(n)
                wanted = exit_
        if kept:
            yield batch.take(pa.array(kept))


def index_captures(
    spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Byte ranges and faults of all capture files under a path."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[pP][cC][aA][pP]")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    parts = spark.sparkContext.defaultParallelism
    files = cut_lineage(listed.repartition(parts).mapInArrow(_read_headers, _FILES))
    sound = files.where("fault IS NULL")
    width = F.lit(range_bytes).cast("bigint")

    def sliced(rows: DataFrame) -> DataFrame:
        """Slices to walk, of rows with ``slice`` and ``entry``."""
        low = F.col("slice") * width + FILE_HEADER
        nothing = F.lit(None).cast("bigint")
        bounds = {
            "low": low,
            "high": F.least(low + width, F.col("length")),
            "exit": nothing,
            "records": nothing,
            "cut": nothing,
        }
        parts = spark.sparkContext.defaultParallelism * 4
        return rows.withColumns(bounds).select(*_SLICE_NAMES).repartition(parts, "path", "slice")

    last = F.ceil((F.col("length") - FILE_HEADER) / width).cast("bigint") - 1
    numbers = F.sequence(F.lit(0).cast("bigint"), last)
    first = F.when(F.col("slice") == 0, F.lit(FILE_HEADER).cast("bigint"))
    begun = sound.where(F.col("length") > FILE_HEADER).withColumn("slice", F.explode(numbers))
    walks = cut_lineage(sliced(begun.withColumn("entry", first)).mapInArrow(_walk_slices, _SLICE))
    while True:
        chains = cut_lineage(
            walks.repartition("path")
            .sortWithinPartitions("path", "entry")
            .mapInArrow(_chained, _SLICE)
        )
        whole = F.max(F.col("exit") == F.col("length")) | F.max(F.col("exit") == ENDED)
        whole = chains.groupBy("path").agg(whole.alias("whole")).where("whole").select("path")
        exits = (
            walks.where((F.col("exit") >= 0) & (F.col("exit") < F.col("length")))
            .join(whole, "path", "left_anti")
            .select("path", "length", "byte_order", "ticks", F.col("exit").alias("entry"))
            .distinct()
            .join(walks.select("path", "entry"), ["path", "entry"], "left_anti")
            .withColumn("slice", F.floor((F.col("entry") - FILE_HEADER) / width).cast("bigint"))
        )
        fresh = cut_lineage(sliced(exits).mapInArrow(_walk_slices, _SLICE))
        if fresh.isEmpty():
            return _ranges(files, chains)
        walks = walks.unionByName(fresh)


def _ranges(files: DataFrame, slices: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("slice")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = slices.withColumn(
        "first_packet", F.lit(1) + F.coalesce(F.sum("records").over(earlier), F.lit(0))
    )
    found = counted.where("records > 0").select(
        "path",
        F.col("entry").alias("start"),
        F.when(F.col("exit") == ENDED, F.col("cut")).otherwise(F.col("exit")).alias("stop"),
        "first_packet",
        "byte_order",
        "ticks",
        F.lit(None).cast("string").alias("fault"),
    )
    cut = counted.where("cut IS NOT NULL").select(
        "path",
        F.col("cut").alias("start"),
        F.col("cut").alias("stop"),
        (F.col("first_packet") + F.col("records")).alias("first_packet"),
        "byte_order",
        "ticks",
        F.lit("truncated_record").alias("fault"),
    )
    zero = F.lit(0).cast("bigint")
    bad = files.where("fault IS NOT NULL").select(
        "path", zero.alias("start"), zero.alias("stop"), F.lit(1).cast("bigint").alias("first_packet"),
        "byte_order", "ticks", "fault",
    )
    return found.unionByName(cut).unionByName(bad)
