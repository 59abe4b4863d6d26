"""Reading tables, writing intermediate tables and small Arrow aids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; the path is only ever given to Spark's reader."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    The rows are worked out once, and a lost executor costs only the tasks that
    were running on it.  The folder lives as long as ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids (16 bytes each) that are broadcast at most: about 64 MB.
MOST_BROADCAST_IDS = 4_000_000


def broadcast_if_small(ids: DataFrame, most: int = MOST_BROADCAST_IDS) -> DataFrame:
    """A written table of ids, marked for broadcast if it has at most ``most`` rows.

    Beyond that the join shuffles, as it would without this function.
    """
    return F.broadcast(ids) if ids.count() <= most else ids


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone, null text as empty; other columns cannot clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def hash_share(doc_id: Column, seed: int) -> Column:
    """A repeatable draw from [0, 1) for an id."""
    spread = F.xxhash64(F.lit(seed), doc_id)
    return F.pmod(spread, F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20):
    """Cut batches into row ranges whose texts hold about ``most_bytes``."""
    for batch in batches:
        sizes = np.diff(_offsets(batch.column(column)))
        if not len(sizes):
            continue
        ends = np.cumsum(sizes)
        first, base = 0, 0
        while first < len(sizes):
            last = max(int(np.searchsorted(ends, base + most_bytes, side="right")), first + 1)
            yield batch.slice(first, last - first)
            first, base = last, int(ends[last - 1])


def _offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a string or binary array, slice-aware."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)
    return raw[column.offset : column.offset + len(column) + 1]


def byte_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text."""
    return column.cast(pa.binary()).to_pylist()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows."""
    offsets = _offsets(column).astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def partition_number() -> int:
    """Number of the running task's partition; the same when it is run again."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal whole-number keys (nulls are equal).

    For rows sorted by the keys these are the groups; one is held at a time.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            value = column.fill_null(0).to_numpy(zero_copy_only=False)
            empty = column.is_null().to_numpy(zero_copy_only=False)
            change[1:] |= (value[1:] != value[:-1]) | (empty[1:] != empty[:-1])
        first = tuple(batch.column(key)[0].as_py() for key in keys)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(batch.column(key)[batch.num_rows - 1].as_py() for key in keys)
    if held:
        yield pa.Table.from_batches(held)


def changes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows whose whole-number keys, none of them null, differ from the row before;
    the first one does."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for key in keys:
        value = table.column(key).to_numpy()
        change[1:] |= value[1:] != value[:-1]
    return change


def whole_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str], most_bytes: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most_bytes`` that end where the keys change; a larger run of
    equal keys is one batch."""
    held: list[pa.RecordBatch] = []
    count, size, enough = 0, 0, most_bytes
    for batch in batches:
        held.append(batch)
        count, size = count + batch.num_rows, size + batch.nbytes
        if size < enough or not count:
            continue
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        last = int(np.flatnonzero(changes(joined, keys))[-1])
        if last:
            yield joined.slice(0, last)
        held, count = [joined.slice(last)], count - last
        size = held[0].nbytes
        enough = max(most_bytes, 2 * size)
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
