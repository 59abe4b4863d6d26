"""Exact duplicates through a sharded cuckoo-filter index of live digests.

A key is the SHA-256 of the normalised text.  Keys are dealt to shards by their
leading bits.  A shard has a cuckoo filter over 16-bit fingerprints, and its
stored keys, bucketed by the filter's first bucket.  A key the filter does not
know is new; one it knows is compared with the full digest and length stored in
its bucket, so false positives never merge texts.  When a key finds no free slot
the filter is doubled and filled again from the stored keys.

Index rows (one table, written to the shared folder):

``shard, digest, length, keep_id, copies, slots`` - a stored key has a digest;
the row of a shard without one carries its filter table in ``slots``.

Null text counts as empty and very long texts are hashed whole.  Rows that share
a doc_id are one document and share its decision; null ids lose ties, and a
group of null ids only has a null ``keep_id``.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored, texts

BLANKS = r"[\x20\x09-\x0D]+"
SLOTS = 4
MOST_KICKS = 200

INDEX = "shard int, digest string, length long, keep_id long, copies long, slots binary"
_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("digest", pa.string()),
        ("length", pa.int64()),
        ("keep_id", pa.int64()),
        ("copies", pa.int64()),
        ("slots", pa.binary()),
    ]
)


class CuckooShard:
    """Cuckoo filter over 64-bit key hashes with the stored keys behind it."""

    def __init__(self, buckets: int = 64, slots: bytes | None = None):
        table = np.zeros((buckets, SLOTS), np.uint16)
        if slots:
            table = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        self.rows = table.tolist()
        self.mask = len(self.rows) - 1
        self.content: dict[int, list[list]] = {}
        self.size = 0

    @staticmethod
    def _places(digest: str) -> tuple[int, int]:
        """First bucket hash and fingerprint; the shard uses the digest's head."""
        return int(digest[16:28], 16), int(digest[28:32], 16) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def maybe(self, digest: str) -> bool:
        """Filter answer: false means certainly not stored."""
        spread, mark = self._places(digest)
        first = spread & self.mask
        return mark in self.rows[first] or mark in self.rows[self._other(first, mark)]

    def stored(self, digest: str, length: int) -> list | None:
        """The stored key equal to this one, read from its content bucket."""
        bucket = self._places(digest)[0] & self.mask
        for key in self.content.get(bucket, ()):
            if key[0] == digest and key[1] == length:
                return key
        return None

    def find(self, digest: str, length: int) -> list | None:
        """Filter first, then the verification of a hit."""
        return self.stored(digest, length) if self.maybe(digest) else None

    def remember(self, key: list) -> None:
        """Store a key whose fingerprint is in the filter already."""
        self.content.setdefault(self._places(key[0])[0] & self.mask, []).append(key)
        self.size += 1

    def insert(self, key: list) -> None:
        """Add a new key; doubles the filter when no slot can be freed."""
        self.remember(key)
        if not self._mark(key[0]):
            self._grow()

    def remove(self, digest: str, length: int) -> list | None:
        """Take out a live key and one copy of its fingerprint."""
        key = self.find(digest, length)
        if key is None:
            return None
        spread, mark = self._places(digest)
        first = spread & self.mask
        self.content[first].remove(key)
        self.size -= 1
        for bucket in (first, self._other(first, mark)):
            if mark in self.rows[bucket]:
                self.rows[bucket][self.rows[bucket].index(mark)] = 0
                break
        return key

    def _mark(self, digest: str) -> bool:
        spread, mark = self._places(digest)
        bucket = spread & self.mask
        for place in (bucket, self._other(bucket, mark)):
            if 0 in self.rows[place]:
                self.rows[place][self.rows[place].index(0)] = mark
                return True
        for kick in range(MOST_KICKS):
            row = self.rows[bucket]
            slot = (kick + mark) % SLOTS
            mark, row[slot] = row[slot], mark
            bucket = self._other(bucket, mark)
            if 0 in self.rows[bucket]:
                self.rows[bucket][self.rows[bucket].index(0)] = mark
                return True
        return False

    def _grow(self) -> None:
        keys = [key for bucket in self.content.values() for key in bucket]
        buckets = 2 * len(self.rows)
        while True:
            self.__init__(buckets)
            for key in keys:
                self.remember(key)
            if all(self._mark(key[0]) for key in keys):
                return
            buckets *= 2

    def slots(self) -> bytes:
        """The filter table as bytes."""
        return np.array(self.rows, np.uint16).tobytes()


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _update_shard(rows: pa.Table) -> pa.Table:
    """Apply removals and insertions to one shard; ``step`` orders them."""
    slots = [s for s in rows.column("slots").to_pylist() if s is not None]
    shard = CuckooShard(slots=slots[0] if slots else None)
    number = rows.column("shard")[0].as_py()
    columns = [rows.column(c).to_pylist() for c in ("step", "digest", "length", "keep_id", "copies")]
    keys = sorted(
        (r for r in zip(*columns, strict=True) if r[1] is not None),
        key=lambda r: (r[0], r[1], r[2]),
    )
    for step, digest, length, keep_id, copies in keys:
        if step == 0:
            shard.remember([digest, length, keep_id, copies])
        elif step == 1:
            shard.remove(digest, length)
        else:
            key = shard.find(digest, length)
            if key is None:
                shard.insert([digest, length, keep_id, copies])
            else:
                key[2] = _least(key[2], keep_id)
                key[3] += copies
    live = [key for bucket in shard.content.values() for key in bucket]
    return pa.table(
        [
            [number] * (len(live) + 1),
            [k[0] for k in live] + [None],
            [k[1] for k in live] + [None],
            [k[2] for k in live] + [None],
            [k[3] for k in live] + [None],
            [None] * len(live) + [shard.slots()],
        ],
        schema=_ARROW,
    )


def _combine(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Fold equal keys of a task before they are shuffled, in bounded memory."""
    held: dict[tuple, list] = {}

    def flush():
        keys = list(held)
        out = pa.record_batch(
            [
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array([k[2] for k in keys], pa.int64()),
                pa.array([held[k][0] for k in keys], pa.int64()),
                pa.array([held[k][1] for k in keys], pa.int64()),
            ],
            names=["shard", "digest", "length", "keep_id", "copies"],
        )
        held.clear()
        return out

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("shard", "digest", "length", "doc_id"))
        for shard, digest, length, doc_id in zip(*columns, strict=True):
            entry = held.get((shard, digest, length))
            if entry is None:
                held[shard, digest, length] = [doc_id, 1]
            else:
                entry[0] = _least(entry[0], doc_id)
                entry[1] += 1
        if len(held) >= most:
            yield flush()
    if held:
        yield flush()


class CuckooIndex:
    """A sharded index; every change gives a new written version."""

    def __init__(self, rows: DataFrame | None, shards: int):
        self.rows = rows
        self.shards = shards

    @staticmethod
    def sized_for(keys: int, shard_keys: int = 200_000, least: int = 256) -> CuckooIndex:
        """An empty index whose shards will hold about ``shard_keys`` keys."""
        return CuckooIndex(None, max(least, math.ceil(keys / shard_keys)))

    def _sharded(self, keys: DataFrame) -> DataFrame:
        head = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
        return keys.withColumn("shard", F.pmod(head, F.lit(self.shards)).cast("int"))

    def update(self, add: DataFrame | None = None, drop: DataFrame | None = None) -> CuckooIndex:
        """Remove the digests of ``drop``, then insert the rows of ``add``.

        ``drop`` has ``digest, length``; ``add`` also ``doc_id``.  Equal keys are
        folded per task before the shuffle, so a digest that fills a third of
        the rows sends one row per task.
        """
        empty = F.lit(None).cast("binary")
        parts = []
        if self.rows is not None:
            parts.append(self.rows.withColumn("step", F.lit(0)))
        if drop is not None:
            gone = self._sharded(drop.select("digest", "length").distinct())
            parts.append(
                gone.select(
                    "shard",
                    "digest",
                    "length",
                    F.lit(None).cast("long").alias("keep_id"),
                    F.lit(0).cast("long").alias("copies"),
                    empty.alias("slots"),
                    F.lit(1).alias("step"),
                )
            )
        if add is not None:
            rows = self._sharded(add.select("digest", "length", "doc_id"))
            folded = rows.mapInArrow(
                _combine, "shard int, digest string, length long, keep_id long, copies long"
            )
            parts.append(folded.withColumns({"slots": empty, "step": F.lit(2)}))
        everything = parts[0]
        for part in parts[1:]:
            everything = everything.unionByName(part)
        rows = everything.groupBy("shard").applyInArrow(_update_shard, INDEX)
        return CuckooIndex(stored(rows, "cuckoo"), self.shards)

    def keys(self) -> DataFrame:
        """The stored keys: ``digest, length, keep_id, copies``."""
        live = self.rows.where(F.col("digest").isNotNull())
        return live.select("digest", "length", "keep_id", "copies")

    def filters(self) -> DataFrame:
        """The filter table of each shard: ``shard, slots``."""
        return self.rows.where(F.col("digest").isNull()).select("shard", "slots")


def text_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, length`` of the normalised texts."""
    plain = texts(docs).select(
        "doc_id", F.regexp_replace("text", BLANKS, " ").cast("binary").alias("plain")
    )
    return plain.select(
        "doc_id", F.sha2("plain", 256).alias("digest"), F.octet_length("plain").cast("long").alias("length")
    )


def exact_duplicates(docs: DataFrame, shard_keys: int = 200_000) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest``.

    The texts are read once.  Whether a document is new or a copy comes from the
    index; the last join brings each group's result to its documents, and
    adaptive execution splits it where one digest is hot.
    """
    keys = stored(text_keys(docs), "digests")
    index = CuckooIndex.sized_for(keys.count(), shard_keys).update(add=keys)
    groups = index.keys()
    return keys.join(groups, ["digest", "length"]).select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )
