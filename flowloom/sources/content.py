"""Hash trees over the files of a folder.

Files are cut into ranges of equal length, which are hashed by many tasks, so one huge
file is no longer one serial hash.  Up to ``FAN`` neighbouring digests are hashed to
the digest above them, level by level, until a file has one; the files' digests, in
their own order, go the same way to the root.  No row holds more than ``FAN`` digests.
The root does not depend on how the work is dealt out or on file names.  Where two
trees differ, only what lies below differing digests is compared further down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.ordered import number_sorted
from flowloom.session import cut_lineage
from flowloom.sources.ranges import open_file

FAN = 64
RANGE_BYTES = 64 * 1024 * 1024
# Bytes hashed at a time.
_PIECE = 8 * 1024 * 1024
_LEAVES = "file string, level int, place bigint, digest string"


def content_ranges(
    spark: SparkSession, path: str, pattern: str = "part-*", *, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``file, level, place, digest``: SHA-256 of every range of every file, level 0.

    ``file`` is the path below the folder.  Spark lists no empty files, so they have no
    part in a tree.
    """
    root = path.rstrip("/")
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )
    folder = root.split("://")[-1].split(":")[-1].strip("/")
    last = F.ceil(F.col("length") / range_bytes).cast("bigint") - 1
    cut = listed.select(
        "path",
        F.substring_index(F.col("path"), f"{folder}/", -1).alias("file"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("place"),
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                held, left = hashlib.sha256(), range_bytes
                with open_file(row["path"]) as stream:
                    stream.seek(row["place"] * range_bytes)
                    while left and (piece := stream.read(min(_PIECE, left))):
                        held.update(piece)
                        left -= len(piece)
                found.append(held.hexdigest())
            yield pa.record_batch(
                [
                    batch.column("file"),
                    pa.array([0] * len(found), pa.int32()),
                    batch.column("place"),
                    pa.array(found, pa.string()),
                ],
                names=["file", "level", "place", "digest"],
            )

    parts = spark.sparkContext.defaultParallelism * 4
    return cut.repartition(parts, "path", "place").mapInArrow(digests, _LEAVES)


def _above(nodes: DataFrame) -> DataFrame:
    """The next level: each digest is that of up to ``FAN`` digests below it."""
    parent = F.floor(F.col("place") / FAN).cast("bigint")
    below = F.sort_array(F.collect_list(F.struct("place", "digest")))["digest"]
    return (
        nodes.groupBy("file", "level", parent.alias("parent"))
        .agg(F.sha2(F.concat_ws("", below), 256).alias("digest"))
        .select("file", (F.col("level") + 1).alias("level"), F.col("parent").alias("place"), "digest")
    )


def content_tree(ranges: DataFrame) -> DataFrame:
    """All levels over ranges; a file's tree ends with the level of its one digest.

    Every file gets as many levels as the largest one needs, one at least.
    """
    level = cut_lineage(ranges)
    tree = level
    while True:
        level = cut_lineage(_above(level))
        tree = tree.unionByName(level)
        if not (level.agg(F.max("place")).first()[0] or 0):
            return tree


def tree_root(tree: DataFrame) -> str | None:
    """The root's digest; ``None`` without files."""
    top = tree.agg(F.max("level")).first()[0]
    if top is None:
        return None
    files = tree.where(F.col("level") == top).select(F.lit("").alias("file"), "digest")
    numbered = number_sorted(files, ["file"], ["digest"], "_number")
    level = cut_lineage(
        numbered.select(
            "file", F.lit(0).alias("level"), (F.col("_number") - 1).alias("place"), "digest"
        )
    )
    while True:
        level = cut_lineage(_above(level))
        if not level.agg(F.max("place")).first()[0]:
            return level.first()["digest"]


def changed_ranges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``file, place, change``: ranges changed, added or removed between two trees.

    The comparison descends from the top: a level reads the nodes below differing
    ones only.
    """
    tops = [t.agg(F.max("level")).first()[0] for t in (stored, fresh)]
    known = [t for t in tops if t is not None]
    top = min(known) if len(known) == 2 else 0

    def at(tree: DataFrame, level: int, name: str) -> DataFrame:
        return tree.where(F.col("level") == level).select("file", "place", F.col("digest").alias(name))

    wanted = None
    for level in range(top, -1, -1):
        both = at(stored, level, "before").join(at(fresh, level, "after"), ["file", "place"], "full")
        if wanted is not None:
            parent = F.floor(F.col("place") / FAN).cast("bigint")
            both = both.withColumn("parent", parent).join(wanted, ["file", "parent"], "left_semi")
        differing = cut_lineage(
            both.where(~F.col("before").eqNullSafe(F.col("after"))).select(
                "file", "place", "before", "after"
            )
        )
        wanted = differing.select("file", F.col("place").alias("parent")).distinct()
    change = (
        F.when(F.col("before").isNull(), F.lit("added"))
        .when(F.col("after").isNull(), F.lit("removed"))
        .otherwise(F.lit("changed"))
    )
    return differing.select("file", "place", change.alias("change"))
