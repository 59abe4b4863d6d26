"""Ordered computations that stay distributed when one group is huge.

A plain window over ``partitionBy(group).orderBy(n)`` puts a whole group on one
task.  The helpers here cut a group into chunks of consecutive order values,
work inside a chunk with a window, summarise each chunk with a map-side
aggregate, scan the few summaries, and join the carried value back on
``(group, chunk)``.  The order value must be unique inside its group, so a chunk
never holds more than ``chunk_rows`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.schemas import CHUNK_ROWS
from flowloom.session import cut_lineage


def chunk_of(order: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of an integer order column."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    return F.floor(F.col(order) / F.lit(chunk_rows)).cast("bigint")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Dense 1-based position of each row in its group, by a unique integer order."""
    chunked = df.withColumn("_chunk", chunk_of(order, chunk_rows))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        chunked.join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_base") + F.row_number().over(inside))
        .drop("_chunk", "_base")
    )


def number_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    ranges: int | None = None,
) -> DataFrame:
    """Dense 1-based position by any order columns (ties must not exist).

    The rows are range-partitioned on group and order, so a hot group spreads
    over many ranges, and each range is numbered on its own.  The range number
    is only stable once written, hence the reliable checkpoint.
    """
    spark = df.sparkSession
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_base") + F.row_number().over(inside))
        .drop("_range", "_base")
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str,
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Value of the preceding row in the group (null for the first row)."""
    chunked = df.withColumn("_chunk", chunk_of(order, chunk_rows))
    tails = chunked.groupBy(*keys, "_chunk").agg(F.max_by(value, order).alias("_tail"))
    carried = tails.select(
        *keys,
        "_chunk",
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        chunked.join(carried, [*keys, "_chunk"])
        .withColumn(
            name,
            F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(
                F.lag(value).over(inside)
            ),
        )
        .drop("_chunk", "_carried")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    *,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linear-interpolated quantiles of a DOUBLE column, one row each.

    Approximate quantiles bracket each target rank from both sides; one pass
    then counts the rows below the bracket and groups the bracket's rows by
    value, so only about ``4 / accuracy`` of the distinct values are ever sorted.
    Returns ``probability, quantile``.
    """
    if not probabilities:
        raise ValueError("at least one probability is required")
    slack = 2.0 / accuracy
    cuts = [min(max(p + side * slack, 0.0), 1.0) for p in probabilities for side in (-1, 1)]
    df = df.where(F.col(value).isNotNull())
    found = df.agg(
        F.percentile_approx(value, [float(c) for c in cuts], accuracy).alias("cuts"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ).first()
    if found["cuts"] is None:
        return df.sparkSession.createDataFrame([], "probability double, quantile double")
    # Two numbers per probability; a bracket at the end of the range is opened fully.
    brackets = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("probability"),
                F.lit(found["low"] if cuts[2 * i] <= 0.0 else found["cuts"][2 * i]).alias("low"),
                F.lit(
                    found["high"] if cuts[2 * i + 1] >= 1.0 else found["cuts"][2 * i + 1]
                ).alias("high"),
            )
            for i, p in enumerate(probabilities)
        ]
    )
    value_at = F.col("_value")
    zone = (
        F.when(value_at < F.col("b.low"), F.lit(0))
        .when(value_at > F.col("b.high"), F.lit(2))
        .otherwise(F.lit(1))
    )
    # Below and above the bracket one group each is left, known by the value
    # next to the bracket; a target rank can miss the bracket by one row at most.
    placed = (
        df.select(F.col(value).alias("_value"))
        .select("_value", F.explode(brackets).alias("b"))
        .select(F.col("b.probability").alias("probability"), zone.alias("zone"), "_value")
        .groupBy(
            "probability", "zone", F.when(F.col("zone") == 1, value_at).alias("_inside")
        )
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("_value").alias("_highest"),
            F.min("_value").alias("_lowest"),
        )
        .withColumn(
            "candidate", F.when(F.col("zone") == 0, F.col("_highest")).otherwise(F.col("_lowest"))
        )
    )
    ordered = Window.partitionBy("probability").orderBy("zone", "candidate")
    ranked = placed.select(
        "probability",
        "zone",
        "candidate",
        "rows",
        F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("rows").over(Window.partitionBy("probability")).alias("total"),
    ).withColumn("position", F.col("probability") * (F.col("total") - 1).cast("double"))

    def holds(rank: Column) -> Column:
        first, last = F.col("upto") - F.col("rows"), F.col("upto") - 1
        return (
            F.when(F.col("zone") == 0, rank == last)
            .when(F.col("zone") == 2, rank == first)
            .otherwise(rank.between(first, last))
        )

    return (
        ranked.groupBy("probability")
        .agg(
            F.max(F.when(holds(F.floor("position")), F.col("candidate"))).alias("low"),
            F.max(F.when(holds(F.ceil("position")), F.col("candidate"))).alias("high"),
            F.max(F.col("position") - F.floor("position")).alias("weight"),
        )
        .select(
            "probability",
            (F.col("low") + (F.col("high") - F.col("low")) * F.col("weight")).alias("quantile"),
        )
    )
