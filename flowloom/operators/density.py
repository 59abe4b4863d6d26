"""Class-conditional Gaussian densities of a score and their distribution function.

The distribution function of a kernel density is the mean of normal CDFs over
all samples.  Evaluating it against every sample would pair all scored rows with
all samples of a class.  Instead the samples are reduced to grid cells one
bandwidth wide, each with its count and centred power sums.  Far cells
contribute 0 or 1 per sample; the few cells around the score contribute a Taylor
series in the power sums.  The sum equals the direct one to about 1e-12.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.plan import broadcast_if_small
from flowloom.functions.vectors import normal_cdf
from flowloom.session import cut_lineage

# Series order: a sample lies at most half a bandwidth from its cell centre, so
# the first dropped term is below 1e-13 of one sample.
_ORDER = 18
# Cells further than this from the score's cell are past 8.5 bandwidths, where
# the normal CDF is 0 or 1 to double precision.
_REACH = 9
# Cells per stored block, besides the reach copied from either neighbour.
_BLOCK = 64


def fit_densities(samples: DataFrame, *, label: str = "label", score: str = "score") -> DataFrame:
    """Sample count, mean, deviation and Scott bandwidth of each class's scores."""
    return (
        samples.groupBy(F.col(label).alias("label"))
        .agg(
            F.count(score).alias("n"),
            F.min(score).alias("minimum"),
            F.max(score).alias("maximum"),
            F.avg(score).alias("mean"),
            F.stddev_samp(score).alias("deviation"),
        )
        .withColumn(
            "bandwidth", F.col("deviation") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
        )
    )


def _cell(value: Column) -> Column:
    """Grid cell of a value, counted in bandwidths from the class mean."""
    return F.floor((value - F.col("mean")) / F.col("bandwidth")).cast("bigint")


def density_blocks(
    samples: DataFrame, densities: DataFrame, *, label: str = "label", score: str = "score"
) -> DataFrame:
    """Cells of each class, grouped into blocks that answer any score alone.

    A block row holds its own cells and the neighbours' within reach, plus the
    count of all samples below them.  Blocks cover the whole range of a class
    and one more on either side.
    """
    usable = densities.where((F.col("n") >= 2) & (F.col("bandwidth") > 0))
    placed = (
        samples.select(F.col(label).alias("label"), F.col(score).alias("score"))
        .join(usable.select("label", "mean", "bandwidth"), "label")
        .withColumn("cell", _cell(F.col("score")))
        .withColumn(
            "_offset",
            (F.col("score") - F.col("mean")) / F.col("bandwidth")
            - (F.col("cell").cast("double") + F.lit(0.5)),
        )
    )
    cells = placed.groupBy("label", "cell").agg(
        F.array(
            F.count(F.lit(1)).cast("double"),
            *[F.sum(F.pow("_offset", F.lit(float(k)))) for k in range(1, _ORDER + 1)],
        ).alias("sums")
    )
    blocks = usable.select(
        "label",
        "n",
        "mean",
        "bandwidth",
        F.explode(
            F.sequence(
                F.floor(_cell(F.col("minimum")) / _BLOCK) - 1,
                F.floor(_cell(F.col("maximum")) / _BLOCK) + 1,
            )
        ).alias("block"),
    )
    spread = cells.withColumn(
        "block",
        F.explode(
            F.sequence(
                F.floor((F.col("cell") - _REACH) / _BLOCK),
                F.floor((F.col("cell") + _REACH) / _BLOCK),
            )
        ),
    )
    first = F.col("block") * _BLOCK
    own = F.col("cell").between(first, first + _BLOCK - 1)
    gathered = spread.groupBy("label", "block").agg(
        # at most 64 + 2 * 9 cells
        F.collect_list(F.struct("cell", "sums")).alias("cells"),
        F.sum(F.when(own, F.col("sums")[0])).alias("_own"),
        F.sum(F.when(F.col("cell") < first, F.col("sums")[0])).alias("_before"),
    )
    earlier = Window.partitionBy("label").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        blocks.join(gathered, ["label", "block"], "left")
        .withColumn("_below", F.coalesce(F.sum("_own").over(earlier), F.lit(0.0)))
        .select(
            "label",
            "block",
            "n",
            "mean",
            "bandwidth",
            (F.col("_below") - F.coalesce("_before", F.lit(0.0))).alias("below"),
            F.coalesce(
                "cells",
                F.expr("cast(array() as array<struct<cell:bigint,sums:array<double>>>)"),
            ).alias("cells"),
        )
    )


def _series(z: Column, sums: Column) -> Column:
    """Sum of normal CDFs of a cell's samples at ``z`` bandwidths from its centre.

    The k-th derivative of the normal CDF is ``(-1)**(k-1) He[k-1](z) phi(z)``;
    a sample at offset ``d`` is evaluated at ``z - d``.  The fold carries the
    last two Hermite values and the running ``1/k!``.
    """
    start = F.struct(
        F.lit(0.0).alias("older"),
        F.lit(1.0).alias("newer"),
        F.lit(1.0).alias("scale"),
        F.lit(0.0).alias("k"),
        F.lit(0.0).alias("total"),
    )

    def step(state: Column, power_sum: Column) -> Column:
        k = state["k"] + 1.0
        scale = state["scale"] / k
        return F.struct(
            state["newer"].alias("older"),
            (z * state["newer"] - state["k"] * state["older"]).alias("newer"),
            scale.alias("scale"),
            k.alias("k"),
            (state["total"] - power_sum * state["newer"] * scale).alias("total"),
        )

    folded = F.aggregate(F.slice(sums, 2, _ORDER), start, step, lambda state: state["total"])
    density = F.exp(-z * z / 2.0) / F.lit(2.5066282746310002)
    return sums[0] * normal_cdf(z) + density * folded


def with_ood_score(
    rows: DataFrame,
    blocks: DataFrame,
    *,
    label: str = "predicted",
    score: str = "relative_distance",
    name: str = "ood_score",
) -> DataFrame:
    """Density distribution function of the row's class at the row's score.

    Every row meets exactly one block row, by an equi join on class and block.
    Classes and blocks are few: they are broadcast after a check of their
    number, so the scored rows stay where they are.  The score is null where the
    class has no usable density; :func:`unscored_violations` names such rows.
    """
    blocks = cut_lineage(blocks)
    frame = blocks.groupBy("label").agg(
        F.first("mean").alias("_mean"),
        F.first("bandwidth").alias("_bandwidth"),
        F.min("block").alias("_lowest"),
        F.max("block").alias("_highest"),
    )
    scaled = (F.col(score) - F.col("_mean")) / F.col("_bandwidth")
    # Scores beyond the outermost blocks are all-below or all-above already.
    placed = (
        rows.join(broadcast_if_small(frame.withColumnRenamed("label", label)), label, "left")
        .withColumn("_z", scaled)
        .withColumn(
            "_block",
            F.greatest(
                F.col("_lowest"),
                F.least(F.col("_highest"), F.floor(F.floor("_z") / _BLOCK).cast("bigint")),
            ),
        )
    )
    stored = blocks.select(
        F.col("label").alias(label), F.col("block").alias("_block"), "n", "below", "cells"
    )
    here = F.floor("_z")
    near = F.aggregate(
        "cells",
        F.col("below"),
        lambda total, c: total
        + F.when(c["cell"] < here - _REACH, c["sums"][0])
        .when(c["cell"] > here + _REACH, F.lit(0.0))
        .otherwise(_series(F.col("_z") - (c["cell"].cast("double") + F.lit(0.5)), c["sums"])),
    )
    return (
        placed.join(broadcast_if_small(stored), [label, "_block"], "left")
        .withColumn(
            name,
            F.when(
                F.col("n").isNotNull(),
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), near / F.col("n"))),
            ),
        )
        .drop("_mean", "_bandwidth", "_lowest", "_highest", "_z", "_block", "n", "below", "cells")
    )


def unscored_violations(rows: DataFrame, key: str, *, name: str = "ood_score") -> DataFrame:
    """Rows without a score, because their class has no usable density."""
    return rows.where(F.col(name).isNull()).select(
        F.lit("class_without_density").alias("rule"),
        F.col(key).cast("string").alias("key"),
        F.lit("").alias("detail"),
    )
