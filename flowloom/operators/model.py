"""Standardizing, baselines, prototypes, distances and frozen-model scoring.

Rows carry a ``label`` and a fixed-length vector.  State tables hold one row per
class and are bounded by the class list, which callers pass in result order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.ordered import number_sorted
from flowloom.functions.permute import permuted
from flowloom.functions.vectors import argmax, log_sum_exp, softmax
from flowloom.schemas import SUPPORT_PER_CLASS, SUPPORT_SEED
from flowloom.session import cut_lineage

# Classes a state table may hold before its broadcast is refused.
MAXIMUM_CLASSES = 1024
GLOBAL_LABEL = "*"


class ModelError(ValueError):
    """Raised when a model step cannot be done on the given rows."""


def _element_statistics(
    rows: DataFrame, vector: str, dimension: int, label: Column
) -> DataFrame:
    """Rows, mean and population variance of every element, per label.

    Vectors are unfolded into elements; partial sums per label and element are
    combined map-side, so a task sends one row per label and element.  A vector
    of another length stops the job.
    """
    cells = rows.select(label.alias("label"), F.posexplode(vector).alias("i", "x")).groupBy(
        "label", "i"
    )
    x = F.col("x").cast("double")
    elements = cells.agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance")
    )
    # one entry per element of the vector
    gathered = F.sort_array(F.collect_list(F.struct("i", "mean", "variance")))
    fits = (F.size("c") == dimension) & (F.col("fewest") == F.col("n"))
    means = F.when(fits, F.col("c.mean")).otherwise(
        F.raise_error(F.lit(f"vectors must have {dimension} elements"))
    )
    return (
        elements.groupBy("label")
        .agg(F.max("n").alias("n"), F.min("n").alias("fewest"), gathered.alias("c"))
        .select("label", "n", means.alias("mean"), F.col("c.variance").alias("variance"))
    )


def fit_standardizer(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """One row with the population mean and scale of every element.

    An element without spread beyond rounding gets scale 1.
    """
    epsilon = 2.0**-52
    stats = _element_statistics(rows, vector, dimension, F.lit(0))
    n = F.col("n").cast("double")
    return stats.select(
        "n",
        "mean",
        F.zip_with(
            "mean",
            "variance",
            lambda m, v: F.when(
                v <= n * epsilon * v + (n * m * epsilon) * (n * m * epsilon), F.lit(1.0)
            ).otherwise(F.sqrt(v)),
        ).alias("scale"),
    )


def standardize(rows: DataFrame, scaler: DataFrame, vector: str, name: str | None = None) -> DataFrame:
    """``(x - mean) / scale`` in double, kept as float.

    The scaler is one row of one number per element and becomes literals.
    """
    state = scaler.select("mean", "scale").first()
    mean, scale = (F.array(*[F.lit(v) for v in state[part]]) for part in ("mean", "scale"))
    centred = F.zip_with(F.col(vector), mean, lambda x, m: x.cast("double") - m)
    return rows.withColumn(
        name or vector, F.zip_with(centred, scale, lambda x, s: (x / s).cast("float"))
    )


def majority_class(rows: DataFrame, label: str = "label") -> DataFrame:
    """Most frequent label (smallest on a tie), its share and the row count."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.agg(
        F.min_by("label", F.struct((-F.col("rows")).alias("rank"), F.col("label"))).alias("label"),
        F.max("rows").alias("rows"),
        F.sum("rows").alias("total"),
    ).withColumn("prior", F.col("rows") / F.col("total"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` of each label."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(F.lit(0))
    return counts.select(
        "label",
        "rows",
        (
            F.sum("rows").over(whole)
            / (F.count(F.lit(1)).over(whole) * F.col("rows"))
        ).alias("weight"),
    )


def fit_balanced_logistic(
    rows: DataFrame,
    labels: Sequence,
    *,
    vector: str,
    label: str = "label",
    c: float = 1.0,
    maximum_iterations: int = 2000,
    tolerance: float = 1e-6,
):
    """Class-balanced multinomial logistic regression on standardized vectors.

    Returns the fitted model; labels are numbered in the given order.  Refuses a
    fit that ran into the iteration limit.
    """
    index = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1
    weights = class_weights(rows, label).select(F.col("label").alias(label), "weight")
    training = rows.join(weights, label).select(
        index.cast("double").alias("_index"),
        "weight",
        array_to_vector(F.col(vector)).alias("_features"),
    )
    n = rows.count()
    model = LogisticRegression(
        featuresCol="_features",
        labelCol="_index",
        weightCol="weight",
        family="multinomial",
        standardization=False,
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        maxIter=maximum_iterations,
        tol=tolerance,
    ).fit(training)
    if model.summary.totalIterations >= maximum_iterations:
        raise ModelError("logistic regression reached its iteration limit")
    return model


def predict_logistic(model, rows: DataFrame, labels: Sequence, *, vector: str) -> DataFrame:
    """Add the predicted label of a fitted logistic model."""
    scored = model.transform(rows.withColumn("_features", array_to_vector(F.col(vector))))
    return scored.withColumn(
        "predicted",
        F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("prediction").cast("int") + 1),
    ).drop("_features", "rawPrediction", "probability", "prediction")


def _draw(seed: int, *parts: str) -> Column:
    """Repeatable pseudo-random order key of a row."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]), 256)


def sample_episodes(
    rows: DataFrame,
    *,
    episodes: int,
    support_per_class: int = 5,
    queries: int = 512,
    seed: int = SUPPORT_SEED,
    row_id: str = "row_id",
    label: str = "label",
) -> DataFrame:
    """Seeded episodes: ``n`` support rows per class and ``m`` other query rows.

    Rows are numbered once, per class and as a whole.  The k-th row an episode draws
    from a class is the place to which a permutation keyed by seed, episode and class
    takes k, so episodes draw without replacement and independently of each other,
    and the work is one row per drawn row.  Query rows are drawn from all rows in the
    same way, with as many to spare as support rows can fall among them.  A class
    smaller than wanted is drawn whole.  Returns ``episode, role, row_id, label``.
    """
    if min(episodes, support_per_class, queries) < 1 or seed < 0:
        raise ModelError("episodes, support and queries are one or more, the seed is not negative")
    spark = rows.sparkSession
    placed = rows.select(
        F.col(row_id).alias("row_id"), F.col(label).alias("label"), F.lit(0).alias("_all")
    )
    sizes = cut_lineage(placed.groupBy("label").agg(F.count(F.lit(1)).alias("_size")))
    totals = sizes.agg(F.count(F.lit(1)), F.sum("_size")).first()
    if not totals[0]:
        raise ModelError("there are no rows to draw episodes from")
    placed = number_sorted(placed, ["label"], ["row_id"], "_in_class")
    placed = cut_lineage(number_sorted(placed, ["_all"], ["row_id"], "_in_all"))
    numbers = F.explode(F.sequence(F.lit(1), F.lit(episodes)))

    def places(keyed: DataFrame, key: Column, wanted: int, column: str) -> DataFrame:
        """Rows of episodes with a ``_size``, once for each place they draw."""
        steps = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(wanted), F.col("_size")) - 1)
        name = F.concat_ws(":", F.lit(str(seed)), F.col("episode").cast("string"), key)
        return (
            keyed.withColumn("_step", F.explode(steps))
            .withColumn(column, permuted(F.col("_step"), F.col("_size"), name) + 1)
            .drop("_size")
        )

    classes = sizes.withColumn("episode", numbers).repartition("label", "episode")
    own = F.concat(F.lit("class"), F.col("label").cast("string"))
    support = cut_lineage(
        places(classes, own, support_per_class, "_in_class")
        .join(placed, ["label", "_in_class"])
        .select("episode", F.lit("support").alias("role"), "row_id", "label")
    )
    enough = queries + support_per_class * totals[0]
    drawn = spark.range(1, episodes + 1).select(F.col("id").cast("int").alias("episode"))
    whole = drawn.withColumn("_size", F.lit(totals[1]).cast("bigint"))
    others = (
        places(whole, F.lit("all"), enough, "_in_all")
        .join(placed.drop("_all"), "_in_all")
        .join(support.select("episode", "row_id"), ["episode", "row_id"], "left_anti")
    )
    nth = F.row_number().over(Window.partitionBy("episode").orderBy("_step"))
    query = (
        others.withColumn("_rank", nth)
        .where(F.col("_rank") <= queries)
        .select("episode", F.lit("query").alias("role"), "row_id", "label")
    )
    return support.unionByName(query)


def select_support(
    rows: DataFrame,
    *,
    maximum_per_class: int = SUPPORT_PER_CLASS,
    seed: int = SUPPORT_SEED,
    row_id: str = "row_id",
    label: str = "label",
) -> DataFrame:
    """Up to ``maximum_per_class`` seeded support rows of each class."""
    if maximum_per_class < 2:
        raise ModelError(f"support needs two rows of a class, not {maximum_per_class}")
    order = Window.partitionBy(label).orderBy("_draw", row_id)
    return (
        rows.withColumn("_draw", _draw(seed, row_id))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= maximum_per_class)
        .drop("_draw", "_rank")
    )


def class_statistics(rows: DataFrame, vector: str, dimension: int, label: str = "label") -> DataFrame:
    """Rows, mean and population variance of every class, element by element."""
    return _element_statistics(rows, vector, dimension, F.col(label))


def _matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Arrow list column of equal-length vectors as ``[rows, dimension]`` doubles."""
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(-1, dimension)


@dataclass(frozen=True)
class ClassState:
    """Means and inverse variances of the classes, in label order."""

    labels: tuple
    means: np.ndarray
    precisions: np.ndarray


def class_state(
    statistics: DataFrame, labels: Sequence, *, maximum_classes: int = MAXIMUM_CLASSES
) -> ClassState:
    """Driver-side class state, bounded by the class list; every label is required.

    More than ``maximum_classes`` labels are refused: the state travels to every task.

    Variances at or below ``D * eps(float32) * max`` of their class count as
    zero and get precision zero, as in a pseudo-inverse.
    """
    if not 2 <= len(labels) <= maximum_classes:
        raise ModelError(f"{len(labels)} classes given, 2 to {maximum_classes} are allowed")
    found = {
        r["label"]: r for r in statistics.where(F.col("label").isin(*labels)).collect()
    }
    if set(found) != set(labels):
        raise ModelError(f"classes without support: {sorted(map(str, set(labels) - set(found)))}")
    means = np.array([found[v]["mean"] for v in labels], dtype=np.float64)
    variances = np.array([found[v]["variance"] for v in labels], dtype=np.float64)
    cutoff = means.shape[1] * float(np.finfo(np.float32).eps)
    kept = variances > cutoff * variances.max(axis=1, keepdims=True)
    precisions = np.divide(1.0, variances, out=np.zeros_like(variances), where=kept)
    return ClassState(tuple(labels), means, precisions)


def _with_class_distances(
    rows: DataFrame, means: np.ndarray, weights: np.ndarray, sign: float, vector: str, name: str
) -> DataFrame:
    """Signed weighted squared distance of each row to each class, in label order."""
    classes, dimension = means.shape

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def distances(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors, dimension)
        found = np.empty((len(x), classes))
        for k in range(classes):
            difference = x - means[k]
            found[:, k] = sign * np.einsum("nf,nf,f->n", difference, difference, weights[k])
        offsets = np.arange(0, (len(x) + 1) * classes, classes, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))

    return rows.withColumn(name, distances(F.col(vector)))


def with_logits(rows: DataFrame, state: ClassState, vector: str, name: str = "logits") -> DataFrame:
    """Negative squared distance to every class prototype, in label order."""
    return _with_class_distances(
        rows, state.means, np.ones_like(state.means), -1.0, vector, name
    )


def with_mahalanobis(
    rows: DataFrame, state: ClassState, vector: str, name: str = "distances"
) -> DataFrame:
    """Diagonal Mahalanobis distance to every class, in label order.

    Elements without variance in a class drop out of its distance.
    """
    return _with_class_distances(rows, state.means, state.precisions, 1.0, vector, name)


def with_prediction(rows: DataFrame, labels: Sequence, logits: Column) -> DataFrame:
    """Add probabilities, predicted index and label, and the raw confidence."""
    return (
        rows.withColumn("class_probabilities", softmax(logits))
        .withColumn("predicted_index", argmax(F.col("class_probabilities")))
        .withColumn(
            "predicted",
            F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("predicted_index") + 1),
        )
        .withColumn("raw_confidence", F.array_max("class_probabilities"))
    )


def mean_cross_entropy(
    rows: DataFrame, labels: Sequence, *, logits: str = "logits", label: str = "label"
) -> DataFrame:
    """Mean cross-entropy of prototype logits against the true labels."""
    index = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label))
    loss = log_sum_exp(F.col(logits)) - F.element_at(F.col(logits), index.cast("int"))
    return rows.agg(F.avg(loss).alias("cross_entropy"), F.count(F.lit(1)).alias("rows"))


def class_covariance(
    rows: DataFrame, vector: str, dimension: int, label: str = "label"
) -> DataFrame:
    """Full population covariance cells per class and globally (label ``*``).

    The class means (one row per class) go to the tasks; a task adds up products
    around them in one pass over its vectors and sends one matrix per class, so
    no vector is shuffled and no class is hot.  The global matrix follows from
    the class matrices and means.  Returns ``label, n, i, j, covariance``.
    """
    named = rows.select(
        F.col(label).cast("string").alias("label"),
        F.transform(F.col(vector), lambda v: v.cast("double")).alias("x"),
    )
    found = class_statistics(named, "x", dimension).select("label", "n", "mean").collect()
    means = {r["label"]: np.asarray(r["mean"], dtype=np.float64) for r in found}
    counts = {r["label"]: r["n"] for r in found}
    total = max(sum(counts.values()), 1)
    middle = sum((counts[k] * m for k, m in means.items()), np.zeros(dimension)) / total
    kind = "label string, n bigint, cells array<double>"

    def table(sums: dict[str, list]) -> dict:
        return {
            "label": pa.array(list(sums), pa.string()),
            "n": pa.array([held[0] for held in sums.values()], pa.int64()),
            "cells": pa.array(
                [held[1].reshape(-1) for held in sums.values()], pa.list_(pa.float64())
            ),
        }

    def products(batches):
        sums: dict[str, list] = {}
        for batch in batches:
            names = np.asarray(batch.column("label").to_pylist(), dtype=object)
            x = np.asarray(batch.column("x").flatten()).reshape(-1, dimension)
            for name in set(names.tolist()):
                residuals = x[names == name] - means[name]
                held = sums.setdefault(name, [0, np.zeros((dimension, dimension))])
                held[0] += len(residuals)
                held[1] += residuals.T @ residuals
        if sums:
            yield pa.RecordBatch.from_pydict(table(sums))

    def added(parts: pa.Table) -> pa.Table:
        cells = np.sum([np.asarray(c) for c in parts.column("cells").to_pylist()], axis=0)
        name, n = parts.column("label")[0].as_py(), sum(parts.column("n").to_pylist())
        return pa.table(table({name: [n, cells]}))

    own = named.mapInArrow(products, kind).groupBy("label").applyInArrow(added, kind)
    shift = [(name, (mean - middle).tolist()) for name, mean in means.items()]
    spark = rows.sparkSession
    shifts = spark.createDataFrame(shift, "label string, shift array<double>")
    between = F.flatten(
        F.transform("shift", lambda a: F.transform("shift", lambda b: a * b * F.col("n")))
    )
    moved = own.join(F.broadcast(shifts), "label").select(  # one row per class
        F.lit(GLOBAL_LABEL).alias("label"),
        "n",
        F.zip_with("cells", between, lambda c, d: c + d).alias("cells"),
    )
    return (
        own.unionByName(moved)
        .select("label", "n", F.posexplode("cells").alias("cell", "product"))
        .groupBy("label", "cell")
        .agg(F.sum("n").alias("n"), F.sum("product").alias("product"))
        .select(
            "label",
            "n",
            F.floor(F.col("cell") / dimension).cast("int").alias("i"),
            F.pmod("cell", F.lit(dimension)).cast("int").alias("j"),
            (F.col("product") / F.col("n")).alias("covariance"),
        )
    )


def read_geometry(
    statistics: DataFrame,
    covariance: DataFrame,
    labels: Sequence,
    dimension: int,
    *,
    maximum_classes: int = MAXIMUM_CLASSES,
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Means and pseudo-inverse covariances of every class and of all rows.

    Driver-side state of ``(classes + 1) * D * D`` doubles, bounded by the class
    list.  Eigenvalues at or below ``D * eps(float32) * max`` count as zero.
    """
    if len(labels) > maximum_classes:
        raise ModelError(f"{len(labels)} classes given, at most {maximum_classes} are allowed")
    wanted = [str(v) for v in labels] + [GLOBAL_LABEL]
    means = {
        str(r["label"]): np.asarray(r["mean"], dtype=np.float64)
        for r in statistics.where(F.col("label").cast("string").isin(*wanted)).collect()
    }
    # One row per class: its cells in order as one array.
    packed = (
        covariance.where(F.col("label").isin(*wanted))
        .groupBy("label")
        .agg(
            F.max("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("i", "j", "covariance"))).alias("cells"),
        )
        .select("label", "n", F.col("cells.covariance").alias("cells"))
    )
    matrices, counts = {}, {}
    for r in packed.toLocalIterator():
        matrices[r["label"]] = np.asarray(r["cells"]).reshape(dimension, dimension)
        counts[r["label"]] = r["n"]
    geometry = {}
    for name in wanted:
        if counts.get(name, 0) < 2:
            raise ModelError(f"class {name} has fewer than two support rows")
        cutoff = dimension * float(np.finfo(np.float32).eps)
        geometry[name] = (
            means[name],
            np.linalg.pinv(matrices[name], rcond=cutoff, hermitian=True),
        )
    return geometry


@dataclass(frozen=True)
class _Geometry:
    """Stacked geometry: one slot per class name, the global one included."""

    slot: dict[str, int]
    means: np.ndarray
    precisions: np.ndarray

    @classmethod
    def of(cls, geometry: dict[str, tuple[np.ndarray, np.ndarray]]) -> _Geometry:
        names = sorted(geometry)
        return cls(
            {n: i for i, n in enumerate(names)},
            np.stack([geometry[n][0] for n in names]),
            np.stack([geometry[n][1] for n in names]),
        )

    def distance(self, x: np.ndarray, slot: int) -> np.ndarray:
        difference = x - self.means[slot]
        return np.einsum("nf,nf->n", difference @ self.precisions[slot], difference)

    def relative(self, x: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Distance to each row's own slot minus distance to all rows."""
        scores = -self.distance(x, self.slot[GLOBAL_LABEL])
        for slot in np.unique(slots):
            own = slots == slot
            scores[own] += self.distance(x[own], slot)
        return scores


def with_relative_mahalanobis(
    rows: DataFrame,
    geometry: dict[str, tuple[np.ndarray, np.ndarray]],
    *,
    vector: str,
    label: str,
    name: str = "relative_distance",
) -> DataFrame:
    """Distance to the row's class minus distance to all rows."""
    stacked = _Geometry.of(geometry)
    dimension = stacked.means.shape[1]

    @F.arrow_udf(T.DoubleType())
    def relative(vectors: pa.Array, labels: pa.Array) -> pa.Array:
        slots = np.array([stacked.slot[v] for v in labels.to_pylist()], dtype=np.int64)
        return pa.array(stacked.relative(_matrix(vectors, dimension), slots))

    return rows.withColumn(name, relative(F.col(vector), F.col(label).cast("string")))


def with_scores(
    rows: DataFrame,
    state: ClassState,
    geometry: dict[str, tuple[np.ndarray, np.ndarray]],
    *,
    vector: str,
) -> DataFrame:
    """Probabilities, predicted class and its relative distance, in one Arrow pass.

    Same values as :func:`with_mahalanobis`, :func:`with_prediction` and
    :func:`with_relative_mahalanobis` one after the other.
    """
    stacked = _Geometry.of(geometry)
    slots_of = np.array([stacked.slot[str(v)] for v in state.labels], dtype=np.int64)
    classes, dimension = state.means.shape
    result = (
        "struct<class_probabilities:array<double>,predicted_index:int,"
        "raw_confidence:double,relative_distance:double>"
    )

    @F.arrow_udf(result)
    def score(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors, dimension)
        logits = np.empty((len(x), classes))
        for k in range(classes):
            difference = x - state.means[k]
            logits[:, k] = -np.einsum("nf,nf,f->n", difference, difference, state.precisions[k])
        shares = np.exp(logits - logits.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        offsets = np.arange(0, (len(x) + 1) * classes, classes, dtype=np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(shares.reshape(-1))),
                pa.array(best.astype(np.int32)),
                pa.array(shares.max(axis=1)),
                pa.array(stacked.relative(x, slots_of[best])),
            ],
            names=[
                "class_probabilities",
                "predicted_index",
                "raw_confidence",
                "relative_distance",
            ],
        )

    names = F.array(*[F.lit(v) for v in state.labels])
    return (
        rows.withColumn("_s", score(F.col(vector)))
        .select(*rows.columns, "_s.*")
        .withColumn("predicted", F.element_at(names, F.col("predicted_index") + 1))
    )


def global_statistics(rows: DataFrame, vector: str, dimension: int, label: str = "label") -> DataFrame:
    """Class statistics plus one row over all classes, labels as text."""
    both = rows.select(
        F.explode(F.array(F.col(label).cast("string"), F.lit(GLOBAL_LABEL))).alias("label"), vector
    )
    return class_statistics(both, vector, dimension)


def embed(
    rows: DataFrame,
    layers: Sequence[tuple[np.ndarray, np.ndarray]],
    *,
    vector: str,
    name: str = "embedding",
) -> DataFrame:
    """Forward pass of a frozen dense network with a rectifier after every layer.

    ``layers`` are ``(weight[out, in], bias[out])`` in float32.
    """
    weights = [
        (np.ascontiguousarray(w, dtype=np.float32).T, np.asarray(b, dtype=np.float32))
        for w, b in layers
    ]
    width_in, width_out = weights[0][0].shape[0], weights[-1][0].shape[1]

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def forward(vectors: pa.Array) -> pa.Array:
        x = np.asarray(vectors.flatten(), dtype=np.float32).reshape(-1, width_in)
        for weight, bias in weights:
            x = np.maximum(x @ weight + bias, np.float32(0.0))
        offsets = np.arange(0, (len(x) + 1) * width_out, width_out, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))

    return rows.withColumn(name, forward(F.col(vector)))
