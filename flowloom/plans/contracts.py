"""Registered queries on contracts, reports, frozen models and feature parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import density, evaluate, features, model, moments, validate, windows
from flowloom.plans import frozen as store
from flowloom.plans.pipelines import calibrate, evaluate_scores, score_rows
from flowloom.plans.scoring import (
    CONFUSION_SQL,
    LABELS,
    ROWS_SQL,
    D,
    _geometry,
    _own_distance,
    ood_scored,
    role,
    rows,
    statistics,
)
from flowloom.plans.settings import (
    ACTIVITY,
    BIN,
    MINIMUM,
    WINDOW,
    WINDOWED_SQL,
    as_float,
    assigned,
    float_sql,
    role_sql,
)
from flowloom.schemas import CATEGORIES, FEATURE_COLUMNS, SUPPORT_PER_CLASS
from flowloom.session import cut_lineage, scratch_path
from flowloom.sinks import tables

QUERIES = {}
SQL = {}


def _register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def _counted(contract: str, violations: DataFrame) -> DataFrame:
    found = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.lit(contract).alias("contract"), "rule", "n")


_ROLE = "CASE WHEN vec_id % 20 < 12 THEN 'train' ELSE 'other' END"


@_register(
    "contract_violations",
    f"""WITH e AS (SELECT vec_id, label, {_ROLE} AS part FROM embeddings),
fired AS (
  SELECT 'partition' AS contract, 'partition_role' AS rule FROM e WHERE part <> 'train'
  UNION ALL SELECT 'partition', 'vector_length' FROM e WHERE vec_id % 17 = 3
  UNION ALL SELECT 'partition', 'vector_not_finite' FROM e WHERE vec_id % 19 = 5
  UNION ALL SELECT 'partition', 'category_unknown' FROM e WHERE vec_id % 23 = 7
  UNION ALL SELECT 'partition', 'capture_id_empty' FROM e WHERE vec_id % 29 = 1
  UNION ALL SELECT 'state', 'support_count' FROM (SELECT DISTINCT label FROM e WHERE label = 2)
  UNION ALL SELECT 'state', 'variance_negative' FROM (SELECT DISTINCT label FROM e WHERE label = 4)
  UNION ALL SELECT 'geometry', 'not_symmetric' FROM (SELECT DISTINCT label FROM e WHERE label < 2)
  UNION ALL SELECT 'geometry', 'diagonal_negative' FROM (SELECT DISTINCT label FROM e WHERE label = 5)
  UNION ALL SELECT 'density', 'bandwidth_not_reproduced'
    FROM (SELECT DISTINCT label FROM e WHERE label = 3))
SELECT contract, rule, count(*) AS n FROM fired GROUP BY 1, 2""",
)
def contract_query(spark: SparkSession, folder: str) -> DataFrame:
    """Broken modeling rows, class state, covariances and densities are reported."""
    n = F.col("row_id")
    every = rows(spark, folder).withColumns(
        {
            "partition": F.when(F.pmod(n, F.lit(20)) < 12, F.lit("train")).otherwise(F.lit("other")),
            "category": F.when(F.pmod(n, F.lit(23)) == 7, F.lit("OTHER")).otherwise(
                F.element_at(
                    F.array(*[F.lit(c) for c in CATEGORIES]),
                    (F.pmod("label", F.lit(len(CATEGORIES))) + 1).cast("int"),
                )
            ),
            "capture_id": F.when(F.pmod(n, F.lit(29)) == 1, F.lit("")).otherwise(F.lit("c")),
        }
    )
    vector = F.col("embedding")
    vector = F.when(
        F.pmod(n, F.lit(19)) == 5, F.transform(vector, lambda v, i: F.when(i == 5, F.lit(float("nan"))).otherwise(v))
    ).otherwise(vector)
    broken = every.withColumn("embedding", vector).withColumn(
        "embedding",
        F.when(F.pmod(n, F.lit(17)) == 3, F.slice("embedding", 1, D - 1)).otherwise(F.col("embedding")),
    )
    found = _counted(
        "partition", validate.partition_violations(broken, "train", dimension=D, vector="embedding")
    )
    state = statistics(spark, folder).withColumns(
        {
            "n": F.when(F.col("label") == 2, F.lit(1)).otherwise(F.lit(5)),
            "variance": F.when(
                F.col("label") == 4, F.transform("variance", lambda v: v - F.lit(1e9))
            ).otherwise(F.col("variance")),
        }
    )
    scaler = spark.createDataFrame([([0.0], [1.0])], "mean array<double>, scale array<double>")
    found = found.unionByName(
        _counted("state", validate.state_violations(state, scaler, maximum_support=5, dimension=D))
    )
    summed = moments.class_moments(role(rows(spark, folder), "train"), "embedding", D, ["label"])
    i, j, label = F.col("i"), F.col("j"), F.col("label")
    cells = moments.covariance_cells(summed, D).withColumn(
        "covariance",
        F.when((label == "0") & (i == 0) & (j == 1), F.lit(9.0))
        .when((label == "5") & (i == 0) & (j == 0), F.lit(-1.0))
        .otherwise(F.col("covariance")),
    )
    found = found.unionByName(_counted("geometry", validate.geometry_violations(cells)))
    samples = role(_own_distance(spark, folder), "calibration")
    fitted = density.fit_densities(samples, score="own_distance").withColumn(
        "bandwidth", F.col("bandwidth") * F.when(F.col("label") == 3, 2.0).otherwise(1.0)
    )
    return found.unionByName(_counted("density", validate.density_violations(fitted, samples)))


@_register(
    "evaluation_report",
    f"""WITH {CONFUSION_SQL}
SELECT 'report-1' AS schema_version, 'all' AS partition, sum(hits)::DOUBLE / sum(support)
    AS accuracy, {float_sql("avg(CASE WHEN support > 0 THEN recall END)")} AS balanced_accuracy,
  2 * sum(hits)::DOUBLE / (sum(claimed) + sum(support)) AS micro_f1,
  {float_sql("avg(f1)")} AS macro_f1 FROM rated""",
)
def report_query(spark: SparkSession, folder: str) -> DataFrame:
    """All evaluation tables of a scored set, written as a report and read back."""
    found = evaluate_scores(ood_scored(spark, folder), LABELS)
    report = store.evaluation_report(found, schema_version="report-1", partition="all")
    path = f"{scratch_path(spark, 'report')}.json"
    tables.write_report(report, path)
    overall = F.element_at("results.overall_metrics", 1)
    return spark.read.json(path).select(
        "schema_version",
        F.col("evaluation_partition").alias("partition"),
        overall["accuracy"].alias("accuracy"),
        as_float(overall["balanced_accuracy"]).alias("balanced_accuracy"),
        overall["micro_f1"].alias("micro_f1"),
        as_float(overall["macro_f1"]).alias("macro_f1"),
    )


@_register(
    "mahalanobis_totals",
    f"""WITH {ROWS_SQL}, c AS (
  SELECT label, count(DISTINCT row_id) AS n FROM cells WHERE partition = 'train' GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows,
  round((sum(n * least(n - 1, {D})) - sum(n) * least(sum(n) - 1, {D}))::DOUBLE, 2) AS total FROM c""",
)
def mahalanobis_query(spark: SparkSession, folder: str) -> DataFrame:
    """Over the rows a covariance was fitted on, squared distances sum to rows
    times rank; so the sum of the relative distances is known."""
    scored = model.with_relative_mahalanobis(
        role(rows(spark, folder), "train"),
        _geometry(spark, folder),
        vector="embedding",
        label="label",
    )
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("relative_distance"), 2).alias("total")
    )


@_register(
    "frozen_model",
    f"""WITH {ROWS_SQL}, c AS (
  SELECT label, least(count(DISTINCT row_id), {SUPPORT_PER_CLASS}) AS n FROM cells
  WHERE partition = 'train' GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS support,
  round((sum(n * least(n - 1, {D})) - sum(n) * least(sum(n) - 1, {D}))::DOUBLE, 2) AS total,
  (SELECT count(*) FROM embeddings) AS rows, 0::BIGINT AS different FROM c""",
)
def frozen_query(spark: SparkSession, folder: str) -> DataFrame:
    """A model that was stored and loaded scores every row as before.

    Over the rows it was fitted on, the loaded model's squared distances sum to rows
    times rank, so the sum of their relative distances is known.
    """
    every = rows(spark, folder)
    fitted = calibrate(
        role(every, "train"), role(every, "calibration"), LABELS, vector="embedding", dimension=D
    )
    path = scratch_path(spark, "model")
    hashes = {name: name for name in store.PROVENANCE}
    store.save_model(fitted, path, hashes)
    loaded = store.load_model(spark, path, expected=hashes)
    shown = ("predicted", "raw_confidence", "relative_distance", "ood_score")
    before, after = (
        score_rows(every, m, vector="embedding").select(
            "row_id", F.struct(*shown).alias(name)
        )
        for m, name in ((fitted, "before"), (loaded, "after"))
    )
    both = before.join(after, "row_id", "full")
    counted = both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("different"),
    )
    scored = model.with_relative_mahalanobis(
        model.select_support(role(every, "train")),
        loaded.geometry,
        vector="embedding",
        label="label",
    )
    fitted_on = scored.agg(
        F.count(F.lit(1)).alias("support"),
        F.round(F.sum("relative_distance"), 2).alias("total"),
    )
    one = F.lit(1)
    return (
        fitted_on.withColumn("_one", one).join(counted.withColumn("_one", one), "_one").drop("_one")
    )


@_register(
    "moments_without_capture",
    f"""WITH {ROWS_SQL},
twofold AS (
  SELECT row_id, label::VARCHAR AS label, i, x FROM cells
  WHERE partition = 'train' AND row_id % 5 <> 3
  UNION ALL SELECT row_id, '*', i, x FROM cells WHERE partition = 'train' AND row_id % 5 <> 3),
centred AS (SELECT *, x - avg(x) OVER (PARTITION BY label, i) AS r FROM twofold)
SELECT a.label, count(*) AS n, a.i, b.i AS j, round(avg(a.r * b.r), 6) + 0.0 AS covariance
FROM centred a JOIN centred b ON a.label = b.label AND a.row_id = b.row_id
GROUP BY a.label, a.i, b.i""",
)
def moments_query(spark: SparkSession, folder: str) -> DataFrame:
    """Moments per class and capture, merged and with one capture taken away again."""
    training = role(rows(spark, folder), "train").withColumn(
        "capture_id", F.pmod("row_id", F.lit(5)).cast("string")
    )
    apart = cut_lineage(moments.class_moments(training, "embedding", D))
    rest = moments.without(
        moments.merged(apart), moments.merged(apart.where("capture_id = '3'"))
    )
    cells = moments.covariance_cells(moments.with_global(rest), D)
    return cells.withColumn("covariance", F.round("covariance", 6) + F.lit(0.0))


@_register(
    "support_violations",
    f"""WITH e AS (SELECT vec_id, label, {role_sql("vec_id::VARCHAR")} AS part FROM embeddings),
gone AS (SELECT DISTINCT label FROM e WHERE part = 'train' AND label = 2 AND vec_id % 3 = 0)
SELECT rule, label::VARCHAR AS key FROM gone,
  (SELECT unnest(['support_count', 'mean', 'variance', 'moments', 'moment_count']) AS rule)""",
)
def support_query(spark: SparkSession, folder: str) -> DataFrame:
    """Stored class state that the support rows no longer reproduce is reported."""
    training = role(rows(spark, folder), "train")
    left = training.where("label <> 2 OR row_id % 3 <> 0")
    stored, rebuilt = (
        moments.class_moments(part, "embedding", D, ["label"]) for part in (training, left)
    )
    found = moments.moment_violations(stored, rebuilt).withColumn(
        "rule", F.when(F.col("rule") == "support_count", "moment_count").otherwise(F.col("rule"))
    )
    statistics_found = validate.support_violations(
        model.class_statistics(training, "embedding", D),
        model.class_statistics(left, "embedding", D),
    )
    return found.select("rule", "key").unionByName(statistics_found.select("rule", "key"))


@_register(
    "feature_parity",
    f"""WITH {WINDOWED_SQL},
held AS (
  SELECT capture_id, flow_id, window_index FROM windowed GROUP BY 1, 2, 3
  HAVING count(*) > {MINIMUM})
SELECT count(*) AS windows, 0::BIGINT AS missing_left, 0::BIGINT AS missing_right,
  0.0::DOUBLE AS maximum_difference FROM held""",
)
def parity_query(spark: SparkSession, folder: str) -> DataFrame:
    """Features from packets equal those from stored window arrays."""
    packets = cut_lineage(assigned(spark, folder))
    options = dict(
        window_seconds=WINDOW, bin_seconds=BIN, activity_timeout=ACTIVITY, minimum_packets=MINIMUM
    )
    direct = features.feature_vectors(windows.window_packets(packets, WINDOW), **options)
    arrays = windows.observation_windows(packets, window_seconds=WINDOW, minimum_packets=MINIMUM)
    again = features.feature_vectors(windows.packets_of_windows(arrays), **options)
    return evaluate.feature_parity(direct, again, FEATURE_COLUMNS)
