"""Registered queries on labeled vectors: baselines, prototypes, densities, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.permute import permuted_sql
from flowloom.operators import density, evaluate, model, splits
from flowloom.operators.summary import range_summary
from flowloom.plans.pipelines import calibrate, score_rows
from flowloom.plans.settings import as_float, float_sql, role_sql, table
from flowloom.schemas import ECE_BINS, EMBEDDING_DIMENSION, SUPPORT_SEED
from flowloom.session import cut_lineage

QUERIES = {}
SQL = {}
LABELS = tuple(range(10))
D = EMBEDDING_DIMENSION


def _register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors with their role, decided by the hash of the id."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        "label",
        "embedding",
        splits.hashed_partition(F.col("vec_id").cast("string")).alias("partition"),
    )


def role(df: DataFrame, name: str) -> DataFrame:
    """Rows of one role."""
    return df.where(F.col("partition") == name)


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Class statistics of the training rows."""
    return model.class_statistics(role(rows(spark, folder), "train"), "embedding", D)


def prototypes_scored(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with prototype logits and predictions."""
    state = model.class_state(statistics(spark, folder), LABELS)
    scored = model.with_logits(rows(spark, folder), state, "embedding")
    return model.with_prediction(scored, LABELS, F.col("logits"))


ROWS_SQL = f"""rows_in AS (
  SELECT vec_id AS row_id, label, embedding, {role_sql("vec_id::VARCHAR")} AS partition
  FROM embeddings),
cells AS (
  SELECT row_id, label, partition, unnest(embedding)::DOUBLE AS x,
    unnest(range({D}))::INTEGER AS i FROM rows_in),
stats AS (
  SELECT label, i, avg(x) AS mean, var_pop(x) AS variance, count(*) AS n
  FROM cells WHERE partition = 'train' GROUP BY 1, 2)"""

LOGITS_SQL = f"""{ROWS_SQL},
logits AS (
  SELECT c.row_id, any_value(c.label) AS label, any_value(c.partition) AS partition,
    s.label AS k, -sum((c.x - s.mean) * (c.x - s.mean)) AS logit
  FROM cells c JOIN stats s USING (i) GROUP BY c.row_id, s.label),
shifted AS (
  SELECT *, exp(logit - max(logit) OVER (PARTITION BY row_id)) AS e FROM logits),
probable AS (
  SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM shifted),
predicted AS (
  SELECT row_id, any_value(label) AS label, any_value(partition) AS partition,
    arg_max(k, p) AS predicted, max(p) AS confidence,
    max(CASE WHEN k = label THEN -logit END) AS own_distance,
    -max(logit) AS predicted_distance
  FROM probable GROUP BY row_id)"""


@_register(
    "standardize",
    f"""WITH {ROWS_SQL},
fitted AS (
  SELECT i, avg(x) AS m, sqrt(var_pop(x)) AS s FROM cells WHERE partition = 'train' GROUP BY 1)
SELECT row_id, i, {float_sql("(x - m) / CASE WHEN s = 0 THEN 1 ELSE s END")} AS value
FROM cells JOIN fitted USING (i)""",
)
def standardize_query(spark: SparkSession, folder: str) -> DataFrame:
    every = rows(spark, folder)
    scaler = model.fit_standardizer(role(every, "train"), "embedding", D)
    return model.standardize(every, scaler, "embedding").select(
        "row_id", F.posexplode("embedding").alias("i", "value")
    ).withColumn("value", F.col("value").cast("double"))


@_register(
    "majority_baseline",
    """WITH l AS (
  SELECT 'quality' AS source, quality AS label FROM labels
  UNION ALL SELECT 'toxic', toxic FROM labels
  UNION ALL SELECT 'embedding', label FROM embeddings),
c AS (SELECT source, label, count(*) AS rows FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rows DESC, label) AS rn,
  CAST(sum(rows) OVER (PARTITION BY source) AS BIGINT) AS total FROM c)
SELECT source, label, rows, total, rows / total::DOUBLE AS prior FROM r WHERE rn = 1""",
)
def majority_query(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    sources = {
        "quality": labels.select(F.col("quality").alias("label")),
        "toxic": labels.select(F.col("toxic").alias("label")),
        "embedding": table(spark, folder, "embeddings").select("label"),
    }
    found = None
    for name, source in sources.items():
        one = model.majority_class(source).withColumn("source", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


@_register(
    "class_weights",
    """WITH c AS (SELECT label, count(*) AS rows FROM embeddings GROUP BY 1)
SELECT label, rows, (SELECT sum(rows) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * rows) AS weight
FROM c""",
)
def class_weight_query(spark: SparkSession, folder: str) -> DataFrame:
    return model.class_weights(table(spark, folder, "embeddings"))


@_register("logistic_balanced")
def logistic_query(spark: SparkSession, folder: str) -> DataFrame:
    every = rows(spark, folder)
    training = role(every, "train")
    scaler = model.fit_standardizer(training, "embedding", D)
    scaled = model.standardize(every, scaler, "embedding")
    fitted = model.fit_balanced_logistic(role(scaled, "train"), LABELS, vector="embedding")
    predicted = model.predict_logistic(fitted, scaled, LABELS, vector="embedding")
    return predicted.select("row_id", "partition", "label", "predicted")


_EPISODES, _SUPPORT, _QUERIES = 3, 4, 64


@_register(
    "episode_sample",
    f"""WITH placed AS (
  SELECT vec_id AS row_id, label,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) AS in_class,
    row_number() OVER (ORDER BY vec_id) AS in_all
  FROM embeddings),
sizes AS (SELECT label, count(*) AS size FROM placed GROUP BY label),
total AS (SELECT sum(size)::BIGINT AS size, count(*) * {_SUPPORT} + {_QUERIES} AS enough FROM sizes),
e AS (SELECT unnest(range(1, {_EPISODES + 1}))::INTEGER AS episode),
class_draws AS (
  SELECT *, '{SUPPORT_SEED}:' || episode || ':class' || label AS key
  FROM (SELECT *, unnest(range(0, least({_SUPPORT}, size))) AS step FROM sizes, e)),
support AS (
  SELECT episode, row_id, d.label
  FROM (SELECT *, {permuted_sql("step", "size", "key")} + 1 AS place FROM class_draws) d
  JOIN placed p ON p.label = d.label AND in_class = place),
all_draws AS (
  SELECT *, '{SUPPORT_SEED}:' || episode || ':all' AS key
  FROM (SELECT *, unnest(range(0, least(enough, size))) AS step FROM total, e)),
others AS (
  SELECT d.episode, p.row_id, p.label,
    row_number() OVER (PARTITION BY d.episode ORDER BY step) AS rank
  FROM (SELECT *, {permuted_sql("step", "size", "key")} + 1 AS place FROM all_draws) d
  JOIN placed p ON in_all = place
  LEFT JOIN support s ON s.episode = d.episode AND s.row_id = p.row_id
  WHERE s.row_id IS NULL)
SELECT episode, 'support' AS role, row_id, label FROM support
UNION ALL SELECT episode, 'query', row_id, label FROM others WHERE rank <= {_QUERIES}""",
)
def episode_query(spark: SparkSession, folder: str) -> DataFrame:
    return model.sample_episodes(
        table(spark, folder, "embeddings").withColumnRenamed("vec_id", "row_id"),
        episodes=_EPISODES,
        support_per_class=_SUPPORT,
        queries=_QUERIES,
    )


@_register(
    "support_selection",
    f"""WITH r AS (
  SELECT vec_id AS row_id, label, row_number() OVER (PARTITION BY label
    ORDER BY sha256('{SUPPORT_SEED}:' || vec_id), vec_id) AS n FROM embeddings)
SELECT row_id, label FROM r WHERE n <= 20""",
)
def support_query(spark: SparkSession, folder: str) -> DataFrame:
    return model.select_support(
        table(spark, folder, "embeddings").withColumnRenamed("vec_id", "row_id"),
        maximum_per_class=20,
    ).select("row_id", "label")


@_register(
    "prototypes",
    f"""WITH {ROWS_SQL}
SELECT label, n, i, {float_sql("mean")} AS mean FROM stats""",
)
def prototype_query(spark: SparkSession, folder: str) -> DataFrame:
    return (
        statistics(spark, folder)
        .select("label", "n", F.posexplode("mean").alias("i", "mean"))
        .withColumn("mean", as_float(F.col("mean")))
    )


@_register(
    "class_variance",
    f"""WITH {ROWS_SQL}
SELECT label, i, {float_sql("variance")} AS variance FROM stats""",
)
def class_variance_query(spark: SparkSession, folder: str) -> DataFrame:
    return (
        statistics(spark, folder)
        .select("label", F.posexplode("variance").alias("i", "variance"))
        .withColumn("variance", as_float(F.col("variance")))
    )


@_register(
    "sq_euclid_logits",
    f"WITH {LOGITS_SQL} SELECT row_id, k, {float_sql('logit')} AS logit FROM logits",
)
def logit_query(spark: SparkSession, folder: str) -> DataFrame:
    state = model.class_state(statistics(spark, folder), LABELS)
    scored = model.with_logits(rows(spark, folder), state, "embedding")
    return scored.select("row_id", F.posexplode("logits").alias("k", "logit")).withColumn(
        "logit", as_float(F.col("logit"))
    )


@_register(
    "prototype_probs",
    f"""WITH {LOGITS_SQL}
SELECT row_id, predicted.label, predicted, k, {float_sql("p")} AS probability
FROM probable JOIN predicted USING (row_id)""",
)
def probability_query(spark: SparkSession, folder: str) -> DataFrame:
    return (
        prototypes_scored(spark, folder)
        .select(
            "row_id",
            "label",
            "predicted",
            F.posexplode("class_probabilities").alias("k", "probability"),
        )
        .withColumn("probability", as_float(F.col("probability")))
    )


@_register(
    "proto_cross_entropy",
    f"""WITH {LOGITS_SQL},
loss AS (
  SELECT row_id, any_value(partition) AS partition, max(logit) AS top,
    ln(sum(e)) + max(logit) - max(CASE WHEN k = label THEN logit END) AS loss
  FROM shifted GROUP BY row_id)
SELECT partition, {float_sql("avg(loss)")} AS cross_entropy, count(*) AS rows
FROM loss GROUP BY 1""",
)
def cross_entropy_query(spark: SparkSession, folder: str) -> DataFrame:
    scored = prototypes_scored(spark, folder)
    per_role = [
        model.mean_cross_entropy(role(scored, name), LABELS).withColumn(
            "partition", F.lit(name)
        )
        for name in ("train", "validation", "calibration", "test")
    ]
    whole = per_role[0]
    for one in per_role[1:]:
        whole = whole.unionByName(one)
    return whole.withColumn("cross_entropy", as_float(F.col("cross_entropy")))


# Dimension 7 is cleared so that the cutoff of the pseudo-inverse is met.
@_register(
    "diag_mahalanobis",
    f"""WITH {ROWS_SQL.replace("unnest(embedding)::DOUBLE AS x", "unnest(list_transform(embedding, lambda v, j: CASE WHEN j = 8 THEN 0.25 ELSE v END))::DOUBLE AS x")},
bounded AS (
  SELECT label, i, mean, CASE WHEN variance > {D} * pow(2::DOUBLE, -23)
    * max(variance) OVER (PARTITION BY label) THEN 1 / variance ELSE 0 END AS precision
  FROM stats)
SELECT c.row_id, b.label AS k,
  {float_sql("sum((c.x - b.mean) * (c.x - b.mean) * b.precision)")} AS distance
FROM cells c JOIN bounded b USING (i) GROUP BY 1, 2""",
)
def diagonal_query(spark: SparkSession, folder: str) -> DataFrame:
    every = rows(spark, folder).withColumn(
        "embedding",
        F.transform(
            "embedding",
            lambda v, i: F.when(i == 7, F.lit(0.25)).otherwise(v.cast("double")),
        ),
    )
    fitted = model.class_statistics(role(every, "train"), "embedding", D)
    state = model.class_state(fitted, LABELS)
    scored = model.with_mahalanobis(every, state, "embedding")
    return scored.select("row_id", F.posexplode("distances").alias("k", "distance")).withColumn(
        "distance", as_float(F.col("distance"))
    )


@_register(
    "class_covariance",
    f"""WITH {ROWS_SQL},
twofold AS (
  SELECT row_id, label::VARCHAR AS label, i, x FROM cells WHERE partition = 'train'
  UNION ALL SELECT row_id, '*', i, x FROM cells WHERE partition = 'train'),
centred AS (SELECT *, x - avg(x) OVER (PARTITION BY label, i) AS r FROM twofold)
SELECT a.label, count(*) AS n, a.i, b.i AS j, round(avg(a.r * b.r), 6) + 0.0 AS covariance
FROM centred a JOIN centred b ON a.label = b.label AND a.row_id = b.row_id
GROUP BY a.label, a.i, b.i""",
)
def covariance_query(spark: SparkSession, folder: str) -> DataFrame:
    cells = model.class_covariance(role(rows(spark, folder), "train"), "embedding", D)
    return cells.withColumn("covariance", F.round("covariance", 6) + F.lit(0.0))


def _geometry(spark: SparkSession, folder: str):
    training = role(rows(spark, folder), "train")
    return model.read_geometry(
        model.global_statistics(training, "embedding", D),
        model.class_covariance(training, "embedding", D),
        LABELS,
        D,
    )


@_register("relative_mahalanobis")
def relative_query(spark: SparkSession, folder: str) -> DataFrame:
    scored = model.with_relative_mahalanobis(
        rows(spark, folder), _geometry(spark, folder), vector="embedding", label="label"
    )
    return scored.select("row_id", "label", F.round("relative_distance", 4).alias("relative"))


def _own_distance(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with the squared distance to their own and predicted prototype."""
    scored = prototypes_scored(spark, folder)
    return scored.select(
        "row_id",
        "label",
        "partition",
        "predicted",
        "raw_confidence",
        (-F.element_at("logits", F.col("label") + 1)).alias("own_distance"),
        (-F.array_max("logits")).alias("relative_distance"),
    )


KDE_SQL = f"""{LOGITS_SQL},
samples AS (
  SELECT label, own_distance AS s FROM predicted WHERE partition = 'calibration'),
fitted AS (
  SELECT label, count(*) AS n, min(s) AS minimum, max(s) AS maximum, avg(s) AS mean,
    stddev_samp(s) AS deviation, stddev_samp(s) * pow(count(*), -0.2::DOUBLE) AS bandwidth
  FROM samples GROUP BY 1)"""


def _ndtr_sql(z: str) -> str:
    """Normal distribution function in the published closed form."""
    top = "0.0352624965998911::DOUBLE"
    for c in (0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
              221.213596169931, 220.206867912376):
        top = f"({top} * abs({z}) + {c}::DOUBLE)"
    low = "0.0883883476483184::DOUBLE"
    for c in (1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
              637.333633378831, 793.826512519948, 440.413735824752):
        low = f"({low} * abs({z}) + {c}::DOUBLE)"
    chain = f"(abs({z}) + 0.65::DOUBLE)"
    for c in (4, 3, 2, 1):
        chain = f"(abs({z}) + {c}::DOUBLE / {chain})"
    tail = f"""(CASE WHEN abs({z}) > 37 THEN 0.0::DOUBLE
      WHEN abs({z}) < 7.07106781186547::DOUBLE THEN exp(-{z} * {z} / 2) * {top} / {low}
      ELSE exp(-{z} * {z} / 2) / {chain} / 2.506628274631::DOUBLE END)"""
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


@_register(
    "kde_fit",
    f"""WITH {KDE_SQL}
SELECT label, n, {", ".join(f"{float_sql(c)} AS {c}" for c in
    ("minimum", "maximum", "mean", "deviation", "bandwidth"))} FROM fitted""",
)
def kde_fit_query(spark: SparkSession, folder: str) -> DataFrame:
    samples = role(_own_distance(spark, folder), "calibration")
    fitted = density.fit_densities(samples, score="own_distance")
    return fitted.select(
        "label",
        "n",
        *[
            as_float(F.col(c)).alias(c)
            for c in ("minimum", "maximum", "mean", "deviation", "bandwidth")
        ],
    )


def ood_scored(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with the density score of their predicted class."""
    distances = _own_distance(spark, folder)
    samples = role(distances, "calibration")
    fitted = density.fit_densities(samples, score="own_distance")
    blocks = density.density_blocks(samples, fitted, score="own_distance")
    return density.with_ood_score(distances, blocks)


SCORED_SQL = f"""{KDE_SQL},
scored AS (
  SELECT p.row_id, p.label, p.partition, p.predicted, p.confidence,
    avg({_ndtr_sql("((p.predicted_distance - s.s) / f.bandwidth)")}) AS ood
  FROM predicted p LEFT JOIN fitted f ON f.label = p.predicted AND f.n >= 2
  LEFT JOIN samples s ON s.label = f.label GROUP BY 1, 2, 3, 4, 5)"""


@_register(
    "kde_ood_score",
    f"WITH {SCORED_SQL} SELECT row_id, predicted, round(ood, 8) AS ood_score FROM scored",
)
def kde_score_query(spark: SparkSession, folder: str) -> DataFrame:
    return ood_scored(spark, folder).select(
        "row_id", "predicted", F.round("ood_score", 8).alias("ood_score")
    )


@_register("score_batch")
def score_batch_query(spark: SparkSession, folder: str) -> DataFrame:
    every = rows(spark, folder)
    frozen = calibrate(
        role(every, "train"), role(every, "calibration"), LABELS, vector="embedding", dimension=D
    )
    scored = score_rows(every, frozen, vector="embedding")
    return scored.select(
        "row_id",
        "label",
        "predicted",
        F.round("raw_confidence", 5).alias("raw_confidence"),
        F.round("relative_distance", 3).alias("relative_distance"),
        F.round("ood_score", 5).alias("ood_score"),
    )


def _confusion(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_counts(prototypes_scored(spark, folder), LABELS)


CONFUSION_SQL = f"""{LOGITS_SQL},
names AS (SELECT unnest(range({len(LABELS)}))::INTEGER AS label),
confusion AS (
  SELECT a.label AS expected, b.label AS predicted, count(p.row_id) AS rows
  FROM names a CROSS JOIN names b
  LEFT JOIN predicted p ON p.label = a.label AND p.predicted = b.label GROUP BY 1, 2),
metrics AS (
  SELECT n.label,
    (SELECT sum(rows) FROM confusion WHERE expected = n.label) AS support,
    (SELECT sum(rows) FROM confusion WHERE predicted = n.label) AS claimed,
    (SELECT sum(rows) FROM confusion WHERE predicted = n.label AND expected = n.label) AS hits
  FROM names n),
rated AS (
  SELECT *, CASE WHEN claimed = 0 THEN 0.0::DOUBLE ELSE hits / claimed::DOUBLE END AS precision,
    CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hits / support::DOUBLE END AS recall,
    CASE WHEN support + claimed = 0 THEN 0.0::DOUBLE
      ELSE 2 * hits / (support + claimed)::DOUBLE END AS f1
  FROM metrics)"""


@_register("confusion", f"WITH {CONFUSION_SQL} SELECT * FROM confusion")
def confusion_query(spark: SparkSession, folder: str) -> DataFrame:
    return _confusion(spark, folder)


@_register(
    "class_metrics",
    f"""WITH {CONFUSION_SQL}
SELECT label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM rated""",
)
def class_metric_query(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.class_metrics(_confusion(spark, folder)).drop("hits", "claimed")


@_register(
    "overall_metrics",
    f"""WITH {CONFUSION_SQL}
SELECT sum(hits)::DOUBLE / sum(support) AS accuracy,
  {float_sql("avg(CASE WHEN support > 0 THEN recall END)")} AS balanced_accuracy,
  2 * sum(hits)::DOUBLE / (sum(claimed) + sum(support)) AS micro_f1,
  {float_sql("avg(f1)")} AS macro_f1 FROM rated""",
)
def overall_metric_query(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate.overall_metrics(evaluate.class_metrics(_confusion(spark, folder)))
    return found.withColumns(
        {c: as_float(F.col(c)) for c in ("balanced_accuracy", "macro_f1")}
    )


@_register(
    "ece",
    f"""WITH {LOGITS_SQL},
binned AS (
  SELECT least(CAST(floor(confidence * {ECE_BINS}) AS INTEGER), {ECE_BINS - 1}) AS bin,
    count(*) AS n, avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END) AS a,
    avg(confidence) AS c FROM predicted GROUP BY 1)
SELECT {float_sql("sum(n * abs(a - c)) / sum(n)")} AS expected_calibration_error,
  CAST(sum(n) AS BIGINT) AS rows FROM binned""",
)
def ece_query(spark: SparkSession, folder: str) -> DataFrame:
    binned = evaluate.calibration_bins(prototypes_scored(spark, folder))
    return evaluate.expected_calibration_error(binned).withColumn(
        "expected_calibration_error", as_float(F.col("expected_calibration_error"))
    )


@_register(
    "score_summary",
    f"""WITH {SCORED_SQL}
SELECT {", ".join(f"round({v}, 7) AS {c}" for c, v in (
    ("minimum", "min(ood)"), ("quantile_05", "quantile_cont(ood, 0.05)"),
    ("median", "quantile_cont(ood, 0.5)"), ("quantile_95", "quantile_cont(ood, 0.95)"),
    ("quantile_99", "quantile_cont(ood, 0.99)"), ("maximum", "max(ood)"),
    ("mean", "avg(ood)")))} FROM scored""",
)
def score_summary_query(spark: SparkSession, folder: str) -> DataFrame:
    scores = cut_lineage(ood_scored(spark, folder).select("ood_score"))
    found = evaluate.score_summary(scores)
    return found.select(*[F.round(c, 7).alias(c) for c in found.columns])


@_register(
    "flag_rates",
    f"""WITH {SCORED_SQL},
t AS (SELECT unnest([0.95, 0.99])::DOUBLE AS threshold),
f AS (SELECT threshold, label::VARCHAR AS label, (coalesce(ood, 0) >= threshold)::INTEGER AS hit
  FROM scored, t)
SELECT threshold, label, count(*) AS windows, CAST(sum(hit) AS BIGINT) AS flagged_windows,
  sum(hit)::DOUBLE / count(*) AS false_positive_rate FROM f GROUP BY 1, 2
UNION ALL SELECT threshold, 'all', count(*), CAST(sum(hit) AS BIGINT), sum(hit)::DOUBLE / count(*)
FROM f GROUP BY 1""",
)
def flag_rate_query(spark: SparkSession, folder: str) -> DataFrame:
    scored = ood_scored(spark, folder).withColumn(
        "ood_score", F.coalesce("ood_score", F.lit(0.0))
    )
    return evaluate.flag_rates(scored)


@_register(
    "density_summary",
    f"""WITH {SCORED_SQL}
SELECT predicted, count(ood) AS values, {", ".join(f"round({v}, 7) AS {c}" for c, v in (
    ("minimum", "coalesce(min(ood), 0)"), ("maximum", "coalesce(max(ood), 0)"),
    ("mean", "coalesce(avg(ood), 0)"), ("std_dev", "coalesce(stddev_pop(ood), 0)")))}
FROM scored GROUP BY 1""",
)
def density_summary_query(spark: SparkSession, folder: str) -> DataFrame:
    found = range_summary(ood_scored(spark, folder), "ood_score", "predicted")
    return found.select(
        "predicted",
        "values",
        *[F.round(c, 7).alias(c) for c in ("minimum", "maximum", "mean", "std_dev")],
    )

