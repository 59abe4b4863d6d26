"""Registered queries on window features, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.labels import capture_labels
from flowloom.operators import features, summary, wavelet
from flowloom.operators.windows import WINDOW_KEY
from flowloom.plans.settings import (
    ACTIVITY,
    BIN,
    MINIMUM,
    WINDOW,
    WINDOWED_SQL,
    as_float,
    category_sql,
    float_sql,
    labels_sql,
    windowed,
)
from flowloom.schemas import (
    ACTIVE_IDLE_COLUMNS,
    AGGREGATE_COLUMNS,
    FEATURE_COLUMNS,
    IAT_COLUMNS,
    LOG_EPSILON,
    WAVELET_BANDS,
    WAVELET_FAMILIES,
    WAVELET_LEVELS,
)

QUERIES = {}
SQL = {}


def _register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def _statistics(spark: SparkSession, folder: str, columns, **options) -> DataFrame:
    found = features.flow_statistics(
        windowed(spark, folder),
        window_seconds=WINDOW,
        minimum_packets=MINIMUM,
        activity_timeout=options.pop("activity_timeout", ACTIVITY),
        **options,
    )
    return found.select(
        *WINDOW_KEY, "packet_count", *[as_float(F.col(c)).alias(c) for c in columns]
    )


_HELD = f"""held AS (
  SELECT capture_id, flow_id, window_index, count(*) AS packet_count FROM windowed
  GROUP BY 1, 2, 3 HAVING count(*) > {MINIMUM})"""


def _range_sql(prefix: str, gap: str) -> str:
    return ", ".join(
        f"{float_sql(f'coalesce({fn}({gap}), 0.0::DOUBLE)')} AS {prefix}_{stat}"
        for stat, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std_dev", "stddev_pop"))
    )


_IAT_SQL = f"""WITH {WINDOWED_SQL}, {_HELD},
gaps AS (
  SELECT capture_id, flow_id, window_index,
    off - lag(off) OVER (PARTITION BY capture_id, flow_id, window_index ORDER BY packet_number)
      AS flow_gap,
    off - lag(off) OVER (PARTITION BY capture_id, flow_id, window_index, direction
      ORDER BY packet_number) AS side_gap, direction
  FROM windowed)
SELECT capture_id, flow_id, window_index, any_value(h.packet_count) AS packet_count,
  {_range_sql("out_iat", "CASE WHEN direction = 1 THEN side_gap END")},
  {_range_sql("in_iat", "CASE WHEN direction = 0 THEN side_gap END")},
  {_range_sql("flow_iat", "flow_gap")}
FROM gaps JOIN held h USING (capture_id, flow_id, window_index)
GROUP BY capture_id, flow_id, window_index"""


@_register("iat_features", _IAT_SQL)
def iat_query(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(spark, folder, IAT_COLUMNS)


def _active_sql(timeout: float) -> str:
    return f"""WITH {WINDOWED_SQL}, {_HELD},
steps AS (
  SELECT capture_id, flow_id, window_index, packet_number, off,
    off - lag(off) OVER w AS gap
  FROM windowed
  WINDOW w AS (PARTITION BY capture_id, flow_id, window_index ORDER BY packet_number)),
islands AS (
  SELECT *, sum(CASE WHEN gap > {timeout}::DOUBLE THEN 1 ELSE 0 END) OVER (
    PARTITION BY capture_id, flow_id, window_index ORDER BY packet_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM steps),
spans AS (
  SELECT capture_id, flow_id, window_index, island, max(off) - min(off) AS active
  FROM islands GROUP BY 1, 2, 3, 4),
active_part AS (
  SELECT capture_id, flow_id, window_index, {_range_sql("active", "active")}
  FROM (SELECT capture_id, flow_id, window_index,
    CASE WHEN active > 0 THEN active END AS active FROM spans) GROUP BY 1, 2, 3),
idle_part AS (
  SELECT capture_id, flow_id, window_index,
    {_range_sql("idle", f"CASE WHEN gap > {timeout}::DOUBLE THEN gap - {timeout}::DOUBLE END")}
  FROM steps GROUP BY 1, 2, 3)
SELECT * FROM held JOIN active_part USING (capture_id, flow_id, window_index)
JOIN idle_part USING (capture_id, flow_id, window_index)"""


@_register("active_idle_features", _active_sql(ACTIVITY))
def active_idle_query(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(spark, folder, ACTIVE_IDLE_COLUMNS)


@_register("active_idle_default_timeout", _active_sql(5.0))
def active_idle_default_query(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(spark, folder, ACTIVE_IDLE_COLUMNS, activity_timeout=5.0)


def _logged_sql(value: str) -> str:
    return f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE ln({value} + {LOG_EPSILON}::DOUBLE) END"


def _aggregate_sql(corrected: bool) -> str:
    out_n, in_n = "sum(direction)", "sum(1 - direction)"
    out_b = "sum(size * direction)" if corrected else out_n
    in_b = "sum(size * (1 - direction))" if corrected else in_n
    values = (
        f"ln(sum(size) / {WINDOW}::DOUBLE)",
        _logged_sql(out_n),
        _logged_sql(in_n),
        _logged_sql(out_b),
        _logged_sql(in_b),
    )
    columns = ", ".join(
        f"{float_sql(v)} AS {c}" for v, c in zip(values, AGGREGATE_COLUMNS, strict=True)
    )
    return f"""WITH {WINDOWED_SQL}
SELECT capture_id, flow_id, window_index, count(*) AS packet_count, {columns}
FROM windowed GROUP BY 1, 2, 3 HAVING count(*) > {MINIMUM}"""


@_register("aggregate_features", _aggregate_sql(False))
def aggregate_query(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(spark, folder, AGGREGATE_COLUMNS)


@_register("aggregate_features_corrected", _aggregate_sql(True))
def corrected_query(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(
        spark, folder, AGGREGATE_COLUMNS, byte_total_policy=features.BYTES_CORRECTED
    )


_BINS_SQL = f"""bins AS (
  SELECT capture_id, flow_id, window_index, direction,
    CAST(floor(off / {BIN}::DOUBLE) AS INTEGER) AS bin, CAST(sum(size) AS BIGINT) AS bytes,
    count(*) AS packets
  FROM windowed GROUP BY 1, 2, 3, 4, 5)"""


@_register("size_bins", f"WITH {WINDOWED_SQL}, {_BINS_SQL} SELECT * FROM bins")
def size_bin_query(spark: SparkSession, folder: str) -> DataFrame:
    return features.size_bins(windowed(spark, folder), bin_seconds=BIN).withColumn(
        "direction", F.col("direction").cast("int")
    )


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.wavelet_features(
        features.size_bins(windowed(spark, folder), bin_seconds=BIN), minimum_packets=MINIMUM
    )


# The twin takes the band energies from pairs of bins: two bins d apart on the
# circle add x_p * x_q * max(0, 2**j - d) / 4**j to the energy of A_j.
_ENERGY_SQL = f"""WITH {WINDOWED_SQL}, {_HELD}, {_BINS_SQL},
paired AS (
  SELECT capture_id, flow_id, window_index, p.direction,
    p.bytes::DOUBLE * q.bytes::DOUBLE AS product,
    least(abs(p.bin - q.bin), 4096 - abs(p.bin - q.bin)) AS d
  FROM bins p JOIN bins q USING (capture_id, flow_id, window_index, direction)
  JOIN held USING (capture_id, flow_id, window_index)),
approx AS (
  SELECT capture_id, flow_id, window_index, direction, j,
    CASE WHEN j = 12 THEN sum(product) / 4096
      ELSE sum(product * greatest(0, (1 << j) - d)) / (1::BIGINT << (2 * j)) END AS energy
  FROM paired, range({WAVELET_LEVELS + 1}) levels(j) GROUP BY 1, 2, 3, 4, 5),
banded AS (
  SELECT a.*, lag(energy) OVER (PARTITION BY capture_id, flow_id, window_index, direction
    ORDER BY j) AS finer,
    first_value(energy) OVER (PARTITION BY capture_id, flow_id, window_index, direction
      ORDER BY j) AS whole FROM approx a)
SELECT capture_id, flow_id, window_index, direction, 13 - j::INTEGER AS band,
  round((finer - energy) / whole, 5) AS relative_energy FROM banded WHERE j > 0
UNION ALL
SELECT capture_id, flow_id, window_index, direction, 0, round(energy / whole, 5)
FROM banded WHERE j = 12"""


@_register("haar_band_energy", _ENERGY_SQL)
def band_energy_query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _signals(spark, folder)
    sides = F.array(
        *[
            F.struct(
                F.lit(direction).alias("direction"),
                F.slice("wavelet", 1 + side * WAVELET_BANDS, WAVELET_BANDS).alias("energy"),
            )
            for side, direction in enumerate((0, 1))
        ]
    )
    return (
        vectors.select(*WINDOW_KEY, F.explode(sides).alias("s"))
        .where(F.exists("s.energy", lambda e: e > 0))
        .select(
            *WINDOW_KEY,
            F.col("s.direction").alias("direction"),
            F.posexplode("s.energy").alias("band", "energy"),
        )
        .select(
            *WINDOW_KEY,
            "direction",
            "band",
            F.round(F.col("energy").cast("double"), 5).alias("relative_energy"),
        )
    )


def _transform_sql() -> str:
    """The whole transform on dense lists, one level per step."""
    steps = [
        f"""dense AS (
  SELECT h.capture_id, h.flow_id, h.window_index, s.direction,
    list_transform(range(4096), lambda i: coalesce(m[i::INTEGER], 0.0::DOUBLE)) AS a0
  FROM held h CROSS JOIN (VALUES (0), (1)) s(direction)
  LEFT JOIN (SELECT capture_id, flow_id, window_index, direction,
      map_from_entries(list((bin, bytes::DOUBLE))) AS m FROM bins GROUP BY 1, 2, 3, 4) b
    ON h.capture_id = b.capture_id AND h.flow_id = b.flow_id
      AND h.window_index = b.window_index AND s.direction = b.direction)"""
    ]
    source, kept = "dense", []
    for level in range(1, WAVELET_LEVELS + 1):
        shift = 1 << (level - 1)
        rolled = f"list_concat(a{level - 1}[{shift + 1}:], a{level - 1}[:{shift}])"
        kept_columns = "".join(f", d{k}" for k in kept)
        steps.append(
            f"""l{level} AS (
  SELECT capture_id, flow_id, window_index, direction{kept_columns},
    list_transform(list_zip(a{level - 1}, {rolled}), lambda p: (p[1] + p[2]) * 0.5) AS a{level},
    list_transform(list_zip(a{level - 1}, {rolled}), lambda p: (p[1] - p[2]) * 0.5) AS d{level}
  FROM {source})"""
        )
        kept.append(level)
        source = f"l{level}"
    bands = [f"a{WAVELET_LEVELS}"] + [f"d{k}" for k in range(WAVELET_LEVELS, 0, -1)]
    steps.append(
        "banded AS ("
        + " UNION ALL ".join(
            f"SELECT capture_id, flow_id, window_index, direction, {i} AS band, {b} AS v "
            f"FROM {source}"
            for i, b in enumerate(bands)
        )
        + ")"
    )
    steps.append(
        """measured AS (
  SELECT capture_id, flow_id, window_index, direction, band,
    list_sum(list_transform(v, lambda x: x * x)) AS e,
    list_sum(list_transform(v, lambda x: CASE WHEN x = 0 THEN 0.0::DOUBLE
      ELSE x * x * log2(x * x) END)) AS s,
    list_sum(list_transform(v, lambda x: abs(x))) / 4096 AS m, list_avg(v) AS c, v
  FROM banded)"""
    )
    steps.append(
        f"""described AS (
  SELECT capture_id, flow_id, window_index, direction, band, e,
    CASE WHEN e > 0 THEN log2(e) - s / e ELSE 0.0::DOUBLE END AS entropy,
    ln(m + {LOG_EPSILON}::DOUBLE) AS log_mean,
    ln(sqrt(list_sum(list_transform(v, lambda x: (x - c) * (x - c))) / 4096)
      + {LOG_EPSILON}::DOUBLE) AS log_std,
    sum(e) OVER (PARTITION BY capture_id, flow_id, window_index, direction) AS whole
  FROM measured)"""
    )
    return ", ".join(steps)


_FAMILY_SQL = {
    "rel_eng": "CASE WHEN whole > 0 THEN e / whole ELSE 0.0::DOUBLE END",
    "shannon_entropy": "entropy",
    "log_mean_abs_detail_coeffs": "log_mean",
    "log_std_dev_detail_coeffs": "log_std",
}
_WAVELET_SQL = f"""WITH {WINDOWED_SQL}, {_HELD}, {_BINS_SQL}, {_transform_sql()}
SELECT capture_id, flow_id, window_index, direction, band,
  {", ".join(f"{float_sql(v)} AS {f}" for f, v in _FAMILY_SQL.items())}
FROM described"""


@_register("wavelet_features", _WAVELET_SQL)
def wavelet_query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _signals(spark, folder)
    cells = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(2 * WAVELET_BANDS - 1)),
            lambda k: F.struct(
                F.floor(k / WAVELET_BANDS).cast("int").alias("direction"),
                F.pmod(k, F.lit(WAVELET_BANDS)).alias("band"),
                *[
                    F.get("wavelet", k + family * 2 * WAVELET_BANDS).cast("double").alias(name)
                    for family, name in enumerate(WAVELET_FAMILIES)
                ],
            ),
        )
    )
    return vectors.select(*WINDOW_KEY, cells.alias("c")).select(*WINDOW_KEY, "c.*")


def _vector_sql() -> str:
    """All 129 values: the three statistic twins joined to the pivoted transform."""
    key = "capture_id, flow_id, window_index"
    cells = ", ".join(
        f"max(CASE WHEN direction = {side} AND band = {band} THEN {family} END) "
        f"AS {name}_{family}_{band}"
        for family in WAVELET_FAMILIES
        for side, name in enumerate(("in", "out"))
        for band in range(WAVELET_BANDS)
    )
    return f"""WITH iat AS ({_IAT_SQL}), act AS ({_active_sql(ACTIVITY)}),
total AS ({_aggregate_sql(False)}),
swt AS (SELECT {key}, {cells} FROM ({_WAVELET_SQL}) GROUP BY {key})
SELECT capture_id || ':' || flow_id || ':' || window_index AS window_id,
  {category_sql("capture_id")} AS category, iat.packet_count,
  {", ".join(FEATURE_COLUMNS)}
FROM iat JOIN act USING ({key}) JOIN total USING ({key}) JOIN swt USING ({key})"""


@_register("feature_vectors", _vector_sql())
def feature_vector_query(spark: SparkSession, folder: str) -> DataFrame:
    return features.feature_vectors(
        windowed(spark, folder),
        window_seconds=WINDOW,
        bin_seconds=BIN,
        activity_timeout=ACTIVITY,
        minimum_packets=MINIMUM,
    ).select(
        "window_id",
        "category",
        "packet_count",
        *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS],
    )


_FEATURE_TOTALS = (
    "count(*) AS windows, CAST(sum(packet_count) AS BIGINT) AS packets, "
    "count(DISTINCT capture_id) AS captures"
)


@_register(
    "feature_summary",
    f"""WITH {WINDOWED_SQL}, {_HELD},
w AS (SELECT *, {labels_sql("capture_id")} FROM held)
SELECT 'vpn_status' AS label_kind, vpn_status AS label, {_FEATURE_TOTALS} FROM w GROUP BY 2
UNION ALL SELECT 'application', application, {_FEATURE_TOTALS} FROM w GROUP BY 2
UNION ALL SELECT 'category', category, {_FEATURE_TOTALS} FROM w GROUP BY 2
UNION ALL SELECT 'all', 'all', {_FEATURE_TOTALS} FROM w""",
)
def feature_summary_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.flow_statistics(
        windowed(spark, folder),
        window_seconds=WINDOW,
        minimum_packets=MINIMUM,
        activity_timeout=ACTIVITY,
    )
    return summary.window_summary(capture_labels(rows, "capture_id"))


@_register(
    "category_statistics",
    f"""WITH {WINDOWED_SQL}, {_HELD},
gaps AS (
  SELECT capture_id, flow_id, window_index, size, direction,
    off - lag(off) OVER (PARTITION BY capture_id, flow_id, window_index ORDER BY packet_number)
      AS gap FROM windowed),
per_window AS (
  SELECT capture_id, flow_id, window_index, {category_sql("capture_id")} AS category,
    count(*) AS packet_count, max(gap) AS longest, sum(direction) AS outgoing,
    ln(sum(size) / {WINDOW}::DOUBLE) AS rate
  FROM gaps JOIN held USING (capture_id, flow_id, window_index)
  GROUP BY capture_id, flow_id, window_index)
SELECT category, count(*) AS windows, CAST(sum(packet_count) AS BIGINT) AS packets,
  {float_sql("max(longest)")} AS longest_gap, {float_sql("avg(rate)")} AS mean_log_rate,
  {float_sql("avg(" + _logged_sql("outgoing") + ")")} AS mean_log_outgoing
FROM per_window GROUP BY 1""",
)
def category_statistics_query(spark: SparkSession, folder: str) -> DataFrame:
    """Flow statistics of all windows, summed up by traffic category."""
    rows = features.flow_statistics(
        windowed(spark, folder),
        window_seconds=WINDOW,
        minimum_packets=MINIMUM,
        activity_timeout=ACTIVITY,
    )
    return (
        capture_labels(rows, "capture_id")
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("windows"),
            F.sum("packet_count").alias("packets"),
            as_float(F.max("flow_iat_max")).alias("longest_gap"),
            as_float(F.avg("log_bytes_per_sec")).alias("mean_log_rate"),
            as_float(F.avg("log_total_outgoing_packets")).alias("mean_log_outgoing"),
        )
    )
