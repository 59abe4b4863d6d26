"""Registered queries on capture groups, splits and partition joins, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.labels import capture_labels, category_of
from flowloom.operators import splits, validate, windows
from flowloom.plans.settings import (
    MINIMUM,
    WINDOWED_SQL,
    labels_sql,
    role_sql,
    table,
    windowed,
)
from flowloom.schemas import (
    APPLICATIONS,
    CATEGORIES,
    MINIMUM_CATEGORY_WINDOWS,
    PARTITIONS,
    SPLIT_FRACTIONS,
    VPN_STATUSES,
)
from flowloom.session import cut_lineage

QUERIES = {}
SQL = {}


def _register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def window_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labeled window rows of the event captures."""
    held = windows.window_counts(windowed(spark, folder), minimum_packets=MINIMUM)
    return capture_labels(windows.with_bounds(held), "capture_id").select(
        "window_id", "capture_id", "vpn_status", "application", "category", "packet_count"
    )


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Captures assigned by hash, the fixed assignment the balance queries grade."""
    groups = cut_lineage(splits.capture_groups(window_rows(spark, folder)))
    return groups.withColumn("partition", splits.hashed_partition(F.col("capture_id")))


ROWS_SQL = f"""{WINDOWED_SQL},
window_rows AS (
  SELECT capture_id || ':' || flow_id || ':' || window_index AS window_id, capture_id,
    count(*) AS packet_count, {labels_sql("capture_id")}
  FROM windowed GROUP BY capture_id, flow_id, window_index HAVING count(*) > {MINIMUM}),
groups AS (
  SELECT capture_id, vpn_status, application, category, count(*) AS windows
  FROM window_rows GROUP BY 1, 2, 3, 4),
assignments AS (SELECT *, {role_sql("capture_id")} AS partition FROM groups)"""

_KINDS_SQL = """tagged AS (
  SELECT *, 'all' AS kind, 'all' AS value FROM {source}
  UNION ALL SELECT *, 'category', category FROM {source}
  UNION ALL SELECT *, 'vpn_status', vpn_status FROM {source}
  UNION ALL SELECT *, 'application', application FROM {source}
  UNION ALL SELECT *, 'category_vpn', category || '/' || vpn_status FROM {source})"""


@_register("capture_groups", f"WITH {ROWS_SQL} SELECT * FROM groups")
def capture_group_query(spark: SparkSession, folder: str) -> DataFrame:
    return splits.capture_groups(window_rows(spark, folder))


def _objective_sql(keys: str = "") -> str:
    """Balance objective over ``tagged`` rows, per candidate in ``keys``."""
    lead = f"{keys}, " if keys else ""
    terms = []
    for kind, measure, weight in (
        ("category", "windows", 10),
        ("category", "1", 2),
        ("all", "windows", 5),
        ("all", "1", 1),
        ("vpn_status", "windows", 1),
    ):
        parts = " + ".join(
            f"abs(sum(CASE WHEN partition = '{p}' THEN {measure} ELSE 0 END) "
            f"- sum({measure}) * {SPLIT_FRACTIONS[p]}::DOUBLE)"
            for p in PARTITIONS
        )
        terms.append(
            f"SELECT {lead}{weight}::DOUBLE / sum({measure}) * ({parts}) AS cost FROM tagged "
            f"WHERE kind = '{kind}' GROUP BY {lead}value"
        )
    return " UNION ALL ".join(terms)


@_register(
    "split_objective",
    f"""WITH {ROWS_SQL}, {_KINDS_SQL.format(source="assignments")},
costs AS ({_objective_sql()}) SELECT round(sum(cost), 6) AS objective FROM costs""",
)
def split_objective_query(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_objective(assignments(spark, folder)).select(
        F.round("objective", 6).alias("objective")
    )


def _wanted_sql() -> str:
    rows = [
        ("category", c, p, MINIMUM_CATEGORY_WINDOWS) for c in CATEGORIES for p in PARTITIONS
    ]
    rows += [("application", a, p, 0) for a in APPLICATIONS for p in ("train", "test")]
    rows += [("vpn_status", v, p, 0) for v in VPN_STATUSES for p in PARTITIONS]
    rows += [("category_vpn", f"{c}/{v}", "train", 0) for c in CATEGORIES for v in VPN_STATUSES]
    return ", ".join(f"('{k}', '{v}', '{p}', 1, {w})" for k, v, p, w in rows)


@_register(
    "split_coverage",
    f"""WITH {ROWS_SQL}, {_KINDS_SQL.format(source="assignments")},
wanted AS (SELECT * FROM (VALUES {_wanted_sql()})
  w(kind, value, partition, captures_floor, windows_floor))
SELECT kind, value, partition, count(t.capture_id) AS captures,
  CAST(coalesce(sum(t.windows), 0) AS BIGINT) AS windows,
  captures_floor::BIGINT AS captures_floor, windows_floor::BIGINT AS windows_floor,
  count(t.capture_id) >= captures_floor AND coalesce(sum(t.windows), 0) >= windows_floor
    AS covered
FROM wanted LEFT JOIN tagged t USING (kind, value, partition)
GROUP BY kind, value, partition, captures_floor, windows_floor""",
)
def split_coverage_query(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_coverage(assignments(spark, folder))


@_register(
    "split_summary",
    f"""WITH {ROWS_SQL}, {_KINDS_SQL.format(source="assignments")}
SELECT partition, kind AS label_kind, value AS label, count(*) AS captures,
  CAST(sum(windows) AS BIGINT) AS windows,
  sum(windows) / (SELECT sum(windows) FROM assignments)::DOUBLE AS window_fraction
FROM tagged WHERE kind <> 'category_vpn' GROUP BY 1, 2, 3""",
)
def split_summary_query(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_summary(assignments(spark, folder))


_SEEDS = 8


@_register(
    "split_candidates",
    f"""WITH {ROWS_SQL},
drawn AS (
  SELECT g.*, s.seed, sha256(s.seed || ':' || capture_id) AS draw
  FROM groups g, (SELECT unnest(range(1, {_SEEDS + 1}))::INTEGER AS seed) s),
by_app AS (
  SELECT *, row_number() OVER (PARTITION BY seed, application ORDER BY draw, capture_id) AS r
  FROM drawn),
by_category AS (
  SELECT seed, capture_id, row_number() OVER (PARTITION BY seed, category
    ORDER BY draw, capture_id) AS r FROM by_app WHERE r > 2),
candidates AS (
  SELECT a.seed, a.capture_id, a.vpn_status, a.application, a.category, a.windows,
    CASE WHEN a.r = 1 THEN 'train' WHEN a.r = 2 THEN 'test' WHEN c.r = 1 THEN 'validation'
      WHEN c.r = 2 THEN 'calibration'
      WHEN ('0x' || substr(draw, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.6::DOUBLE THEN 'train'
      WHEN ('0x' || substr(draw, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.75::DOUBLE
        THEN 'validation'
      WHEN ('0x' || substr(draw, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.85::DOUBLE
        THEN 'calibration' ELSE 'test' END AS partition
  FROM by_app a LEFT JOIN by_category c USING (seed, capture_id)),
{_KINDS_SQL.format(source="candidates")},
costs AS ({_objective_sql("seed")}),
wanted AS (SELECT * FROM (VALUES {_wanted_sql()})
  w(kind, value, partition, captures_floor, windows_floor)),
cells AS (SELECT seed, kind, value, partition, sum(windows) AS windows FROM tagged
  GROUP BY 1, 2, 3, 4),
met AS (SELECT seed, count(*) AS n FROM cells JOIN wanted USING (kind, value, partition)
  WHERE windows >= windows_floor GROUP BY 1)
SELECT costs.seed, round(sum(cost), 6) AS objective,
  (SELECT count(*) FROM wanted) - any_value(coalesce(met.n, 0)) AS violations
FROM costs LEFT JOIN met ON costs.seed = met.seed GROUP BY costs.seed""",
)
def split_candidate_query(spark: SparkSession, folder: str) -> DataFrame:
    groups = cut_lineage(splits.capture_groups(window_rows(spark, folder)))
    graded = splits.grade_splits(splits.candidate_splits(groups, seeds=_SEEDS))
    return graded.withColumn("objective", F.round("objective", 6))


def customer_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as capture groups, their orders as windows."""
    customer = F.col("o_custkey")
    application = F.element_at(
        F.array(*[F.lit(a) for a in APPLICATIONS]), (F.pmod(customer, F.lit(10)) + 1).cast("int")
    )
    status = F.when(F.pmod(F.floor(customer / 10), F.lit(2)) == 1, F.lit("vpn")).otherwise(
        F.lit("nonvpn")
    )
    counted = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("windows")
    )
    return counted.select(
        F.concat(F.lit("customer"), customer).alias("capture_id"),
        status.alias("vpn_status"),
        application.alias("application"),
        category_of(application).alias("category"),
        "windows",
    )


@_register("split_assign")
def split_assign_query(spark: SparkSession, folder: str) -> DataFrame:
    return splits.search_split(customer_groups(spark, folder), seeds=16)


@_register(
    "partition_join",
    f"""WITH {ROWS_SQL}
SELECT a.partition, r.category, count(*) AS windows,
  CAST(sum(r.packet_count) AS BIGINT) AS packets
FROM window_rows r JOIN assignments a USING (capture_id) GROUP BY 1, 2""",
)
def partition_join_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = window_rows(spark, folder)
    joined = splits.join_partitions(rows, assignments(spark, folder))
    return joined.groupBy("partition", "category").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("packet_count").alias("packets")
    )


@_register(
    "partition_faults",
    f"""WITH {ROWS_SQL},
altered AS (
  SELECT capture_id, vpn_status, application,
    CASE WHEN windows % 5 = 1 THEN 'OTHER' ELSE category END AS category,
    CASE WHEN windows % 3 = 2 THEN windows + 1 ELSE windows END AS windows
  FROM assignments WHERE windows % 7 <> 4)
SELECT 'capture_unassigned' AS rule, capture_id AS key, windows::VARCHAR AS detail
FROM groups WHERE capture_id NOT IN (SELECT capture_id FROM altered)
UNION ALL
SELECT 'label_mismatch', capture_id, g.vpn_status || '/' || g.application || '/' || g.category
FROM groups g JOIN altered a USING (capture_id)
WHERE g.category <> a.category OR g.application <> a.application OR g.vpn_status <> a.vpn_status
UNION ALL
SELECT 'window_count', capture_id, coalesce(g.windows, 0) || '<>' || coalesce(a.windows, 0)
FROM groups g FULL JOIN altered a USING (capture_id)
WHERE g.windows IS DISTINCT FROM a.windows""",
)
def partition_fault_query(spark: SparkSession, folder: str) -> DataFrame:
    count = F.col("windows")
    altered = (
        assignments(spark, folder)
        .where(F.pmod(count, F.lit(7)) != 4)
        .withColumn(
            "category",
            F.when(F.pmod(count, F.lit(5)) == 1, F.lit("OTHER")).otherwise(F.col("category")),
        )
        .withColumn("windows", F.when(F.pmod(count, F.lit(3)) == 2, count + 1).otherwise(count))
    )
    return splits.partition_faults(window_rows(spark, folder), altered)


# A split by window instead of by capture leaks captures between roles.
@_register(
    "capture_overlap",
    f"""WITH {ROWS_SQL}, roles AS (
  SELECT DISTINCT capture_id, {role_sql("window_id")} AS role FROM window_rows)
SELECT capture_id FROM roles WHERE role = 'train'
INTERSECT SELECT capture_id FROM roles WHERE role = 'test'""",
)
def capture_overlap_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = window_rows(spark, folder).withColumn(
        "partition", splits.hashed_partition(F.col("window_id"))
    )
    return splits.capture_overlap(
        rows.where(F.col("partition") == "train"), rows.where(F.col("partition") == "test")
    )


@_register(
    "application_coverage",
    f"""WITH {ROWS_SQL},
known AS (SELECT unnest([{", ".join(f"'{a}'" for a in APPLICATIONS)}]) AS application)
SELECT p.partition, k.application, 'missing' AS fault
FROM (SELECT unnest([{", ".join(f"'{p}'" for p in PARTITIONS)}]) AS partition) p, known k
WHERE NOT EXISTS (SELECT 1 FROM assignments a
  WHERE a.partition = p.partition AND a.application = k.application)""",
)
def application_coverage_query(spark: SparkSession, folder: str) -> DataFrame:
    assigned = assignments(spark, folder)
    parts = {
        p: splits.missing_values(
            assigned.where(F.col("partition") == p), "application", APPLICATIONS
        )
        for p in PARTITIONS
    }
    return splits.union_partitions(parts).select("partition", "application", "fault")


@_register(
    "group_violations",
    f"""WITH {ROWS_SQL},
altered AS (
  SELECT capture_id, application, CASE WHEN windows % 4 = 1 THEN 'CHAT' ELSE category END
    AS category, CASE WHEN windows % 6 = 5 THEN 0 ELSE windows END AS windows FROM groups),
doubled AS (SELECT * FROM altered UNION ALL SELECT * FROM altered WHERE windows % 9 = 2)
SELECT 'windows_not_positive' AS rule, capture_id AS key, '' AS detail FROM doubled
WHERE windows < 1
UNION ALL
SELECT 'category_mismatch', d.capture_id, '' FROM doubled d JOIN groups g USING (capture_id)
WHERE d.category <> g.category
UNION ALL
SELECT 'capture_id_duplicate', capture_id, count(*)::VARCHAR FROM doubled
GROUP BY capture_id HAVING count(*) > 1""",
)
def group_violation_query(spark: SparkSession, folder: str) -> DataFrame:
    count = F.col("windows")
    altered = (
        cut_lineage(splits.capture_groups(window_rows(spark, folder)))
        .withColumn(
            "category",
            F.when(F.pmod(count, F.lit(4)) == 1, F.lit("CHAT")).otherwise(F.col("category")),
        )
        .withColumn("windows", F.when(F.pmod(count, F.lit(6)) == 5, F.lit(0)).otherwise(count))
    )
    doubled = altered.unionByName(altered.where(F.pmod("windows", F.lit(9)) == 2))
    return validate.capture_group_violations(doubled)
