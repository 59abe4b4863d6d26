"""Run registered queries against their SQL twins and report differences."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float) and value == 0.0:
        return 0.0
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r))
    )


def compare(spark, connection, folder, query, sql):
    """Empty text when both sides agree, else what differs."""
    df = query(spark, folder)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    right = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} <> {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} <> {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1], strict=True) if a != b]
    types = [
        (n, type(a).__name__, type(b).__name__)
        for (x, y) in list(zip(left[1], right[1], strict=True))[:50]
        for n, a, b in zip(left[0], x, y, strict=True)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    if types:
        return f"types differ: {sorted(set(types))}"
    if wrong:
        return f"{len(wrong)} of {len(left[1])} rows differ, first: {wrong[0]}"
    return ""


if __name__ == "__main__":
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    scale, wanted = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/{scale}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    duck = connect(folder)
    twins = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in twins:
                fault = compare(spark, duck, folder, query, twins[name])
            else:
                fault = f"rows only: {query(spark, folder).count()}"
        except Exception as error:  # noqa: BLE001
            fault = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{time.time() - start:6.1f}s {name:28s} {fault[:900] or 'ok'}", flush=True)
