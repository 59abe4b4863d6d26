"""Keyed permutations and the draws made with them."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import duckdb
import pytest
from flowloom.functions.permute import permuted, permuted_sql
from flowloom.operators import model
from pyspark.sql import functions as F

SIZES = [1, 2, 3, 4, 5, 7, 10, 26, 101, 1000, 4097]


def test_every_key_permutes_every_size(spark):
    sizes = spark.createDataFrame([(n, k) for n in SIZES for k in ("a", "b")], "n bigint, k string")
    placed = sizes.select("n", "k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x"))
    rows = placed.withColumn("y", permuted(F.col("x"), F.col("n"), F.col("k"))).collect()
    got = {}
    for r in rows:
        got.setdefault((r.n, r.k), {})[r.x] = r.y
    for (n, _), places in got.items():
        assert sorted(places.values()) == list(range(n))
    assert got[1000, "a"] != got[1000, "b"]
    twin = duckdb.sql(
        "SELECT n, k, x, " + permuted_sql("x", "n", "k") + " AS y FROM (SELECT n, k, unnest(range(n)) AS x "
        f"FROM (SELECT unnest({SIZES[:-1]})::BIGINT AS n), (SELECT unnest(['a', 'b']) AS k))"
    ).fetchall()
    assert all(got[n, k][x] == y for n, k, x, y in twin)


@pytest.fixture(scope="module")
def episodes(spark):
    rows = spark.createDataFrame(
        [(n, "ab"[n % 2]) for n in range(20)] + [(100, "c"), (101, "c")], "row_id bigint, label string"
    )
    drawn = model.sample_episodes(rows, episodes=2000, support_per_class=3, queries=4)
    return drawn.collect()


def test_draws_are_without_replacement_and_whole(episodes):
    support, query = {}, {}
    for r in episodes:
        (support if r.role == "support" else query).setdefault(r.episode, []).append((r.row_id, r.label))
    assert len(support) == len(query) == 2000
    for n, rows in support.items():
        assert Counter(label for _, label in rows) == {"a": 3, "b": 3, "c": 2}
        assert len(set(rows)) == 8 and len(set(query[n])) == 4
        assert not set(rows) & set(query[n])


def test_pairs_come_as_often_as_in_independent_draws(episodes):
    pairs, queried = Counter(), Counter()
    own = {}
    for r in episodes:
        if r.role == "support" and r.label == "a":
            own.setdefault(r.episode, []).append(r.row_id)
        elif r.role == "query":
            queried[r.row_id] += 1
    for rows in own.values():
        pairs.update(combinations(sorted(rows), 2))
    # 10 rows, 3 drawn: a pair has a chance of 3 * 2 / (10 * 9).
    expected = 2000 * 6 / 90
    assert len(pairs) == 45
    surprise = sum((n - expected) ** 2 / expected for n in pairs.values())
    assert surprise < 90  # 44 degrees of freedom
    # Of a and b seven rows each are left, of c none.
    expected = 2000 * 4 / 20
    assert set(queried) == set(range(20))
    assert sum((n - expected) ** 2 / expected for n in queried.values()) < 50
