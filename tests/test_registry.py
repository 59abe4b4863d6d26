"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import oracle
import pytest
from flowloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TWINS = registry.oracle_sql()
# Needs more capture groups than the smallest tables hold.
LARGER = {"split_assign", "logistic_balanced", "relative_mahalanobis", "score_batch"}


# Twins whose altered rows only exist in larger tables.
LARGER_TWINS = {"contract_violations"}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01" if name in LARGER_TWINS else FOLDER
    duck = oracle.connect(folder)
    fault = oracle.compare(spark, duck, folder, registry.queries()[name], TWINS[name])
    assert not fault, fault


@pytest.mark.parametrize("name", sorted(LARGER))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.01").count() > 0


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(registry.queries())
    assert set(registry.queries()) - set(TWINS) == LARGER


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
