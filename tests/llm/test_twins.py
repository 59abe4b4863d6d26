"""Queries that SQL can express, against their twins."""

from __future__ import annotations

import oracle
import pytest

from flowloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    fault = oracle.compare(spark, oracle.connect(SF), SF, queries.QUERIES[name], queries.SQL[name])
    assert not fault, fault


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert [n for n in sorted(queries.QUERIES) if n.startswith("op")] == sorted(queries.QUERIES)
