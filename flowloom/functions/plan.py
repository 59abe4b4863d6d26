"""Small aids that keep plans in the intended shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times in an expression while working it out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(value: Column) -> Column:
    """Keep a costly column from being copied into filters below its projection.

    A filter on a column is pushed below the projection by repeating the whole
    expression there.  Reading the partition id makes the column one the
    optimizer leaves in place; the value is unchanged.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def with_keys(df: DataFrame, *names: str) -> DataFrame:
    """The rows whose key columns are all present.

    A row without a key belongs to no group; the checks in ``operators.validate``
    report such rows.  Knowing the keys to be present, joins add no null filters
    below themselves, so two branches of a plan that start with the same
    aggregation stay equal and share its shuffle.
    """
    present = F.lit(True)
    for name in names:
        present = present & F.col(name).isNotNull()
    return df.where(present)


#: Rows of a state table that is broadcast at most.
MOST_STATE_ROWS = 50_000


def broadcast_if_small(state: DataFrame, most: int = MOST_STATE_ROWS) -> DataFrame:
    """A state table, marked for broadcast if it has at most ``most`` rows.

    Beyond that the join shuffles both sides, as it would without this function.
    """
    return F.broadcast(state) if state.limit(most + 1).count() <= most else state
