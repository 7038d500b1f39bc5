"""Tables with a row for each group, joined back to all rows of the groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.operators import graph

#: Rows of a table of groups that may be sent to all tasks.
LIMIT = 100_000


def small(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of an aggregate by group, made once: up to ``limit`` of them as a broadcast, so that the rows that are joined
    to them stay where they are; more are written to the shared folder, and Spark chooses the join."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return graph.settle(df)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def attach(df: DataFrame, per_group: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``per_group``, whose rows are unique in ``by``; null keys are equal."""
    names = {b: f"_k{i}" for i, b in enumerate(by)}
    keys = small(per_group.withColumnsRenamed(names))
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(k)) for b, k in names.items()])
    return df.join(keys, same, how).drop(*names.values())
