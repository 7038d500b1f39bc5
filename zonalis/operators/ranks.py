"""Running sums, ranks and exact quantiles of groups too large for one task.

Rows are sorted into ranges that Spark samples (``repartitionByRange``), so that a range has about as many rows as any other,
whatever the values are. Sums run inside the ranges; the ranges' totals, a row for each group and range, are run over the
whole group and sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.operators import graph, groups


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """The rows with the number of their sampled range of ``order`` as ``_p``: ranges never fall as the order grows. Another run of the
    plan may draw other ranges, so what is made of them in one pass has to be written."""
    return df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())


def running(blocks: DataFrame, by: Sequence[str], value: str, amount: str, name: str, descending: bool = False, total: str | None = None) -> DataFrame:
    """Adds ``name``, the sum of ``amount`` over the values before this one, and with ``total`` the group's whole sum; ``blocks`` has
    each value of a group once. Nulls come first and NaN last, as in Spark's order (descending: the other way)."""
    order = F.desc if descending else F.asc
    inside = W.partitionBy(*by, "_p").orderBy(order(value)).rowsBetween(W.unboundedPreceding, -1)
    own = graph.settle(dealt(blocks, *by, value).withColumn(name, F.coalesce(F.sum(amount).over(inside), F.lit(0))))
    before = W.partitionBy(*by).orderBy(order("_p")).rowsBetween(W.unboundedPreceding, -1)
    ranges = own.groupBy(*by, "_p").agg(F.sum(amount).alias("_t"))
    whole = {total: F.sum("_t").over(W.partitionBy(*by))} if total else {}
    ranges = ranges.withColumns({"_o": F.coalesce(F.sum("_t").over(before), F.lit(0)), **whole}).drop("_t")
    return groups.attach(own, ranges, [*by, "_p"]).withColumn(name, F.col("_o") + F.col(name)).drop("_o", "_p")


def prefixed(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """by..., _v, _c, _b, _n: each value of a group once, how often it is there, how many rows are before it, and the group's rows.

    A million equal values are one row.
    """
    return running(df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), by, "_v", "_c", "_b", total="_n")


def average_rank(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Adds the rank of ``value`` within ``by``; equal values share their mean rank, rows with a null go.

    A row carries its rank: it is not joined back by its value. Rows of one value may fill several ranges (they are dealt by a
    hash of the row), so the values at the ends of ranges are counted over all of them.
    """
    d = dealt(df.where(F.col(value).isNotNull()).withColumn("_h", F.xxhash64(*df.columns)), *by, value, "_h").drop("_h")
    up = W.partitionBy(*by, "_p").orderBy(value)
    rows = graph.settle(d.withColumns({"_b": F.rank().over(up) - 1, "_c": F.count("*").over(up.rangeBetween(W.currentRow, W.currentRow))}))
    # from here a row for each range: its rows, and its least and greatest value with their counts
    end = F.struct(F.col(value).alias("v"), F.col("_c").alias("c"))
    ranges = rows.groupBy(*by, "_p").agg(F.count("*").alias("t"), F.min(end).alias("low"), F.max(end).alias("high"))
    before = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("o", F.coalesce(F.sum("t").over(before), F.lit(0)))
    ends = F.array_distinct(F.array(F.struct("low.v", "low.c", F.lit(0).cast("long").alias("b")), F.struct("high.v", "high.c", (F.col("t") - F.col("high.c")).alias("b"))))
    ends = ranges.select(*by, "_p", "o", F.explode(ends).alias("e")).select(*by, "_p", "o", "e.*")
    same = W.partitionBy(*by, "v")
    ends = ends.select(*by, "_p", "o", "v", ((F.min(F.col("o") + F.col("b")).over(same)) + (F.sum("c").over(same) + 1) / 2).alias("r"))
    ends = ends.groupBy(*by, "_p").agg(F.first("o").alias("_o"), F.min(F.struct("v", "r")).alias("_low"), F.max(F.struct("v", "r")).alias("_high"))
    v = F.col(value)
    rank = F.when(v == F.col("_low.v"), F.col("_low.r")).when(v == F.col("_high.v"), F.col("_high.r")).otherwise(F.col("_o") + F.col("_b") + (F.col("_c") + 1) / 2)
    return groups.attach(rows, ends, [*by, "_p"]).withColumn(name, rank).drop("_p", "_o", "_b", "_c", "_low", "_high")


def quantiles(df: DataFrame, value: str, by: Sequence[str], points: dict[str, float]) -> DataFrame:
    """by..., and for each name its exact quantile, linear between neighbours; nulls are left out."""
    ranked = prefixed(df.where(F.col(value).isNotNull()), value, by)
    at = {k: (F.col("_n") - 1) * F.lit(float(p)) for k, p in points.items()}
    holds = lambda k: (F.col("_b") <= k) & (k < F.col("_b") + F.col("_c"))
    ends = []
    for k, pos in at.items():
        ends += [F.max(F.when(holds(F.floor(pos)), F.col("_v"))).alias(f"_l{k}"), F.max(F.when(holds(F.ceil(pos)), F.col("_v"))).alias(f"_u{k}"), F.max(pos - F.floor(pos)).alias(f"_p{k}")]
    got = ranked.groupBy(*by).agg(*ends)
    return got.select(*by, *[(F.col(f"_l{k}") + (F.col(f"_u{k}") - F.col(f"_l{k}")) * F.col(f"_p{k}")).alias(k) for k in points])
