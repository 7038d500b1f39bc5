"""Concentration of values: Gini coefficient, share of the top cells, and tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.operators import ranks


def _gini():
    """The coefficient as an aggregate over ``ranks.prefixed`` values; a sum of 0 or less: 0."""
    v, c, b = (F.col(k) for k in ("_v", "_c", "_b"))
    ranked, total, n = F.sum(v * (c * b + c * (c + 1) / 2)), F.sum(v * c), F.sum("_c")
    return F.coalesce((2 * ranked - (n + 1) * total) / (n * F.when(total > 0, total)), F.lit(0.0))


def _top_share(fraction: float, mode: str):
    """The share of the greatest values as an aggregate over ``ranks.prefixed`` values: a value that the limit cuts counts in part."""
    n = F.col("_n") * F.lit(float(fraction))
    k = {"all_round": F.greatest(F.lit(1), F.bround(n).cast("long")), "positive_trunc": F.greatest(F.lit(1), F.floor(n)), "all_trunc": F.floor(n)}[mode]
    above = F.col("_n") - F.col("_b") - F.col("_c")
    top, total = F.sum(F.col("_v") * F.greatest(F.lit(0), F.least("_c", k - above))), F.sum(F.col("_v") * F.col("_c"))
    return F.coalesce(top / F.when(total > 0, total), F.lit(0.0))


def gini(df: DataFrame, value: str = "value", by: tuple[str, ...] = ("region", "method"), keep: str = "all") -> DataFrame:
    """by..., gini. Equal values are one block, so that a million zeros are one row of the running sum.

    keep="nonnegative" drops negative values first. No rows or a sum of 0 or less: 0.
    """
    v = df.where(F.col(value) >= 0) if keep == "nonnegative" else df
    return ranks.prefixed(v, value, by).groupBy(*by).agg(_gini().alias("gini"))


def top_share(df: DataFrame, value: str = "value", by: tuple[str, ...] = ("region", "method"), fraction: float = 0.1, mode: str = "all_round") -> DataFrame:
    """by..., top_share: the greatest values' part of the sum.

    all_round: of all n values the max(1, round half even(n * fraction)) greatest; positive_trunc: of the positive
    ones max(1, truncated); all_trunc: of all, truncated, perhaps none. Blocks of equal values are cut where needed.
    """
    if mode not in ("all_round", "positive_trunc", "all_trunc"):
        raise ValueError(f"unknown mode {mode!r}")
    v = df.where(F.col(value) > 0) if mode == "positive_trunc" else df
    return ranks.prefixed(v, value, by).groupBy(*by).agg(_top_share(fraction, mode).alias("top_share"))


def table(df: DataFrame, value: str = "value", by: tuple[str, ...] = ("region", "method"), fraction: float = 0.1, mode: str = "all_round") -> DataFrame:
    """by..., gini, top_share, total, cells (those above 0): one row for each region and method of a long frame."""
    total, cells = F.sum(F.col("_v") * F.col("_c")), F.coalesce(F.sum(F.when(F.col("_v") > 0, F.col("_c"))), F.lit(0).cast("long"))
    if mode != "positive_trunc":  # one running sum for all of it
        return ranks.prefixed(df, value, by).groupBy(*by).agg(_gini().alias("gini"), _top_share(fraction, mode).alias("top_share"), total.alias("total"), cells.alias("cells"))
    rest = ranks.prefixed(df, value, by).groupBy(*by).agg(_gini().alias("gini"), total.alias("total"), cells.alias("cells"))
    return top_share(df, value, by, fraction, mode).join(rest, list(by)).select(*by, "gini", "top_share", "total", "cells")


def describe(df: DataFrame, value: str, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """by..., n, mean, std, low, q25, q50, q75, high."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    return s.join(ranks.quantiles(df, value, by, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), list(by))


def mass_check(df: DataFrame, totals: DataFrame, value: str = "value", by: tuple[str, ...] = ("region", "method"), tolerance: float = 1e-6) -> DataFrame:
    """by..., total, x_total, ok: whether the cells add up to the known total."""
    s = df.groupBy(*by).agg(F.sum(value).alias("total")).join(totals.select("region", "x_total"), "region")
    return s.withColumn("ok", F.abs(F.col("total") - F.col("x_total")) <= tolerance * F.greatest(F.lit(1.0), F.abs("x_total")))


def max_min_ratio(df: DataFrame, value: str = "value", by: tuple[str, ...] = ("region", "method")) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.max(value), F.min(value)).alias("ratio"))


def colour_limits(df: DataFrame, value: str = "value", by: tuple[str, ...] = ("region", "method"), quantile: float = 0.95) -> DataFrame:
    """by..., vmin and vmax of the positive values (log scale), and an exact quantile (linear scale)."""
    p = F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(*by).agg(F.min(p).alias("vmin"), F.max(p).alias("vmax")).join(ranks.quantiles(df, value, by, {"vq": quantile}), list(by))
