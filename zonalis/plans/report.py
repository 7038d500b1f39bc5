"""Tables for readers: indicator listings, summaries, pivots and their upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scalar import contains


def search(facts: DataFrame, column: str, keyword: str, *keep: str) -> DataFrame:
    """Distinct ``keep`` columns of the rows whose column contains the keyword."""
    return facts.where(contains(F.col(column), keyword)).select(*keep).distinct()


def latest(facts: DataFrame, *by: str) -> DataFrame:
    """by..., year, indicator_value of the last year that has a value."""
    known = facts.where("indicator_value is not null").groupBy(*by, "year").agg(F.sum("indicator_value").alias("v"))
    return known.groupBy(*by).agg(F.max("year").alias("year"), F.max_by("v", "year").alias("indicator_value"))


def region_values(facts: DataFrame, code: str, year: int, level: str | None = None) -> DataFrame:
    """(object_name, value) of one indicator and year, nulls dropped."""
    f = facts.where((F.col("indicator_code") == code) & (F.col("year") == year))
    f = f.where(F.col("object_level") == level) if level is not None else f
    return f.select("object_name", F.col("indicator_value").alias("value")).where("object_name is not null and value is not null")


def sections(facts: DataFrame, n: int = 30) -> DataFrame:
    """(section, codes): the n sections with the most indicators."""
    return facts.where("section is not null").groupBy("section").agg(F.countDistinct("indicator_code").alias("codes")).orderBy(F.desc("codes"), "section").limit(n)


def joined(first: DataFrame, *others: tuple[str, DataFrame], on: str = "object_name") -> DataFrame:
    """Inner joins of (name, table) on a key; a key that a side repeats multiplies its rows."""
    out = first
    for name, df in others:
        out = out.join(df.withColumnRenamed("value", name), on)
    return out


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def thousands(x: Column, digits: int = 0) -> Column:
    return F.format_number(x, digits)


def lookup(table: DataFrame, **labels) -> DataFrame:
    """The rows with these labels, as method="area", region="A"."""
    for name, value in labels.items():
        table = table.where(F.col(name) == value)
    return table


def summary(table: DataFrame, digits: int = 3) -> DataFrame:
    """(region, method, gini, top, total, cells) as it is printed."""
    return table.select("region", "method", F.round("gini", digits).alias("gini"), percent(F.col("top_share")).alias("top"), F.round("total", 2).alias("total"), "cells")


def pivot(summary: DataFrame, regions: Sequence[str]) -> DataFrame:
    """method, and for each region "gini g / top-10% t". A method and region that occur twice are an error."""
    twice = summary.groupBy("method", "region").count().where("count > 1")
    label = F.concat(F.lit("gini "), F.col("gini").cast("string"), F.lit(" / top-10% "), F.col("top"))
    if not twice.isEmpty():
        raise ValueError("a method and region occur twice")
    return summary.groupBy("method").pivot("region", list(regions)).agg(F.first(label))


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new ones."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def drop_methods(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose method does not match; a null method stays."""
    return df.where(~F.coalesce(F.col("method").rlike(pattern), F.lit(False)))


def markdown(summary: DataFrame) -> DataFrame:
    """(line,): rows of a markdown table."""
    return summary.select(F.concat_ws(" ", F.lit("|"), F.col("region"), F.lit("|"), F.col("method"), F.lit("|"), F.format_string("%.3f", "gini"), F.lit("|"), F.col("top"), F.lit("|")).alias("line"))


def kernel_curves(scales: Sequence[tuple[str, float]], spark, top_km: float = 120.0, n: int = 400) -> DataFrame:
    """(kind, scale, d, f): n points of each kernel from 0 to top_km."""
    from zonalis.functions.scalar import kernel

    d = spark.range(n).select((F.col("id") * (top_km / (n - 1))).alias("d"))
    out = None
    for kind, s in scales:
        part = d.select(F.lit(kind).alias("kind"), F.lit(float(s)).alias("scale"), "d", kernel(F.col("d"), s, kind).alias("f"))
        out = part if out is None else out.union(part)
    return out
