"""Minutes of all cells and places: lists of places against a row for each pair, and rounding without decimals."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from zonalis.functions import scalar
from zonalis.operators import graph

INF = float("inf")


def test_minutes_in_lists_are_those_of_both_parts(spark, monkeypatch):
    """Lists of about two, a region that one side lacks, a null coordinate, a node that no road meets, places without a way."""
    monkeypatch.setattr(graph, "LIST", 2, raising=False)
    rng = np.random.default_rng(4)
    rows = lambda names, n: [(names[k % len(names)], k, float(a) * 900, float(b) * 900) for k, (a, b) in enumerate(rng.integers(0, 30, (n, 2)))]
    cells = spark.createDataFrame([*rows("abc", 70), ("a", 90, None, 1.0)], "region string, cell_id long, x double, y double")
    places = spark.createDataFrame([*rows("abd", 50), ("b", 90, 1.0, None)], "region string, place_id long, x double, y double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 26000.0, 0.0), (3, 0.0, 26000.0), (4, 26000.0, 26000.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 600.0), (2, 3, 70.0)], "src long, dst long, travel_time double")
    parts = graph.legs(cells, places, nodes, edges)
    ways = {}
    for w in parts.ways.collect():
        ways.setdefault((w.region, w.c_at), []).append((w.place_id, w["at"]))
    want = [(c.region, c.cell_id, p, c["at"] + t) for c in parts.cells.collect() for p, t in ways.get((c.region, c.c_at), [])]
    got = [tuple(r) for r in graph.travel_minutes(cells, places, nodes, edges).collect()]
    assert sorted(got) == sorted(want) and len({r[2] for r in got}) > 30 and {math.isinf(r[3]) for r in got} == {True, False}


def test_minutes_of_many_pairs(spark):
    """1.6 thousand million pairs at one node."""
    n = 40_000
    rows = spark.range(n).select(F.lit("r").alias("region"), "id", (F.col("id") % 5 * 250.0).alias("x"), F.lit(0.0).alias("y"))
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e6, 0.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 600.0)], "src long, dst long, travel_time double")
    start = time.monotonic()
    m = graph.travel_minutes(rows.withColumnRenamed("id", "cell_id"), rows.withColumnRenamed("id", "place_id"), nodes, edges)
    got = m.select("d").agg(F.count("*"), F.min("d"), F.max("d")).first()
    assert got[0] == n * n and got[1] == 0.0 and abs(got[2] - 4.8) < 1e-9 and time.monotonic() - start < 60


def test_rounded_is_round(spark):
    rng = np.random.default_rng(8)
    ties = (rng.integers(-(10**9), 10**9, 4000) + 0.5) / 1e5
    plain = np.concatenate([rng.normal(0, 10.0**e, 500) for e in range(-8, 14)])
    x = [*ties, *np.nextafter(ties, INF), *np.nextafter(ties, -INF), *plain, 0.0, -0.0, -1e-9, 0.000005, -0.000005, 2.5e-5, 1.005, INF, -INF, float("nan"), 1e300, None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in x], "x double")
    text = lambda c: c.cast("string")  # noqa: E731 - the sign of a zero counts
    for digits in (2, 5):
        a, b = text(scalar.rounded(F.col("x"), digits)), text(F.round("x", digits))
        assert df.where(~a.eqNullSafe(b)).count() == 0
        assert df.where(a.isNotNull()).count() == len(x) - 1


def test_thousand_million_numbers_are_rounded(spark):
    start = time.monotonic()
    got = spark.range(1_000_000_000).select(scalar.rounded(F.col("id") / 7e5, 5).alias("v")).agg(F.max("v")).first()
    assert got[0] == 1428.57143 and time.monotonic() - start < 40
