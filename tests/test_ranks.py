"""Ranks, running sums and joins of groups that are hot, tied or narrow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import allocate, groups, metrics, ranks, tune


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would be put together in one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def mean_ranks(v):
    order = np.argsort(v, kind="stable")
    first = np.searchsorted(v[order], v, side="left")
    last = np.searchsorted(v[order], v, side="right")
    return (first + 1 + last) / 2


def test_a_million_ties(spark):
    """Nearly all values are one: its rows fill many ranges, and no task has more than its share of them."""
    df = spark.range(1_000_000).selectExpr("'g' as g", "id as cell_id", "case when id % 100000 = 7 then id / 1000D when id % 250000 = 3 then -1D else 0D end as v")
    d = ranks.dealt(df.withColumn("h", F.xxhash64("cell_id")), "g", "v", "h").groupBy("_p").count().collect()
    assert len(d) == 8 and max(r["count"] for r in d) < 200_000
    got = ranks.average_rank(df, "v", ("g",), "r").select("v", "r").distinct().collect()
    assert len(got) == 12
    v = np.zeros(1_000_000)
    v[7::100_000], v[3::250_000] = np.arange(7, 1_000_000, 100_000) / 1000, -1
    want = dict(zip(v.tolist(), mean_ranks(v).tolist()))
    assert {r.v: r.r for r in got} == want


def test_narrow_values(spark):
    """A hundred thousand values within a millionth of each other are dealt to all tasks."""
    n = 100_000
    v = 5 + np.random.default_rng(1).permutation(n) / n * 1e-6
    df = spark.createDataFrame([("g", k, float(x)) for k, x in enumerate(v)], "g string, cell_id long, v double")
    assert ranks.dealt(df, "g", "v").groupBy("_p").count().agg(F.max("count")).first()[0] < n / 4
    got = {r.cell_id: r.r for r in ranks.average_rank(df, "v", ("g",), "r").collect()}
    assert [got[k] for k in range(n)] == mean_ranks(v).tolist()
    q = ranks.quantiles(df, "v", ("g",), {"a": 0.3, "b": 0.95}).first()
    assert (q.a, q.b) == (pytest.approx(np.quantile(v, 0.3), abs=1e-15), pytest.approx(np.quantile(v, 0.95), abs=1e-15))
    s = np.sort(v)
    assert metrics.gini(df, "v", ("g",)).first().gini == pytest.approx((2 * (s * np.arange(1, n + 1)).sum() / (n * s.sum())) - (n + 1) / n, abs=1e-9)


def test_ranks_of_several_groups_with_nulls_and_nan(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k % 3 == 0 else f"g{k % 3}", k, float(rng.integers(0, 9))) for k in range(4000)] + [("g1", 9000, float("nan")), ("g1", 9001, None), ("g2", 9002, float("inf"))]
    df = spark.createDataFrame(rows, "g string, cell_id long, v double")
    got = {r.cell_id: r.r for r in ranks.average_rank(df, "v", ("g",), "r").collect()}
    assert 9001 not in got and len(got) == len(rows) - 1
    for g in (None, "g1", "g2"):
        mine = [(k, v) for h, k, v in rows if h == g and v is not None]
        want = mean_ranks(np.array([v for _, v in mine]))  # numpy sorts NaN last too
        same = [(got[k], w) for (k, v), w in zip(mine, want) if v == v]
        assert all(a == b for a, b in same)
    assert got[9000] == len([1 for h, _, v in rows if h == "g1" and v is not None])


def test_spearman_of_tied_columns(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 3000), rng.integers(0, 7, 3000)
    df = spark.createDataFrame([("g", k, int(x), int(y)) for k, (x, y) in enumerate(zip(a, b))], "g string, cell_id long, a int, b int")
    want = np.corrcoef(mean_ranks(a), mean_ranks(b))[0, 1]
    assert tune.spearman(df, "a", "b", ("g",)).first().rho == pytest.approx(want, abs=1e-12)


def test_cells_are_not_shuffled_for_a_share(spark):
    cells = spark.range(10**9).selectExpr("concat('r', id % 7) as region", "id as cell_id", "1D as area_km2", "cast(id % 11 as double) as population")
    few = cells.where("cell_id < 7000")
    totals = few.groupBy("region").agg(F.lit(10.0).alias("x_total"))
    for plan in (allocate.area(few, totals), allocate.several(few, totals, ("area", "population", "elasticity"))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    assert allocate.area(few, totals).agg(F.sum("value")).first()[0] == pytest.approx(70.0)


def test_more_groups_than_may_be_sent_are_written(spark, monkeypatch):
    df = spark.createDataFrame([(f"g{k % 50}", k) for k in range(200)], "g string, v long")
    per = df.groupBy("g").agg(F.sum("v").alias("s"))
    want = sorted(map(tuple, groups.attach(df, per, ["g"]).collect()))
    monkeypatch.setattr(groups.small, "__defaults__", (10,))
    assert sorted(map(tuple, groups.attach(df, per, ["g"]).collect())) == want and len(want) == 200
