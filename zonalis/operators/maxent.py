"""Maximum entropy allocation: the distribution nearest to uniform that has the same feature means as a reference.

The dual is solved by damped Newton steps on the driver; a step is one aggregate over the cells, and regions are
solved together: each has a row of three multipliers.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scalar import masked_power
from zonalis.operators import allocate as spread
from zonalis.operators import distance, graph, groups

FEATURES = ("f1", "f2", "f3")


def raw_features(cells: DataFrame) -> DataFrame:
    pop = F.greatest(F.coalesce(F.nanvl("population", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return cells.withColumns({"f1": F.log1p(pop), "f2": F.log1p(1 / (F.col("dist_to_city_km") + 1)), "f3": F.log1p(1 / (F.col(distance.centre_column(cells)) + 1))})


def features(cells: DataFrame) -> DataFrame:
    """Adds f1, f2, f3, standardised in each region (population standard deviation; below 1e-9 it counts as 1)."""
    raw = raw_features(cells)
    m = raw.groupBy("region").agg(*[F.avg(f).alias(f"_m{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"_s{f}") for f in FEATURES])
    std = {f: (F.col(f) - F.col(f"_m{f}")) / F.when(F.col(f"_s{f}") < 1e-9, 1.0).otherwise(F.col(f"_s{f}")) for f in FEATURES}
    return groups.attach(raw, m, ["region"]).withColumns(std).drop(*[f"_{k}{f}" for k in "ms" for f in FEATURES])


def reference(cells: DataFrame, elasticity: float = 2.77, power: float = 0.35) -> DataFrame:
    """Adds ``ref``: population^elasticity times access^power, with sum 1 in each region; a sum of 0: equal weights."""
    access = F.pow(1 / (F.col(distance.centre_column(cells)) + 1), F.lit(0.7)) * F.pow(1 / (F.col("dist_to_city_km") + 1), F.lit(0.3))
    one = cells.select("region").distinct().withColumn("x_total", F.lit(1.0))
    return spread.normalize(cells, masked_power(F.col("population"), elasticity) * F.pow(access, F.lit(float(power))), one, "uniform", value="ref")


def targets(frame: DataFrame) -> DataFrame:
    """(region, t1, t2, t3): the reference's feature means."""
    return frame.groupBy("region").agg(*[F.sum(F.col("ref") * F.col(f)).alias(f"t{i + 1}") for i, f in enumerate(FEATURES)])


def _evaluate(frame: DataFrame, at: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """log Z, feature means and covariance of each region under its multipliers, in two aggregates."""
    spark = frame.sparkSession
    lam = spark.createDataFrame([(r, *map(float, v)) for r, v in at.items()], "region string, l1 double, l2 double, l3 double")
    score = sum((F.col(f"l{i + 1}") * F.col(f) for i, f in enumerate(FEATURES)), F.lit(0.0))
    s = frame.join(F.broadcast(lam), "region").withColumn("s", score)
    top = F.broadcast(s.groupBy("region").agg(F.max("s").alias("top")))
    e = s.join(top, "region").withColumn("e", F.exp(F.col("s") - F.col("top")))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    rows = e.groupBy("region").agg(
        F.max("top").alias("top"), F.sum("e").alias("z"), *[F.sum(F.col("e") * F.col(f)).alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col("e") * F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c{i}{j}") for i, j in pairs],
    ).collect()
    out = {}
    for r in rows:
        mean = np.array([r[f"m{i}"] for i in range(3)]) / r.z
        cov = np.zeros((3, 3))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}{j}"] / r.z - mean[i] * mean[j]
        out[r.region] = (r.top + np.log(r.z), mean, cov)
    return out


def solve(frame: DataFrame, goal: DataFrame, tolerance: float = 1e-8, steps: int = 60) -> DataFrame:
    """(region, l1, l2, l3, gap, steps, converged) for a frame with region and features; one row a region on the driver."""
    mu = {r.region: np.array([r.t1, r.t2, r.t3]) for r in goal.collect()}
    lam = {r: np.zeros(3) for r in mu}
    now = _evaluate(frame, lam) if mu else {}
    used = dict.fromkeys(mu, 0)
    for _ in range(steps):
        open_ = {r for r in mu if np.abs(now[r][1] - mu[r]).max() > tolerance}
        if not open_:
            break
        step = {r: np.linalg.solve(now[r][2] + 1e-10 * np.eye(3), mu[r] - now[r][1]) for r in open_}
        size = dict.fromkeys(open_, 1.0)
        for _ in range(8):
            trial = {r: lam[r] + size[r] * step[r] if r in open_ else lam[r] for r in mu}
            got = _evaluate(frame, trial)
            gap = lambda x, r: np.abs(x[r][1] - mu[r]).max()
            worse = [r for r in open_ if not (got[r][0] - trial[r] @ mu[r] <= now[r][0] - lam[r] @ mu[r] or gap(got, r) < gap(now, r))]
            if not worse:
                break
            for r in worse:
                size[r] /= 2
        # a region whose shortest step is still worse stays where it is
        better = open_ - set(worse)
        lam, now = {r: trial[r] if r in better else lam[r] for r in mu}, {r: got[r] if r in better else now[r] for r in mu}
        for r in better:
            used[r] += 1
        if not better:
            break
    rows = [(r, *map(float, lam[r]), float(np.abs(now[r][1] - mu[r]).max()), used[r], bool(np.abs(now[r][1] - mu[r]).max() <= 1e-6)) for r in sorted(mu)]
    return frame.sparkSession.createDataFrame(rows, "region string, l1 double, l2 double, l3 double, gap double, steps int, converged boolean")


def weights(frame: DataFrame, solution: DataFrame) -> DataFrame:
    """Adds ``p``, the distribution of the multipliers, with sum 1 in each region."""
    score = sum((F.col(f"l{i + 1}") * F.col(f) for i, f in enumerate(FEATURES)), F.lit(0.0))
    s = frame.join(F.broadcast(solution.select("region", "l1", "l2", "l3")), "region").withColumn("_s", score)
    top = s.groupBy("region").agg(F.max("_s").alias("_t"))
    e = groups.attach(s, top, ["region"]).withColumn("_e", F.exp(F.col("_s") - F.col("_t")))
    z = e.groupBy("region").agg(F.sum("_e").alias("_z"))
    return groups.attach(e, z, ["region"]).withColumn("p", F.col("_e") / F.col("_z")).drop("_s", "_t", "_e", "_z", "l1", "l2", "l3")


def prepared(cells: DataFrame, elasticity: float = 2.77, power: float = 0.35) -> DataFrame:
    return reference(features(cells), elasticity, power)


def allocate_frame(frame: DataFrame, totals: DataFrame, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(cells with p and value, solution) of a frame from ``prepared``."""
    frame = graph.settle(frame)
    solution = solve(frame.select("region", *FEATURES), targets(frame), tolerance)
    short = [r.region for r in solution.where("not converged").collect()]
    if short:
        warnings.warn(f"the means are not reached in {len(short)} regions, as {short[:5]}", RuntimeWarning, stacklevel=2)
    out = groups.attach(weights(frame, solution), totals.select("region", "x_total"), ["region"])
    return out.withColumn("value", F.col("x_total") * F.col("p")).drop("x_total"), solution


def allocate(cells: DataFrame, totals: DataFrame, elasticity: float = 2.77, power: float = 0.35, tolerance: float = 1e-8) -> DataFrame:
    """Cells with ``value``."""
    return allocate_frame(prepared(cells, elasticity, power), totals, tolerance)[0]


#: The two scenarios' elasticity and power of access.
SCENARIOS = {"strict": (2.77, 0.35), "smooth": (1.0, 0.5)}


def scenarios(cells: DataFrame, totals: DataFrame, variants: dict[str, tuple[float, float]] = SCENARIOS) -> tuple[DataFrame, DataFrame]:
    """(cells of all scenarios with p and value, solutions), each with a column ``scenario``; the features are made once."""
    frame, done, found = graph.settle(features(cells)), None, None
    for name, (elasticity, power) in variants.items():
        got, solution = allocate_frame(reference(frame, elasticity, power), totals)
        got, solution = got.withColumn("scenario", F.lit(name)), solution.withColumn("scenario", F.lit(name))
        done, found = (got, solution) if done is None else (done.unionByName(got), found.unionByName(solution))
    return done, found


def diagnostics(frame: DataFrame, goal: DataFrame) -> DataFrame:
    """(region, feature, target, achieved, error) of a frame with p."""
    a = frame.groupBy("region").agg(*[F.sum(F.col("p") * F.col(f)).alias(f"a{i + 1}") for i, f in enumerate(FEATURES)])
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"t{i + 1}").alias("target"), F.col(f"a{i + 1}").alias("achieved")) for i, f in enumerate(FEATURES)])
    d = a.join(goal, "region").select("region", F.explode(each).alias("d")).select("region", "d.*")
    return d.withColumn("error", F.abs(F.col("achieved") - F.col("target")))
