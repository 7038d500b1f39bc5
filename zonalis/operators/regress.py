"""Least squares on log1p of target and features, from sums; a model is a few numbers on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def predict(self) -> Column:
        """The fitted log1p of the target."""
        out = F.lit(self.intercept)
        for f, c in zip(self.features, self.coefficients):
            out = out + F.lit(c) * F.log1p(F.col(f))
        return out

    def table(self, spark) -> DataFrame:
        """(term, coefficient)."""
        return spark.createDataFrame([("intercept", self.intercept), *zip(self.features, self.coefficients)], "term string, coefficient double")


def positive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where all the columns are there and above 0."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.col(c) > 0)
    return df.where(ok)


def _sums(df: DataFrame, target: str, features: Sequence[str], by: str | None = None):
    x = [F.lit(1.0), *[F.log1p(F.col(f)) for f in features], F.log1p(F.col(target))]
    cells = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    n = len(x)
    for row in (df.groupBy(by) if by else df.groupBy()).agg(*cells).collect():
        m = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
        yield (row[by] if by else None), m


def _solve(m: np.ndarray, features: Sequence[str]) -> Model:
    a, b = m[:-1, :-1], m[:-1, -1]
    c = np.linalg.lstsq(a, b, rcond=None)[0]
    return Model(tuple(features), tuple(float(v) for v in c[1:]), float(c[0]))


def fit(df: DataFrame, target: str, features: Sequence[str]) -> Model:
    """One pass: the normal equations' sums are an aggregate."""
    _, m = next(_sums(df, target, features))
    return _solve(m, features)


def r2(df: DataFrame, target: str, model: Model) -> DataFrame:
    """(r2,): 1 - residual / total sum of squares on the log scale."""
    y = F.log1p(F.col(target))
    e = df.select(y.alias("y"), (y - model.predict()).alias("e"))
    return e.agg((1 - F.sum(F.col("e") * F.col("e")) / (F.var_pop("y") * F.count("y"))).alias("r2"))


def predictions(df: DataFrame, target: str, model: Model) -> DataFrame:
    """Adds predicted (on the target's scale), residual (log scale) and abs_residual."""
    e = F.log1p(F.col(target)) - model.predict()
    return df.withColumns({"predicted": F.expm1(model.predict()), "residual": e, "abs_residual": F.abs(e)})


def outliers(df: DataFrame, target: str, model: Model, key: str, n: int = 5) -> DataFrame:
    """The n rows with the greatest absolute residuals, of equal ones by key."""
    return predictions(df, target, model).orderBy(F.desc("abs_residual"), key).limit(n)


def cross_validate(df: DataFrame, target: str, features: Sequence[str], fold: Column) -> DataFrame:
    """(folds, r2_mean, r2_std): each fold is scored by the fit on the others; one pass makes all folds' sums."""
    cut = df.withColumn("_f", fold)
    sums = dict(_sums(cut, target, features, "_f"))
    scores = []
    for k, test in sums.items():
        model = _solve(sum(m for j, m in sums.items() if j != k), features)
        c = np.array([model.intercept, *model.coefficients])
        n, sy, syy = test[0, 0], test[0, -1], test[-1, -1]
        residual = syy - 2 * c @ test[:-1, -1] + c @ test[:-1, :-1] @ c
        scores.append(1 - residual / (syy - sy * sy / n))
    return df.sparkSession.createDataFrame([(len(scores), float(np.mean(scores)), float(np.std(scores)))], "folds int, r2_mean double, r2_std double")


def shuffled_folds(n: int, folds: int = 5, seed: int = 42) -> list[int]:
    """Fold of each row number: a seeded permutation cut into parts, the first n % folds one larger."""
    order = np.random.RandomState(seed).permutation(n)
    out = np.empty(n, int)
    for k, part in enumerate(np.array_split(order, folds)):
        out[part] = k
    return out.tolist()
