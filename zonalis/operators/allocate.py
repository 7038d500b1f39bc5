"""Spreading one total of a region over its cells: values are total * weight / sum of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scalar import finite, kernel, masked_power
from zonalis.operators import distance, farfield, graph, groups, spots


def normalize(df: DataFrame, weight: Column | str, totals: DataFrame, on_zero: str = "uniform", by: tuple[str, ...] = ("region",), value: str = "value", settle: bool = False) -> DataFrame:
    """Adds ``value``; ``totals`` has the keys ``by`` and x_total.

    Where the weights' sum is not a positive number: equal shares (uniform), 0 (zero) or null (null). The sums are made first and
    sent to all tasks, so the rows stay where they are; the weights are made twice, for their sum and for the shares, and
    with ``settle`` they are written in between, as dear ones should be.
    """
    if on_zero not in ("uniform", "zero", "null"):
        raise ValueError(f"unknown on_zero {on_zero!r}")
    w = df.withColumn("_w", F.col(weight) if isinstance(weight, str) else weight)
    w = graph.settle(w) if settle else w
    sums = w.groupBy(*by).agg(F.sum("_w").alias("_s"), F.count("*").alias("_n")).join(totals.select(*by, "x_total"), list(by))
    other = {"uniform": F.col("x_total") / F.col("_n"), "zero": F.lit(0.0), "null": F.lit(None).cast("double")}[on_zero]
    ok = finite(F.col("_s")) & (F.col("_s") > 0)
    return groups.attach(w, sums, by).withColumn(value, F.when(ok, F.col("x_total") * F.col("_w") / F.col("_s")).otherwise(other)).drop("_w", "_s", "_n", "x_total")


def area(cells: DataFrame, totals: DataFrame) -> DataFrame:
    return normalize(cells, "area_km2", totals, "null")


def proximity(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """0.7 / (distance to the centre + 1) + 0.3 / (distance to the nearest place + 1)."""
    return normalize(cells, 0.7 / (F.col(distance.centre_column(cells)) + 1) + 0.3 / (F.col("dist_to_city_km") + 1), totals, "null")


def remoteness(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """Distance to the nearest place / (distance to the centre + 1)."""
    return normalize(cells, F.col("dist_to_city_km") / (F.col(distance.centre_column(cells)) + 1), totals, "null")


def nearest_place(cells: DataFrame, totals: DataFrame) -> DataFrame:
    return normalize(cells, 1 / (F.col("dist_to_city_km") + 1), totals, "null")


def population(cells: DataFrame, totals: DataFrame) -> DataFrame:
    return normalize(cells, "population", totals, "null")


def elasticity(cells: DataFrame, totals: DataFrame, exponent: float = 2.77) -> DataFrame:
    return normalize(cells, masked_power(F.col("population"), exponent), totals, "zero")


def masses(places: DataFrame, beta: float = 1.0) -> DataFrame:
    """Adds ``mass`` = (population / the region's greatest)^beta; where the greatest is not positive it counts as 1."""
    top = places.groupBy("region").agg(F.max("population").alias("_m"))
    share = F.col("population") / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)
    return groups.attach(places, top, ["region"]).withColumn("mass", F.pow(share, F.lit(float(beta)))).drop("_m")


def potential(pairs: DataFrame, scale: float, kind: str = "exp", use_population: bool = True) -> DataFrame:
    """(region, cell_id, weight): for pairs (region, cell_id, d, mass) the sum of mass * kernel(d) of each cell."""
    f = kernel(F.col("d"), scale, kind)
    return pairs.groupBy("region", "cell_id").agg(F.sum(F.col("mass") * f if use_population else f).alias("weight"))


def decay(cells: DataFrame, places: DataFrame, totals: DataFrame, scale: float, kind: str = "exp", beta: float = 1.0, buffer_km: float | None = 30.0, use_population: bool = True, far: float | None = None, **options) -> DataFrame:
    """Gravity allocation; places out of reach of all cells are left out before masses are formed.

    With ``far`` places far away count together (``farfield``, whose options may be given), and a cell's weight is off by no more
    than that part of itself and the mean weight; else every spot of cells meets every spot of places of its region.
    """
    near = distance.within_buffer(places, cells, buffer_km) if buffer_km is not None else places
    if far is not None:
        share = masses(near, 1.0).withColumn("share", F.col("mass") if use_population else F.lit(1.0))
        found = farfield.fields(cells, share, kind, (scale,), (beta,), far, **options)
    else:
        mass = F.sum("mass") if use_population else F.sum(F.lit(1.0))
        towns = masses(near, beta).groupBy("region", "x", "y").agg(mass.alias("m"))
        found = spots.sums(spots.spots(cells, "region", "x", "y"), towns, ["region"], ["x", "y"], [(kind, float(scale), "m")])
    return on_weights(cells, found.withColumnRenamed("w0", "weight"), totals, ("region", "x", "y"))


def decay_network(cells: DataFrame, places: DataFrame, minutes: DataFrame | graph.Legs, totals: DataFrame, scale: float, kind: str = "exp", beta: float = 1.0, buffer_km: float | None = 30.0) -> DataFrame:
    """Gravity allocation by travel minutes (region, cell_id, place_id, d), or by ``graph.legs``, which need no row for each pair; places
    out of the buffer are left out as in ``decay``."""
    near = distance.within_buffer(places, cells, buffer_km) if buffer_km is not None else places
    mass = masses(near, beta).select("place_id", "mass")
    if isinstance(minutes, graph.Legs):
        ways = minutes.ways.join(mass, "place_id").groupBy("region", "c_at", "at").agg(F.sum("mass").alias("m"))
        found = spots.sums(spots.spots(minutes.cells, "region", "c_at", "at"), ways, ["region", "c_at"], ["at"], [(kind, float(scale), "m")])
        there = cells.join(minutes.cells.select("region", "cell_id", "c_at", "at"), ["region", "cell_id"], "left")
        return on_weights(there, found.withColumnRenamed("w0", "weight"), totals, ("region", "c_at", "at")).drop("c_at", "at")
    return on_weights(cells, potential(minutes.join(mass, "place_id"), scale, kind), totals)


def on_weights(cells: DataFrame, weights: DataFrame, totals: DataFrame, on: tuple[str, ...] = ("region", "cell_id")) -> DataFrame:
    """Allocation by weights (region, cell_id, weight), or of the spots ``on``; cells without one have 0."""
    w = cells.join(weights, list(on), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return normalize(w, "weight", totals, "uniform", settle=True)


#: Methods whose weights are made from a cell alone: weight and what a sum of zero gives.
SIMPLE = {
    "area": (lambda: F.col("area_km2"), "null"),
    "population": (lambda: F.col("population"), "null"),
    "elasticity": (lambda: masked_power(F.col("population"), 2.77), "zero"),
}


def several(cells: DataFrame, totals: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(region, cell_id, method, value) of ``SIMPLE`` methods: one aggregate over the cells and one pass for all of them."""
    w = cells.select("region", "cell_id", *[SIMPLE[m][0]().alias(f"_w{k}") for k, m in enumerate(methods)])
    sums = w.groupBy("region").agg(*[F.sum(f"_w{k}").alias(f"_s{k}") for k in range(len(methods))]).join(totals.select("region", "x_total"), "region")

    def share(k: int, method: str) -> Column:
        s = F.col(f"_s{k}")
        other = F.lit(0.0 if SIMPLE[method][1] == "zero" else None).cast("double")
        return F.struct(F.lit(method).alias("method"), F.when(finite(s) & (s > 0), F.col("x_total") * F.col(f"_w{k}") / s).otherwise(other).alias("value"))

    each = F.array(*[share(k, m) for k, m in enumerate(methods)])
    return groups.attach(w, sums, ["region"]).select("region", "cell_id", F.explode(each).alias("m")).select("region", "cell_id", "m.method", "m.value")


def rescale(df: DataFrame, factor: float = 1000.0, value: str = "value") -> DataFrame:
    """Another unit, as thousand millions to millions."""
    return df.withColumn(value, F.col(value) * factor)


def run(cells: DataFrame, totals: DataFrame, method: str, **options) -> DataFrame:
    """Allocation by the method's name; further inputs (places) and parameters by keyword."""
    known = {"area": area, "proximity": proximity, "remoteness": remoteness, "nearest_place": nearest_place, "population": population, "elasticity": elasticity}
    if method in known:
        return known[method](cells, totals, **options)
    if method == "decay":
        return decay(cells, options.pop("places"), totals, **options)
    if method == "network":
        return decay_network(cells, options.pop("places"), options.pop("minutes"), totals, **options)
    if method == "maxent":
        from zonalis.operators import maxent

        return maxent.allocate(cells, totals, **options)
    raise ValueError(f"unknown method {method!r}")
