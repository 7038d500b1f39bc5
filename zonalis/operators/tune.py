"""Parameter sweeps scored by rank correlation with a target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scalar import KERNELS, kernel
from zonalis.operators import allocate, distance, farfield, graph, groups, spots
from zonalis.operators.ranks import average_rank, running


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """by..., rho: rank correlation with mean ranks of ties; 0 where either side is constant."""
    return correlation(average_rank(average_rank(df, a, by, "_ra"), b, by, "_rb"), by)


def correlation(r: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., rho of the ranks _ra and _rb."""
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    return r.groupBy(*by).agg(F.coalesce(F.covar_pop("_ra", "_rb") / F.nullif(spread, F.lit(0.0)), F.lit(0.0)).alias("rho"))


#: One combination of a sweep: kernel, beta, scale and the positions of the last two in their grids.
Combo = tuple[str, float, float, int, int]


def grid(kind: str, scales: Sequence[float], betas: Sequence[float]) -> list[Combo]:
    return [(kind, float(b), float(s), i, j) for i, b in enumerate(betas) for j, s in enumerate(scales)]


def summed(pairs: DataFrame, combos: Sequence[Combo]) -> DataFrame:
    """(region, cell_id, w0, w1, ...): the weights of all combinations, in one pass over the pairs."""
    sums = [F.sum(F.pow("share", F.lit(b)) * kernel(F.col("d"), s, kind)).alias(f"w{i}") for i, (kind, b, s, _, _) in enumerate(combos)]
    return pairs.groupBy("region", "cell_id").agg(*sums)


def sweep(pairs: DataFrame, target: DataFrame, kind: str, scales: Sequence[float], betas: Sequence[float] = (1.0,)) -> DataFrame:
    """(region, kind, beta, scale, beta_pos, scale_pos, rho) of every combination.

    ``pairs`` (region, cell_id, d, share) has each place's part of the region's greatest population; one pass over
    it makes the sums of all combinations. ``target`` is (region, cell_id, target).
    """
    combos = grid(kind, scales, betas)
    return scored(summed(pairs, combos), target, combos)


def scored(sums: DataFrame, target: DataFrame, combos: Sequence[Combo], at: Sequence[str] = ("region", "cell_id")) -> DataFrame:
    """The trace of combinations whose weights are made: (at..., w0, w1, ...), one for each. ``target`` has a row for each cell.

    Cells that share ``at`` share their weights: they are ranked as one row that counts as often as there are cells, with the sum of
    their targets' ranks, and equal weights of a combination are one row as well. A weight's rank needs no row of a cell.
    """
    # one rank of the target serves all combinations
    ranked = average_rank(target, "target", ("region",), "_rb")
    goal = ranked.groupBy(*at).agg(F.count("*").alias("_n"), F.sum("_rb").alias("_r"), F.sum(F.col("_rb") * F.col("_rb")).alias("_q"), F.min("_rb").alias("_low"), F.max("_rb").alias("_high"))
    cells = graph.settle(sums.join(goal, list(at)))
    # sums that differ only by the order of their terms are equal: eleven digits count
    digits = lambda w: F.when(w > 1e-290, F.rint(w / F.pow(F.lit(10.0), F.floor(F.log10(w)) - 10)) * F.pow(F.lit(10.0), F.floor(F.log10(w)) - 10)).otherwise(w)
    params = F.posexplode(F.array(*[F.col(f"w{i}") for i in range(len(combos))]))
    long = cells.select("region", "_n", "_r", "_q", "_low", "_high", params.alias("combo", "w")).where("w is not null").withColumn("w", digits(F.col("w")))
    one = ["region", "combo"]
    blocks = long.groupBy(*one, "w").agg(F.sum("_n").alias("_c"), F.sum("_r").alias("_r"), F.sum("_q").alias("_q"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    # ranks less their mean, which is half of one more than all cells
    ranks = running(blocks, one, "w", "_c", "_b", total="_all").withColumn("_a", F.col("_b") - (F.col("_all") - F.col("_c")) / 2)
    n, r = F.sum("_c"), F.sum("_r")
    spread = F.sqrt(F.sum(F.col("_c") * F.col("_a") * F.col("_a")) * (F.sum("_q") - r * r / n))
    ends = (F.count("*") > 1) & (F.min("_low") < F.max("_high"))
    rho = ranks.groupBy(*one).agg(F.when(ends, F.sum(F.col("_a") * F.col("_r")) / F.nullif(spread, F.lit(0.0))).alias("rho"))
    rho = rho.withColumn("rho", F.coalesce("rho", F.lit(0.0)))
    names = cells.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(combos)], "combo int, kind string, beta double, scale double, beta_pos int, scale_pos int")
    return rho.join(F.broadcast(names), "combo").select("region", "kind", "beta", "scale", "beta_pos", "scale_pos", "rho")


def _masses(places: DataFrame, at: Sequence[str], betas: Sequence[float]) -> DataFrame:
    """(at..., m0, m1, ...): the places' spots with the sums of share^beta."""
    return places.groupBy(*at).agg(*[F.sum(F.pow("share", F.lit(float(b)))).alias(f"m{j}") for j, b in enumerate(betas)])


def _terms(combos: Sequence[Combo]) -> list[spots.Term]:
    return [(kind, scale, f"m{j}") for kind, _, scale, j, _ in combos]


def by_road(legs: graph.Legs, shares: DataFrame, target: DataFrame, kind: str, scales: Sequence[float], betas: Sequence[float] = (1.0,)) -> DataFrame:
    """The trace of a sweep over travel minutes in two parts, with shares (place_id, share): ``sweep`` without a row for each pair."""
    combos = grid(kind, scales, betas)
    ways = _masses(legs.ways.join(shares, "place_id"), ("region", "c_at", "at"), betas)
    sums = spots.sums(spots.spots(legs.cells, "region", "c_at", "at"), ways, ["region", "c_at"], ["at"], _terms(combos))
    return scored(sums, target.join(legs.cells, ["region", "cell_id"]), combos, ("region", "c_at", "at"))


def best(trace: DataFrame) -> DataFrame:
    """(region, kind, beta, scale, rho) with the greatest rho; of equal ones (to 9 places) the first beta, then the first scale."""
    first = F.min(F.struct((-F.round("rho", 9)).alias("m"), "beta_pos", "scale_pos", "beta", "scale", "rho")).alias("b")
    return trace.groupBy("region", "kind").agg(first).select("region", "kind", "b.beta", "b.scale", "b.rho")


def gravity(cells: DataFrame, places: DataFrame, kind: str, scales: Sequence[float], betas: Sequence[float] = (1.0,), buffer_km: float | None = 30.0, far: float | None = None) -> DataFrame:
    """The trace of a sweep against the cells' population; with ``far`` places far away count together (``farfield``)."""
    return kernels(cells, places, {kind: scales}, betas, buffer_km, far)


def kernels(cells: DataFrame, places: DataFrame, grids: dict[str, Sequence[float]], betas: Sequence[float] = (1.0,), buffer_km: float | None = 30.0, far: float | None = None) -> DataFrame:
    """The traces of several kernels: spots of cells meet spots of places once for all of them."""
    near = distance.within_buffer(places, cells, buffer_km) if buffer_km is not None else places
    shares = allocate.masses(near, 1.0).withColumnRenamed("mass", "share")
    at = ("region", "x", "y")
    goal = cells.select(*at, "cell_id", F.col("population").alias("target"))
    combos = {kind: grid(kind, scales, betas) for kind, scales in grids.items()}
    if far is not None:
        out = None
        for kind, part in combos.items():
            one = scored(farfield.fields(cells, shares, kind, grids[kind], betas, far), goal, part, at)
            out = one if out is None else out.unionByName(one)
        return out
    every = [c for part in combos.values() for c in part]
    return scored(spots.sums(spots.spots(cells, *at), _masses(shares, at, betas), at[:1], at[1:], _terms(every)), goal, every, at)


def allocated(cells: DataFrame, places: DataFrame, totals: DataFrame, chosen: DataFrame, buffer_km: float | None = 30.0) -> DataFrame:
    """(region, kind, cell_id, value): gravity allocation by each region's chosen (region, kind, beta, scale), all kernels in one
    pass over the pairs."""
    near = distance.within_buffer(places, cells, buffer_km) if buffer_km is not None else places
    # a column for each kernel: a region's beta is in its masses, its scale beside them
    wide = chosen.groupBy("region").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}") for k in KERNELS for c in ("beta", "scale")])
    p = groups.attach(allocate.masses(near, 1.0).withColumnRenamed("mass", "share"), wide, ["region"])
    at = ["region", "x", "y"]
    mass = [F.sum(F.pow("share", f"beta_{k}")).alias(f"m_{k}") for k in KERNELS]
    towns = p.groupBy(*at, *[f"scale_{k}" for k in KERNELS]).agg(*mass)
    found = spots.sums(spots.spots(cells, *at), towns, at[:1], at[1:], [(k, f"scale_{k}", f"m_{k}") for k in KERNELS])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"w{i}").alias("weight")) for i, k in enumerate(KERNELS)])).alias("e")
    one = cells.select(*at, "cell_id").join(found, at).select("region", "cell_id", each).select("region", "cell_id", "e.*")
    both = totals.join(chosen.select("region", "kind"), "region")
    return allocate.normalize(one, "weight", both, "uniform", by=("region", "kind"), settle=True).drop("weight")
