"""Sums of kernels over cells and places by their spots: cells at one spot of a group have one weight, and places at one spot count
together with the sum of their masses.

Spots meet in blocks: a group's cell spots are dealt to parts by hash, its place spots too, and each pair of parts is one group of a
cogroup, whose distances are made a slice at a time. What a task holds does not grow with the tables, and no row is made for a
pair; the parts' sums, a row for each cell spot and part of places, are added up by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions.scalar import KERNELS
from zonalis.operators import graph, groups

#: Spots of cells and places of one block, and distances that are held at once.
CELLS, PLACES, SLICE = 2048, 16384, 1 << 19

#: So many rows of one spot are about one list, and so many of a group's places.
LIST, PACK = 64, 128

#: A kernel, its scale (or the places' column with their group's scale), and the places' column of masses.
Term = tuple[str, float | str, str]


def spots(df: DataFrame, *at: str) -> DataFrame:
    """The distinct values of ``at``, without nulls."""
    return df.select(*at).dropna().distinct()


def _block(names: Sequence[str], at: Sequence[str], terms: Sequence[Term], most: int):
    """The function that adds up one block: the cell spots with the sums of all terms over the place spots; none where either side is
    empty. It holds all that it uses, so that executors need not have this package."""
    # one pass of a kernel serves all masses it is met with
    by_kernel: dict[tuple, list[int]] = {}
    for k, (kind, scale, _) in enumerate(terms):
        by_kernel.setdefault((kind, scale), []).append(k)

    def decayed(d, scale, kind):
        if kind == "exp":
            f = np.exp(-d / scale)
        elif kind == "gauss":
            f = np.exp(-(d * d) / (2.0 * scale * scale))
        else:
            f = np.power(d + 1, -scale)
        f[d == np.inf] = 0.0
        return f

    def values(table, name):
        return table.column(name).to_numpy().astype(float)

    def block(left, right):
        left = left if right.num_rows else left.slice(0, 0)
        out = np.zeros((left.num_rows, len(terms)))
        known = {m: right.column(m).null_count < right.num_rows for *_, m in terms}
        if left.num_rows:
            c, p = [values(left, a) for a in at], [values(right, a) for a in at]
            mass = {m: np.where(right.column(m).is_null().to_numpy(), 0.0, values(right, m)) for m in known}
            columns = {key: np.stack([mass[terms[k][2]] for k in ks], axis=1) for key, ks in by_kernel.items()}
            step = max(1, most // right.num_rows)
            for i in range(0, left.num_rows, step):
                if len(at) == 1:
                    d = c[0][i : i + step, None] + p[0][None, :]
                else:
                    dx, dy = (c[k][i : i + step, None] - p[k][None, :] for k in (0, 1))
                    d = np.sqrt(dx * dx + dy * dy) / 1000
                for (kind, scale), ks in by_kernel.items():
                    s = float(right.column(scale)[0].as_py()) if isinstance(scale, str) else scale
                    out[i : i + step, ks] = decayed(d, s, kind) @ columns[kind, scale]
        sums = [pa.array(out[:, k]) if known[m] else pa.nulls(left.num_rows, pa.float64()) for k, (*_, m) in enumerate(terms)]
        return pa.Table.from_arrays([*[left.column(n).combine_chunks() for n in names], *sums], names=[*names, *[f"w{k}" for k in range(len(terms))]])

    return block


def _dealt(df: DataFrame, by: Sequence[str], at: Sequence[str], mine: str, other: str, counts: DataFrame) -> DataFrame:
    """Rows with the number of their part and each part of the other side."""
    rows = groups.attach(df, counts, by)
    return rows.withColumn(mine, F.pmod(F.xxhash64(*at), F.col(f"_n{mine}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(f"_n{other}") - 1).cast("int")))).drop(f"_n{mine}", f"_n{other}")


def _parted(cells: DataFrame, places: DataFrame, by: Sequence[str], at: str, terms: Sequence[Term]) -> DataFrame:
    """``sums`` of exponential kernels over distances in two parts: exp(-(a + b) / s) is exp(-a / s) * exp(-b / s), so a group's places are
    added up once for all its cells, and no pair is met."""
    part = lambda scale: F.exp(-F.col(at) / (F.col(scale) if isinstance(scale, str) else F.lit(float(scale))))
    own = {scale: f"_s{i}" for i, scale in enumerate(dict.fromkeys(scale for _, scale, _ in terms if isinstance(scale, str)))}
    groups_ = places.groupBy(*by).agg(*[F.sum(F.col(m) * part(scale)).alias(f"w{k}") for k, (_, scale, m) in enumerate(terms)], *[F.first(scale).alias(name) for scale, name in own.items()])
    rows = groups.attach(cells, groups_, by)
    return rows.select(*by, at, *[(F.col(f"w{k}") * part(own.get(scale, scale))).alias(f"w{k}") for k, (_, scale, _) in enumerate(terms)])


def sums(cells: DataFrame, places: DataFrame, by: Sequence[str], at: Sequence[str], terms: Sequence[Term]) -> DataFrame:
    """(by..., at..., w0, w1, ...): for each spot of cells the sums of mass * kernel(d) over the places of its group.

    ``cells`` has each spot once; ``places`` has spots with their masses (places that share a spot may be one row). Two columns
    ``at`` are metres on the plane, and d kilometres; one is a part of the distance, and d the sum of both parts, where
    exponential kernels need no pairs. Spots of groups without places have no row.
    """
    by, at, terms = list(by), list(at), list(terms)
    if unknown := {kind for kind, *_ in terms} - set(KERNELS):
        raise ValueError(f"unknown kernels {sorted(unknown)}; some of {KERNELS}")
    if len(at) == 1 and all(kind == "exp" for kind, *_ in terms):
        return _parted(cells.select(*by, *at), places.dropna(subset=at), by, at[0], terms)
    cells, places = graph.settle(cells.select(*by, *at)), graph.settle(places.dropna(subset=at))
    count = lambda df, name, size: df.groupBy(*by).agg(F.ceil(F.count("*") / size).alias(name))
    counts = graph.settle(count(cells, "_n_c", CELLS).join(count(places, "_n_p", PLACES), by))
    key = [*by, "_c", "_p"]
    n = cells.sparkSession.sparkContext.defaultParallelism * 4
    # a number of partitions that is asked for stays: a block is little data and much work
    left = _dealt(cells, by, at, "_c", "_p", counts).repartition(n, *key)
    right = _dealt(places, by, at, "_p", "_c", counts).repartition(n, *key)
    names = [*by, *at]
    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*names).schema] + [f"w{k} double" for k in range(len(terms))])

    each = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block(names, at, terms, SLICE), kinds)
    return each.groupBy(*names).agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(terms))])


def _numbered(df: DataFrame, by: Sequence[str], at: Sequence[str], key: str) -> DataFrame:
    """(by..., at..., key, _k): the rows of one spot in parts of about ``LIST``."""
    part = F.pmod(F.xxhash64(key), F.ceil(F.count("*").over(W.partitionBy(*by, *at)) / LIST))
    return df.select(*by, *at, key, part.alias("_k"))


def pairs(cells: DataFrame, places: DataFrame, by: Sequence[str], at: Sequence[str], d: Callable[..., Column], salts: int) -> DataFrame:
    """(by..., cell_id, place_id, d) of all cells and places of a group; ``d`` makes a distance of the columns ``at`` of the cell and
    of the place.

    A spot's cells are in lists, and a group's places in lists of about ``PACK``, those of one spot side by side. The distances of a
    list are made once for a spot of cells, and laid open for each of its cells after it: a cell's rows and equal distances lie
    together, which keeps the files small that they are written to. A group's cells are dealt to ``salts`` parts, each with all
    its places, in a number of tasks that stays: parts are little data and many rows.
    """
    by, at = list(by), list(at)
    n = cells.sparkSession.sparkContext.defaultParallelism * 8
    right = _numbered(cells, by, at, "cell_id").groupBy(*by, *at, "_k").agg(F.collect_list("cell_id").alias("_c")).drop("_k")
    right = right.withColumn("_s", F.pmod(F.xxhash64(*at, "_c"), F.lit(salts)).cast("int")).repartition(n, *by, "_s")
    rows = groups.attach(_numbered(places, by, at, "place_id"), places.groupBy(*by).agg(F.ceil(F.count("*") / PACK).alias("_n")), by)
    pack = F.pmod(F.xxhash64(*at, "_k"), F.col("_n")).alias("_k")
    packs = rows.groupBy(*by, pack).agg(F.sort_array(F.collect_list(F.struct(*at, "place_id"))).alias("_l"))
    far = [f"_p{a}" for a in at]
    packs = packs.select(*by, F.col("_l.place_id").alias("_p"), *[F.col(f"_l.{a}").alias(f) for a, f in zip(at, far)])
    left = packs.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(n, *by, "_s").hint("merge")
    made = F.transform(F.col(far[0]), lambda first, i: d(*map(F.col, at), first, *[F.get(f, i) for f in far[1:]]))
    # the packs come first, so that a merge meets all cells of a part with one of them; each cell gets the whole list
    both = left.join(right, [*by, "_s"]).select(*by, "_c", "_p", made.alias("_d"))
    each = both.select(*by, F.explode("_c").alias("cell_id"), "_p", "_d").select(*by, "cell_id", "_d", F.posexplode("_p").alias("_i", "place_id"))
    return each.select(*by, "cell_id", "place_id", F.get("_d", F.col("_i")).alias("d"))
