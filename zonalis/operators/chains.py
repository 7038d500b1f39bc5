"""Roads without the nodes in the middle of chains.

A node with two neighbours only leads on from one to the other. A chain of such nodes becomes one edge with the sum of its times;
its length is found by pointer jumping, so that the rounds grow with the logarithm of the longest chain. What a node in the
middle of a chain needs to either end is kept, so that times at the ends give its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.operators import graph


def contract(edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, legs) of a graph with both directions of each edge (``graph.undirected``).

    The edges (src, dst, travel_time) lead between the nodes that stay: those without exactly two neighbours, and those of
    ``keep`` (node). A leg (node, end, sec) leads from a node in the middle of a chain to one of its ends. Rings without a node that
    stays have neither: nothing leads to them.
    """
    e = graph.settle(edges.select("src", "dst", "travel_time").where("src <> dst"))
    middle = e.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("a"), F.max("dst").alias("b")).where("n = 2").select(F.col("src").alias("node"), "a", "b")
    if keep is not None:
        middle = middle.join(keep.select("node").distinct(), "node", "left_anti")
    middle = graph.settle(middle)
    # of each half edge how far it has been followed: the node reached, the one after that (null: the chain ends), the time
    turn = middle.select(F.col("node").alias("dst"), "a", "b")
    on = F.when(F.col("a") == F.col("src"), F.col("b")).otherwise(F.col("a"))
    walk = e.join(turn, "dst", "left").select("src", "dst", F.col("dst").alias("at"), F.when(F.col("a").isNotNull(), on).alias("next"), F.col("travel_time").alias("sec"))
    walk = graph.settle(walk)
    open_, done = walk.where("next is not null"), [walk.where("next is null")]
    for _ in range(math.ceil(math.log2(max(2, middle.count()))) + 1):
        if open_.isEmpty():
            break
        # what is followed next may have ended in an earlier round
        known = graph.settle(_all([open_, *done]))
        done = [known.where("next is null")]
        part = known.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("at").alias("_at"), F.col("next").alias("_next"), F.col("sec").alias("_sec"))
        step = known.where("next is not null").join(part, ["at", "next"]).select("src", "dst", F.col("_at").alias("at"), F.col("_next").alias("next"), (F.col("sec") + F.col("_sec")).alias("sec"))
        step = graph.settle(step)
        open_, done = step.where("next is not null"), [*done, step.where("next is null")]
    ends = _all(done).select("src", F.col("at").alias("end"), "sec")
    inner = middle.select(F.col("node").alias("src"))
    short = ends.join(inner, "src", "left_anti").where("src <> end").groupBy("src", F.col("end").alias("dst")).agg(F.min("sec").alias("travel_time"))
    return short, ends.join(inner, "src", "left_semi").select(F.col("src").alias("node"), "end", "sec")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def shortest(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph.shortest`` for a graph with both directions of each edge, without a round for each node of a chain."""
    short, legs = contract(edges, seeds.select("node"))
    times = graph.settle(graph.shortest(seeds, short))
    inner = legs.join(times.select("place_id", F.col("node").alias("end"), F.col("sec").alias("_t")), "end")
    inner = inner.groupBy("place_id", "node").agg(F.min(F.col("sec") + F.col("_t")).alias("sec"))
    return times.select("place_id", "node", "sec").unionByName(inner)
