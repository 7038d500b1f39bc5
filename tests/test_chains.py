"""Chains of roads as one edge."""

import random

from zonalis.operators import chains, graph

EDGE = "src long, dst long, travel_time double"


def test_a_path_of_ten_thousand_nodes_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    edges = graph.undirected(spark.range(n - 1).selectExpr("id as src", "id + 1 as dst", "1.5D as travel_time"))
    seeds = spark.createDataFrame([(7, 0), (8, 5000)], "place_id long, node long")
    rounds = []
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: rounds.append(1) or settle(df))
    got = {(r.place_id, r.node): r.sec for r in chains.shortest(seeds, edges).collect()}
    assert got == {**{(7, k): 1.5 * k for k in range(n)}, **{(8, k): 1.5 * abs(k - 5000) for k in range(n)}}
    assert len(rounds) < 2 * 30  # two tables a round


def test_random_graphs_with_chains_have_the_same_times(spark):
    r = random.Random(5)
    edges, new = [], 100
    for _ in range(40):  # chains of any length between few junctions, some from a junction to itself or to a dead end
        a, b, k = r.randrange(10), r.choice([r.randrange(10), None]), r.randrange(0, 12)
        way = [a, *range(new, new + k), *([b] if b is not None else [])]
        new += k
        edges += [(x, y, r.random() * 9 + 1) for x, y in zip(way, way[1:]) if x != y]
    edges += [(900 + k, 900 + (k + 1) % 5, 1.0) for k in range(5)]  # a ring that nothing leads to
    edges += [(950, 951, 1.0), (951, 952, 1.0), (952, 950, 5.0)]  # a ring with a seed
    both = graph.undirected(spark.createDataFrame(edges, EDGE)).persist()
    seeds = spark.createDataFrame([(1, 0), (2, 101), (3, 5), (3, 3), (4, 951)], "place_id long, node long")
    want = {(x.place_id, x.node): round(x.sec, 9) for x in graph.shortest(seeds, both).collect()}
    got = {(x.place_id, x.node): round(x.sec, 9) for x in chains.shortest(seeds, both).collect()}
    assert got == want and len(got) > 200
    short, legs = chains.contract(both)
    left = {x.src for x in short.collect()}
    degree = {x.src: x["count"] for x in both.groupBy("src").count().collect()}
    assert all(degree[k] != 2 for k in left) and {x.node for x in legs.collect()} == {k for k, n in degree.items() if n == 2 and not 900 <= k < 960}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], EDGE)
    seeds = spark.createDataFrame([(1, 4)], "place_id long, node long")
    assert [tuple(x) for x in chains.shortest(seeds, none).collect()] == [(1, 4, 0.0)]
    one = graph.undirected(spark.createDataFrame([(4, 5, 2.0), (4, 5, 1.0), (5, 5, 9.0)], EDGE))
    assert sorted(tuple(x) for x in chains.shortest(seeds, one).collect()) == [(1, 4, 0.0), (1, 5, 1.0)]
