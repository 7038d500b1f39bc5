"""The road queries over all trade between nations, and sparse graphs by hand."""

import duckdb

from zonalis.operators import graph
from zonalis.plans.catalog import QUERIES
from zonalis.plans.oracle import ORACLE

SF = "/root/testdata/sf0.01"


def test_no_edge_is_left_out(spark):
    q = f"""select distinct s_nationkey, c_nationkey from '{SF}/lineitem.parquet' join '{SF}/orders.parquet' on l_orderkey = o_orderkey
join '{SF}/customer.parquet' on o_custkey = c_custkey join '{SF}/supplier.parquet' on l_suppkey = s_suppkey where s_nationkey <> c_nationkey"""
    want = {(a, b) for x in duckdb.sql(q).fetchall() for a, b in (x, x[::-1])}
    got = [(r.src, r.dst) for r in QUERIES["road_undirected"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert not any("%" in ORACLE[k].replace("% 400", "").replace("% 40000", "") for k in ("road_undirected", "shortest_paths", "largest_component"))


def test_sparse_and_parted_graph(spark):
    nodes = spark.createDataFrame([(i, 0.0, 0.0) for i in range(6)], "id long, x double, y double")
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (3, 4, 1.0)], "src long, dst long, travel_time double")
    seeds = nodes.selectExpr("id as place_id", "id as node")
    got = {(r.place_id, r.node): r.sec for r in graph.shortest(seeds, graph.undirected(edges)).collect()}
    assert got[0, 2] == 5.0 and got[4, 3] == 1.0 and (0, 3) not in got and (5, 0) not in got and len(got) == 14
    assert sorted(r.id for r in graph.largest_component(nodes, edges).collect()) == [0, 1, 2]


def test_long_path_and_chains(spark):
    n = 40
    nodes = spark.range(n + 3).selectExpr("id", "0.0D as x", "0.0D as y")
    edges = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst", "1.5D as travel_time").union(spark.createDataFrame([(n, n + 1, 1.0), (0, n - 1, 100.0)], "src long, dst long, travel_time double"))
    seeds = spark.createDataFrame([(7, 0), (8, n - 1)], "place_id long, node long")
    got = {(r.place_id, r.node): r.sec for r in graph.shortest(seeds, graph.undirected(edges)).collect()}
    assert got == {**{(7, k): 1.5 * k for k in range(n)}, **{(8, k): 1.5 * (n - 1 - k) for k in range(n)}}
    label = {r.node: r.label for r in graph.components(nodes, edges).collect()}
    assert label == {**dict.fromkeys(range(n), 0), n: n, n + 1: n, n + 2: n + 2}
    assert sorted(r.id for r in graph.largest_component(nodes, edges).collect()) == list(range(n))
