import random
import time

import pytest

from codeweft.operators import graph, graph_local
from codeweft.operators.components import connected_components
from codeweft.plans import inventory_queries


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


CYCLE_TAIL = [(1, 2), (2, 3), (3, 1), (3, 4)]
CLIQUES = [(a, b) for g in ((1, 2, 3, 4), (5, 6, 7, 8)) for i, a in enumerate(g) for b in g[i + 1 :]] + [(4, 5)]


def test_coupling_of_a_fan(spark, rows):
    assert rows(graph.coupling(edges(spark, [(1, 2), (1, 3)]))) == [(1, 0, 2, 1.0, "unstable"), (2, 1, 0, 0.0, "stable"), (3, 1, 0, 0.0, "stable")]


@pytest.mark.parametrize("operator", [graph.page_rank, graph_local.page_rank])
def test_page_rank_sums_to_one(spark, operator):
    ranks = operator(edges(spark, CYCLE_TAIL), iterations=12).collect()
    assert sum(r["rank"] for r in ranks) == pytest.approx(1, abs=1e-9)
    stopped = operator(edges(spark, CYCLE_TAIL), iterations=100, tolerance=0.2).collect()
    assert len(stopped) == 4


@pytest.mark.parametrize("operator", [graph.page_rank, graph_local.page_rank])
def test_page_rank_counts_parallel_edges(spark, operator):
    ranks = {r["node"]: r["rank"] for r in operator(edges(spark, [(1, 2), (1, 2), (1, 3)]), iterations=1).collect()}
    base = 0.15 / 3 + 0.85 * (2 / 3) / 3
    assert ranks[2] == pytest.approx(base + 0.85 / 3 * 2 / 3) and ranks[3] == pytest.approx(base + 0.85 / 3 / 3)


def test_reach_and_paths(spark, rows):
    e = edges(spark, CYCLE_TAIL)
    start = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.reach(e, start)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.reach(e, start, max_depth=1)) == [(1, 0), (2, 1)]
    assert {r["node"]: r["path"] for r in graph.shortest_paths(e, 1).collect()}[4] == [1, 2, 3, 4]


@pytest.mark.parametrize("operator", [graph.strong_components, graph_local.strong_components])
def test_cycles(spark, rows, operator):
    two = [*CYCLE_TAIL, (7, 8), (8, 7), (4, 7), (9, 9)]
    assert rows(operator(edges(spark, two))) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (7, 7, 2), (8, 7, 2)]


@pytest.mark.parametrize("bound", [0, 1000])
def test_bridge_and_communities(spark, rows, monkeypatch, bound):
    monkeypatch.setattr(graph_local, "LOCAL_EDGES", bound)
    e = edges(spark, CLIQUES)
    assert rows(graph_local.bridges(e)) == [("articulation", 4, 4), ("articulation", 5, 5), ("bridge", 4, 5)]
    assert {r["community"] for r in graph_local.communities(e).collect()} == {1, 5}
    assert rows(graph.partition_quality(e, graph_local.communities(e))) == [(1, 4, 6, 1, 0.857), (5, 4, 6, 1, 0.857)]


def test_betweenness_of_a_path(spark, rows):
    assert rows(graph_local.edge_betweenness(edges(spark, [(1, 2), (2, 3)]))) == [(1, 2, 2.0), (2, 3, 2.0)]


def test_betweenness_does_not_depend_on_the_batch(spark, rows, monkeypatch):
    e = edges(spark, [(a + k, b + k) for k in (0, 100) for a, b in [*CYCLE_TAIL, (4, 5), (2, 5), (3, 3), (20, 21)]]).selectExpr("concat('n', src) as src", "concat('n', dst) as dst")
    some = spark.createDataFrame([("n3",), ("n101",), ("nowhere",)], "node string")
    expected = rows(graph.edge_betweenness(e.where("src <> dst").distinct(), some))
    for cells in (1, 40, 10_000):
        monkeypatch.setattr(graph_local, "WALK_CELLS", cells)
        assert rows(graph_local.edge_betweenness(e, some)) == expected


def test_betweenness_of_many_walks_ends_soon(spark):
    n, rings = 2000, 20
    e = spark.range(n * rings).selectExpr("id as src", f"id div {n} * {n} + (id + 1) % {n} as dst")
    began = time.time()
    found = graph_local.edge_betweenness(e).groupBy("betweenness").count().collect()
    assert [tuple(r) for r in found] == [(n * (n - 1) / 2, n * rings)] and time.time() - began < 40


def test_bottlenecks_of_many_walks_end_soon(spark, tmp_path):
    n, rings = 2000, 20
    ids = spark.range(n * rings)
    lines = ids.selectExpr("id as l_orderkey", "id as l_partkey", "1 as l_linenumber", "'R' as l_returnflag", "40.0D as l_quantity")
    lines.union(ids.selectExpr("id", f"id div {n} * {n} + (id + 1) % {n}", "2", "'R'", "1.0D")).write.parquet(str(tmp_path / "lineitem.parquet"))
    ids.selectExpr("id as p_partkey", "'t' as p_type", "'b' as p_brand", "'n' as p_name", "cast(id % 2 + 1 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    began = time.time()
    found = inventory_queries.k20_bottlenecks(spark, str(tmp_path)).groupBy("score").count().orderBy("score").collect()
    assert [tuple(r) for r in found] == [(1.5, n * rings // 2), (2.0, n * rings // 2)] and time.time() - began < 40


def test_bottlenecks_of_many_sources_and_a_large_tree_end_soon(spark, tmp_path):
    n, top = 30_000, 100_000
    e = spark.range(n).selectExpr("id + 10 as src", "0L as dst").union(spark.range(1, n).selectExpr(f"{top} + (id - 1) div 2", f"{top} + id"))
    e = e.union(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, top)], "src long, dst long")).selectExpr("src * 1000000 + dst as l_orderkey", "src", "dst")
    lines = e.selectExpr("l_orderkey", "src as l_partkey", "1 as l_linenumber", "'R' as l_returnflag", "40.0D as l_quantity")
    lines.union(e.selectExpr("l_orderkey", "dst", "2", "'R'", "1.0D")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(top + n).selectExpr("id as p_partkey", "'t' as p_type", "'b' as p_brand", "'n' as p_name", "1 as p_size").write.parquet(str(tmp_path / "part.parquet"))
    began = time.time()
    found = inventory_queries.k20_bottlenecks(spark, str(tmp_path)).collect()
    assert len(found) == 2 * n + 3 and time.time() - began < 40
    assert sorted((r.src, r.dst) for r in found if r.score == 2.0) == [(0, 1), (1, 2), (2, top)]


def test_betweenness_does_not_depend_on_what_is_walked_by_turns(spark, rows, monkeypatch):
    pick = random.Random(1)
    e = edges(spark, sorted({(a, b) for a, b in ((pick.randrange(50), pick.randrange(50)) for _ in range(60)) if a != b}))
    some = spark.createDataFrame([(k,) for k in range(0, 50, 2)], "node long")
    expected = rows(graph.edge_betweenness(e, some))
    for nodes, turns in ((1, 300), (1, 2)):
        monkeypatch.setattr(graph_local, "LATE_NODES", nodes)
        monkeypatch.setattr(graph_local, "LATE_TURNS", turns)
        found = rows(graph_local.edge_betweenness(e, some))
        assert [r[:2] for r in found] == [r[:2] for r in expected] and all(abs(a[2] - b[2]) < 3e-6 for a, b in zip(found, expected, strict=True))


def test_components(spark, rows):
    e = edges(spark, [(i, i + 1) for i in range(1, 30)] + [(50, 51), (60, 60), (None, 5)])
    assert rows(connected_components(e, "src", "dst")) == sorted([(i, 1) for i in range(1, 31)] + [(50, 50), (51, 50)], key=repr)
    assert connected_components(e.limit(0), "src", "dst").count() == 0


def test_percent_position(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "k long, v long")
    assert rows(graph.percent_position(df, "v", "k", "p").select("k", "p")) == [(1, 0.5), (2, 1.0), (3, 0.0)]
    assert rows(graph.percent_position(df.limit(1), "v", "k", "p").select("p")) == [(0.5,)]
