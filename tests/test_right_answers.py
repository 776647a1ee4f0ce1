"""Answers that were wrong once, each against the rule it has to follow."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeweft import runtime
from codeweft.functions.exprs import identity_score
from codeweft.operators import graph, graph_local, history, search
from codeweft.sources import sinks
from codeweft.streaming import spans


def test_upsert_keeps_old_rows_when_a_column_is_added(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 1), (2, 1)], "k int, v int").write.parquet(path)
    after = spark.read.parquet(sinks.upsert(spark, path, spark.createDataFrame([(3, 1, "x")], "k int, v int, more string"), ["k"], "v"))
    assert rows(after.select("k", "more")) == [(1, None), (2, None), (3, "x")]
    with pytest.raises(Exception):
        sinks.upsert(spark, path, spark.createDataFrame([(3, ["y"])], "k int, v array<string>"), ["k"], "v")


def test_identity_ladder(spark):
    names = [
        ("parse", "x", 1.0), ("PARSE", None, 1.0), ("run", "parse", 1.0), ("go", "a.b::parse", 0.9), ("parseTree", "a", 0.8), ("treeParse", "a", 0.7), ("x", "parse.tree", 0.6),
        ("treeParser", "a", 0.5), ("unparsed", "a", 0.3), ("x", "a.unparsed", 0.2), ("other", "a", 0.0),
    ]
    df = spark.createDataFrame([(n, f, float(s)) for n, f, s in names], "name string, fqn string, want double")
    assert [r for r in df.select("name", "want", identity_score(F.col("name"), F.col("fqn"), "Parse").alias("got")).collect() if r.want != r.got] == []


def test_all_six_signals_count(spark):
    one = lambda text, row: spark.createDataFrame([row], text)
    got = history.bug_scores(
        one("file_id int, commits long, authors long, churn_position double", (1, 4, 10, 1.0)), one("file_id int, fixes long", (1, 4)), one("file_id int, max_cyclomatic long", (1, 20)),
        one("node int, instability double", (1, 1.0)), one("node int, rank_position double", (1, 1.0)),
    ).first()
    assert (got.score, got.signals) == (1.0, 6)


def test_empty_channels_take_no_weight(spark, rows):
    a = spark.createDataFrame([(1, 0)], "id int, rank int")
    assert rows(search.fuse({"x": (a, 0.4), "y": (a.limit(0), 0.6)}, "id")) == [(1, round(1 / 60, 8))]


@pytest.mark.parametrize("local", [True, False])
def test_communities_are_the_same_on_both_sides_of_the_bound(spark, rows, monkeypatch, local):
    edges = [(a, b) for k in range(4) for a in range(10 * k, 10 * k + 6) for b in range(10 * k, a)] + [(0, 10), (10, 20), (20, 30), (3, 33), (100, 101), (101, 102)]
    e = spark.createDataFrame(edges, "src long, dst long")
    monkeypatch.setattr(graph_local, "LOCAL_EDGES", 10**6 if local else 0)
    got = rows(graph_local.communities(e))
    assert got == sorted([(a, 10 * k) for k in range(4) for a in range(10 * k, 10 * k + 6)] + [(100, 100), (101, 100), (102, 100)], key=repr)
    # A wheel of weakly tied rings is loose enough to be settled again; both sides agree on it.
    loose = [(i, (i + 1) % 60) for i in range(60)] + [(200 + i, (7 * i) % 60) for i in range(40)]
    names = {bool(x): rows(graph_local.communities(spark.createDataFrame(loose, "src long, dst long"), split_size=4, split_cohesion=0.9)) for x in [local]}
    monkeypatch.setattr(graph_local, "LOCAL_EDGES", 0 if local else 10**6)
    assert names[local] == rows(graph_local.communities(spark.createDataFrame(loose, "src long, dst long"), split_size=4, split_cohesion=0.9))


def test_strong_components_of_a_deep_cycle(spark):
    n = 3000
    edges = [(i, (i + 1) % n) for i in range(n)] + [(i, n + i) for i in range(n)]
    got = graph_local.strong_components(spark.createDataFrame(edges, "src long, dst long"))
    assert got.agg(F.count("*"), F.max("size")).first() == (n, n) and graph.degrees(spark.createDataFrame(edges, "src long, dst long")).count() == 2 * n


def test_broadcasts_are_measured_with_nested_columns(spark):
    df = spark.createDataFrame([("a", [(i, i) for i in range(5000)])], "k string, rule array<struct<a:int,b:int>>")
    assert runtime.broadcast_if_small(df, 100_000)._jdf.queryExecution().logical().nodeName() != "ResolvedHint"
    assert runtime.broadcast_if_small(df, 1_000_000)._jdf.queryExecution().toString().count("broadcast")


def test_streams_attribute_the_newest_showing(spark, tmp_path):
    at = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    shape = "user string, id long, ts timestamp"
    for name, data in {"shown": [("u", 1, at(1)), ("u", 2, at(5)), ("u", 3, at(20)), ("z", 8, dt.datetime(2025, 1, 2))], "accepted": [("u", 9, at(10)), ("z", 7, dt.datetime(2025, 1, 2))]}.items():
        spark.createDataFrame(data, shape).coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(spark.createDataFrame([], shape).schema).parquet(str(tmp_path / name))
    query = spans.attributed_stream(read("shown"), read("accepted"), "user").writeStream.format("memory").queryName("attributed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.accepted_id, r.shown_id) for r in spark.table("attributed").collect() if r.user == "u"] == [(9, 2)]


def test_betweenness_is_the_same_on_both_sides_of_the_bound(spark, rows, monkeypatch):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1), (5, 6), (6, 7), (9, 1), (9, 9)], "src long, dst long")
    local = rows(graph_local.edge_betweenness(e))
    monkeypatch.setattr(graph_local, "LOCAL_EDGES", 0)
    assert rows(graph_local.edge_betweenness(e)) == local and len(local) == 9
    some = spark.createDataFrame([(1,)], "node long")
    assert dict(((a, b), x) for a, b, x in rows(graph_local.edge_betweenness(e, some)))[4, 5] == 3.0
    assert graph_local.edge_betweenness(e.limit(0)).count() == 0


def test_percentiles_over_ranges(spark):
    import numpy as np

    from codeweft.operators import telemetry

    data = {"a": [5.0, 1.0, 1.0, 9.5, 3.0], "b": [2.0], None: [4.0, 8.0]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs] + [("c", None)], "g string, x double")
    got = {r.g: (r.p50, r.p95) for r in telemetry.group_percentiles(df, "g", "x", {"p50": 0.5, "p95": 0.95}).collect()}
    assert {g: tuple(np.round(v, 9)) for g, v in got.items()} == {g: tuple(np.round(np.percentile(xs, [50, 95]), 9)) for g, xs in data.items()}
    told = {r.g: r.p50 for r in telemetry.latency(df.withColumn("e", F.lit(0)), "g", "x", F.col("e") == 1).collect()}
    assert told == {"a": 3.0, "b": 2.0, None: 6.0, "c": None}
