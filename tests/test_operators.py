from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeweft.functions import exprs
from codeweft.operators import detectors, history, memory, search, telemetry, topology
from codeweft.streaming import spans as stream

NOW = datetime(2025, 1, 1, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rounding_is_half_up(spark):
    assert one(spark, exprs.round_half_up(F.lit(1.005), 2)) == 1.0
    assert one(spark, exprs.round_half_up(F.lit(-0.0025), 3)) == -0.002


@pytest.mark.parametrize(("path", "pattern"), [("/a/{id}/", "/a/{*}"), ("/a/:id/b", "/a/{*}/b"), ("/v2/x/12", "/v2/x/{*}"), ("/", "/")])
def test_url_patterns(spark, path, pattern):
    assert one(spark, exprs.url_pattern(F.lit(path))) == pattern


def test_scalars(spark):
    assert one(spark, exprs.segments(F.lit("getHTTPServer_fast.v2"))) == ["get", "httpserver", "fast", "v2"]
    assert one(spark, exprs.trigrams(F.lit("ab"))) == ["ab"]
    assert one(spark, exprs.path_divergence(F.lit("a/b/c.ts"), F.lit("a/x/y/c.ts"))) == 2
    assert one(spark, exprs.brace_depth(F.lit("f(){if(x){}}"))) == 2
    assert one(spark, exprs.branch_complexity(F.lit('if (a && b) { "if" } // if'))) == 3
    assert one(spark, exprs.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert one(spark, F.lit("src/a/b.test.ts").rlike(exprs.glob_to_regex("src/**/*.{test,spec}.ts")))


def test_branches_beside_long_literals(spark):
    long = "\\" + "\n" + "it's a " * 40_000
    texts = ["if '" + "x" * 300_000 + "' while", 'if "' + '\\" if ' * 100_000 + '" while', "if 'open if " + "x" * 300_000, "if '" + long + "if", 'if "a\\\rif"']
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.n for r in df.orderBy("i").select(exprs.branch_complexity(F.col("t")).alias("n")).collect()] == [3, 3, 3, 3, 2]


def test_big_commits_make_no_pairs(spark, rows):
    df = spark.createDataFrame([(1, i) for i in range(51)] + [(c, i) for c in (2, 3) for i in (1, 2, 3)], "commit_id long, file_id long")
    assert [r[:3] for r in rows(history.co_changes(df))] == [(1, 2, 2), (1, 3, 2), (2, 3, 2)]


def test_percentiles(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    assert df.agg(telemetry.nearest_rank("v", 0.95)).first()[0] == 10
    assert df.agg(telemetry.interpolated("v", 0.95)).first()[0] == pytest.approx(9.55)


def test_fusion(spark, rows):
    a = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank int")
    b = spark.createDataFrame([("b", 0), ("c", 1)], "id string, rank int")
    scores = dict(rows(search.fuse({"x": (a, 0.5), "y": (b, 0.5)}, "id")))
    assert max(scores, key=scores.get) == "b" and scores["b"] == pytest.approx(0.5 / 61 + 0.5 / 60, abs=1e-8)


def test_budget_passes_over_what_does_not_fit(spark, rows):
    df = spark.createDataFrame([("g", 1, 6), ("g", 2, 5), ("g", 3, 4)], "g string, i long, n long")
    assert rows(search.greedy_budget(df, "g", [F.col("i")], "n", 10)) == [("g", 1, 6), ("g", 3, 4)]


def test_attribution_consumes_showings(spark, rows):
    at = lambda s: NOW + timedelta(seconds=s)
    shown = spark.createDataFrame([("r", at(0), 1), ("r", at(90), 2)], "repo string, ts timestamp, id long")
    accepted = spark.createDataFrame([("r", at(150), 10), ("r", at(151), 11), ("q", at(0), 12)], "repo string, ts timestamp, id long")
    assert rows(telemetry.attribute(shown, accepted, "repo")) == [(10, 2)]
    assert rows(telemetry.nearest_before(shown, accepted, "repo")) == [(10, 2), (11, 2)]


def test_supersession(spark, rows):
    df = spark.createDataFrame([(1, "k", NOW), (2, "k", NOW + timedelta(1)), (3, None, NOW)], "id long, k string, at timestamp")
    assert rows(memory.supersede(df, ["k"], "at", "id").select("id", "valid_until")) == [(1, NOW + timedelta(1)), (2, None), (3, None)]


def test_links_prefer_the_whole_path(spark, rows):
    endpoints = spark.createDataFrame([(1, "GET", "/a/{id}"), (2, "POST", "/a/:x"), (3, "GET", "/b")], "id long, method string, path string")
    calls = spark.createDataFrame([("x", "http://h/a/5?q=1", "post"), ("y", "/v1/b", "GET"), ("z", "/none", "GET")], "call_id string, url string, method string")
    assert rows(topology.link_calls(calls, endpoints)) == [("x", 2, 1.0), ("y", 3, pytest.approx(0.9))]


def test_scan_and_secrets(spark, rows):
    df = spark.createDataFrame([(1, "ok\nmd5(x) # TODO"), (2, "fine"), (3, None)], "id long, t string")
    assert rows(detectors.scan_lines(df, "id", F.col("t")).select("id", "line_no", "rule")) == [(1, 2, "todo"), (1, 2, "weak_hash")]
    assert one(spark, detectors.strip_secrets(F.lit("postgres://u:pw@h/db"))) == "postgres://u:[SECRET]@h/db"


def test_stream_agrees_with_batch_on_closed_hours(spark, tmp_path):
    data = [(i, f"s{i % 2}", NOW + timedelta(minutes=7 * i), float(i), 1 + i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "span_id long, service string, ts timestamp, duration double, status int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream.read_stream(spark, str(tmp_path / "in"), df.schema)
    query = stream.hourly_stream(stream.unique_spans(source, ["span_id"], late="10 minutes"), "service", late=None).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    got = {(r.service, r.hour): (r.calls, r.errors) for r in spark.table("hours").collect()}
    batch = {(r.service, r.hour): (r.calls, r.errors) for r in telemetry.hourly(df, "service").collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(got) >= len(batch) - 6


def test_otlp_payload(spark):
    body = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"api"}}]},"scopeSpans":[{"spans":[{"traceId":"t","spanId":"1","name":"op","startTimeUnixNano":"1735732800000000999","endTimeUnixNano":"1735732800001500000"}]}]}]}'
    row = stream.otlp_spans(spark.createDataFrame([(body,), ("broken",)], "body string")).collect()
    assert [(r.service, r.ts, r.duration_us, r.status) for r in row] == [("api", datetime(2025, 1, 1, 12), 1499, 0)]
