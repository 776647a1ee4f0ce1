"""Operators over hand-made tables: questions, retrieval, hierarchies, curation, walks, schemas, flows."""

import json

import pytest
from pyspark.sql import functions as F

from codeweft.functions import questions
from codeweft.functions.exprs import param_count
from codeweft.operators import curation, flows, graph, hierarchy, memory, packages, retrieval, search


@pytest.mark.parametrize(
    ("question", "intent", "anchors"),
    [
        ("how does Login flow to Database?", "path", ["Login", "Database?"]), ("what depends on UserModel", "dependents", ["UserModel"]), ("what does Api import", "dependencies", ["Api"]),
        ("lifecycle of Session", "flow", ["Session"]), ("link between A and B", "between", ["A", "B"]), ("OrderService", "flow", ["OrderService"]), ("OrderService uses Billing", "path", ["OrderService", "Billing"]),
    ],
)
def test_intents(spark, question, intent, anchors):
    assert questions.classify(question) == (intent, anchors)
    assert spark.range(1).select(questions.intent_of(F.lit(question))).first()[0] == intent


def test_statements_and_paths(spark):
    of = lambda f, *texts: [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]
    assert of(questions.is_sql, "SELECT * FROM t", "from A to B", "group by x order by y", "trace path from A where it calls B", "delete from users") == [True, False, True, False, True]
    assert of(questions.mode_of, "src/a/b.ts", "main.py", "where is main", "a / b") == ["get", "get", "single", "single"]
    assert of(param_count, "f()", "f(a, b<c, d>, g = [1, 2])", "f(void)", "no", "f(a", "f(x,)", None) == [0, 3, 0, 0, 0, 1, 0]


def test_classic_search_falls_back_to_near_names(spark):
    rows = [(1, "parseTree", "m.parseTree", "function", 0.5, 0.0), (2, "parseTree", "n.parseTree", "variable", 0.5, 0.0), (3, "other", "m.other", "class", 1.0, 1.0), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, name string, fqn string, kind string, rank double, recency double")
    got = {r.id: (r.score, r.found_by) for r in retrieval.classic(df, "parseTree", fields={"name": 2.0, "fqn": 1.0}).collect()}
    assert set(got) == {1, 2} and got[1][0] == pytest.approx(0.4 + 0.3 + 0.075 + 0.05 * 0.7) and got[1][0] > got[2][0] and got[1][1] == "text"
    near = retrieval.classic(df, "parseTrie", fields={"name": 2.0, "fqn": 1.0}).collect()
    assert {(r.id, r.found_by) for r in near} == {(1, "near"), (2, "near")}
    assert retrieval.classic(df.limit(0), "x", fields={"name": 1.0}).count() == 0
    assert [r.id for r in retrieval.exact(df, "M.OTHER").collect()] == [3]


def test_tiers_contexts_and_completion(spark, rows):
    df = spark.createDataFrame([("a", i, float(30 - i)) for i in range(30)] + [("b", 99, 1.0)], "g string, id int, score double")
    tiers = retrieval.tiers(df, "g", "score", "id")
    assert rows(tiers.where("g = 'a'").groupBy("tier").count()) == [("high", 3), ("low", 15), ("medium", 7)] and tiers.where("id = 99").first().tier == "high"
    sized = spark.createDataFrame([(1, 5.0, 60), (2, 4.0, 50), (3, 3.0, 40), (4, 2.0, 1)], "id int, score double, n long")
    assert [r.id for r in retrieval.context(sized, "id", "score", "n", 100).collect()] == [1, 3]
    seeds, edges = spark.createDataFrame([(1, 1.0), (2, 0.2)], "id int, score double"), spark.createDataFrame([(1, 2), (3, 1)], "src int, dst int")
    assert rows(retrieval.complete(seeds, edges, "id")) == [(1, 1.0), (2, 0.5), (3, 0.5)]
    assert rows(search.seeded_sample(spark.range(50), "id", 5, seed="x")) == rows(search.seeded_sample(spark.range(50).repartition(7), "id", 5, seed="x"))


def test_overrides_up_and_down(spark, rows):
    heritage = spark.createDataFrame([("Cat", "Animal"), ("Lion", "Cat"), ("Animal", "Lion"), (None, "X")], "sub string, sup string")
    methods = spark.createDataFrame([(1, "Animal", "eat"), (2, "Lion", "eat"), (3, "Cat", "purr"), (4, "Rock", "eat"), (5, None, "eat")], "method int, class string, name string")
    above = rows(hierarchy.closure(heritage.where("sup <> 'Lion'")))
    assert above == [("Cat", "Animal", 1), ("Lion", "Animal", 2), ("Lion", "Cat", 1)]
    got = set(rows(hierarchy.overrides(methods, heritage.where("sub is not null and sup <> 'Lion'"))))
    assert {(2, 1, "ancestor_method"), (1, 2, "descendant_method"), (3, 3, "self"), (4, 4, "self")} <= got and len(got) == 6
    assert hierarchy.overrides(methods, heritage).count() == 4 + 4  # a cycle ends; each is above and below the other
    calls = spark.createDataFrame([(9, 1), (9, 7)], "src int, dst int")
    related = hierarchy.overrides(methods, heritage.where("sub is not null and sup <> 'Lion'"))
    assert rows(hierarchy.dispatched(calls, related)) == [(9, 1), (9, 2), (9, 7)]


def test_reject_reasons_and_heat(spark):
    texts = [
        ("Short", "x", "title_too_short"), ("Broken � title here", "x", "broken_encoding"), ("Заголовок решения", "x", "non_english"), ("and then we moved it", "x", "title_mid_clause"),
        ("Use `cache first", "x", "title_truncated"), ("Use the cache first", "too short", "content_too_short"), ("Use the cache first", "We do it because it is ...", "content_truncated"),
        ("Use the cache first", "We do it because it is faster.", None), (None, None, "title_too_short"),
    ]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, t string, c string, want string")
    assert [r for r in df.select("want", curation.reject_reason(F.col("t"), F.col("c")).alias("got")).collect() if r.want != r.got] == []
    days = spark.createDataFrame([("2025-12-30", None, 1.5), ("2025-01-01", "2025-12-31", 1.5), ("2025-01-01", None, 0.3), ("2025-11-20", None, 1.0), (None, None, 1.0)], "c string, h string, want double")
    factor = curation.heat_multiplier(F.col("c").cast("timestamp"), F.col("h").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))
    assert all(r.want == r.got for r in days.select("want", factor.alias("got")).collect())


def test_clusters_by_title_equal_brute_force(spark, rows):
    titles = ["Use the cache for sessions", "Use the cache for session", "use the cache for sessions", "Drop the old index", "Drop the old indexes", "Something else", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, title string")
    assert rows(curation.title_clusters(df, "id", "title", least=0.8)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)]
    assert curation.title_clusters(df.limit(0), "id", "title").count() == 0
    state = memory.replay(spark.createDataFrame([(1, 1, "add"), (1, 3, "invalidate"), (2, 1, "add")], "id int, at int, c string"), "id", "at", "c")
    assert rows(state) == [(1, "invalidate", 2), (2, "add", 1)]


def test_walks_under_limits(spark, rows):
    edges = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, 4, "a"), (3, 4, "a"), (4, 1, "a"), (4, 5, "a"), (9, 1, "a")], "src int, dst int, type string")
    nodes, flags = graph.traverse(edges, 1, max_depth=2)
    assert rows(nodes.select("node", "depth", "in_degree")) == [(1, 0, 0), (2, 1, 1), (3, 1, 1), (4, 2, 2)] and flags == {"depth": True, "nodes": False, "budget": False}
    assert rows(graph.traverse(edges, 1, types=["a"])[0].select("node")) == [(1,), (2,), (4,), (5,)]
    assert rows(graph.traverse(edges, 1, direction="incoming", max_depth=1)[0].select("node")) == [(1,), (4,), (9,)]
    few, cut = graph.traverse(edges, 1, max_nodes=2)
    assert rows(few.select("node")) == [(1,), (2,)] and cut["nodes"]
    none, cut = graph.traverse(edges, 1, token_budget=14)
    assert rows(none.select("node")) == [(1,)] and cut["budget"]


def test_hidden_dependents_take_part_in_the_impact(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2)], "src int, dst int")
    facts = spark.createDataFrame([(2, 20), (3, 0), (7, 0)], "node int, complexity int")
    together = spark.createDataFrame([(1, 7, 0.5), (1, 2, 1.0)], "file_a int, file_b int, similarity double")
    tests = spark.createDataFrame([(3, 4)], "node int, n_tests long")
    got = {r.node: (r.depth, r.coupled, r.tests, r.risk) for r in graph.impact(edges, spark.createDataFrame([(1,)], "node int"), facts, together, tests).collect()}
    assert got == {2: (1, 1.0, 0, 1.0), 3: (2, 0.0, 4, 0.2), 7: (None, 0.5, 0, 0.2)}


def test_schema_differences(spark):
    field = lambda kind, **more: {"type": kind, **more}
    old = {"properties": {"userName": field("string"), "age": field("integer"), "gone": field("object", properties={"deep": field("string")}), "box": field("object", properties={"a": field("string")}), "list": field("array", items={"properties": {"x": field("string")}})}, "required": ["age"]}
    new = {"properties": {"user_name": field("string"), "age": field("string"), "extra": field("number"), "must": field("boolean"), "box": field("object", properties={"a": field("integer")}), "list": field("array", items={"properties": {"x": field("string"), "y": field("string")}})}, "required": ["age", "must", "box"]}
    rows = spark.createDataFrame([(1, json.dumps(old), json.dumps(new)), (2, "broken", None), (3, "{}", "[]")], "id int, a string, z string")
    diff = packages.schema_diff(packages.schema_fields(rows, "id", "a"), packages.schema_fields(rows, "id", "z"), "id")
    got = {(r.change, r.path, r.breaking) for r in diff.collect()}
    assert got == {
        ("renamed", "userName", True), ("type_changed", "age", True), ("field_removed", "gone", True), ("field_added", "extra", False), ("required_added", "must", True), ("required_added", "box", True),
        ("type_changed", "box.a", True), ("field_added", "list[].y", False),
    }


def test_flows_from_sources_to_sinks(spark):
    code = "\n".join([
        "function run(req) {", "const id = req.query.id", "const safe = parseInt(req.query.n)", "const sql = 'select ' + id", "db.query(sql)", "db.query(safe)", "exec(req.body.cmd)", "}",
        "function other() {", "db.query(sql)", "}",
    ])
    assert flows.flows_of(code) == [(2, 5, "CWE-89", "sql"), (7, 7, "CWE-78", "direct")]
    df = spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "x" * 10_000)], "id int, t string")
    assert flows.taint(df, "id", "t").count() == 2 and flows.taint(df.limit(0), "id", "t").count() == 0


def test_renames_need_a_content_of_one_file_on_each_side(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("same", "3"), ("n", None)], "path string, h string")
    new = spark.createDataFrame([("x", "1"), ("y", "2"), ("same", "3"), ("m", None)], "path string, h string")
    assert rows(graph.renames(old, new, "path", "h")) == [("a", "x")]
    kept = graph.project_typed(
        spark.createDataFrame([(1, 2, "calls"), (1, 3, "calls"), (2, 1, "docs")], "src int, dst int, type string"), spark.createDataFrame([(1, 10, "w"), (2, 20, "w"), (3, 30, "v")], "node int, file_id int, workspace string"), excluded=["docs"]
    )
    assert rows(kept) == [(10, 20)]


def test_budgets_of_long_groups_equal_the_fold(spark, rows):
    sizes = [(g, i, (i * 7919 + 31 * (g or 0)) % 97 if i % 11 else 0) for g in (1, 2, None) for i in range(150)] + [(4, 0, 5000)]
    df = spark.createDataFrame(sizes, "g int, id int, n long")
    order = [F.col("n") % 7, F.col("id")]
    long, short = (f(df, "g", order, "n", 400) for f in (search.greedy_budget, search.take_within))
    assert rows(long.select("g", "id")) == rows(short.select("g", "id")) and long.where("g = 4").count() == 0
    assert rows(search.greedy_budget(df, "g", order, "n", 400, salts=1).select("g", "id")) == rows(long.select("g", "id"))
    assert search.greedy_budget(df.limit(0), "g", order, "n", 400).count() == 0
