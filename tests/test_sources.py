import json

from pyspark.sql import functions as F

from codeweft.operators import code
from codeweft.sources import files, sinks


def test_git_log(spark, rows, tmp_path):
    (tmp_path / "log.txt").write_text("\x01aa|1735732800|a@x|Fix the cache\n\nsrc/a.ts\nsrc/b.ts\n\x01bb|1735732801|b@x|Add | pipes\n")
    got = rows(files.git_log(spark, str(tmp_path / "log.txt")).select("commit_id", "author", "subject", "is_fix", "path"))
    assert got == [("aa", "a@x", "Fix the cache", True, "src/a.ts"), ("aa", "a@x", "Fix the cache", True, "src/b.ts"), ("bb", "b@x", "Add | pipes", False, None)]


def test_session_logs(spark, rows, tmp_path):
    line = {"type": "assistant", "sessionId": "s", "timestamp": "2025-01-01T00:00:00Z", "message": {"model": "m", "usage": {"input_tokens": 3, "output_tokens": 4}, "content": [{"type": "tool_use", "id": "c1", "name": "Read", "input": {"path": "x"}}, {"type": "text", "text": "hi"}]}}
    (tmp_path / "a.jsonl").write_text(json.dumps(line) + "\nbroken\n" + json.dumps(line | {"timestamp": "2025-01-01T01:00:00Z"}) + "\n")
    sessions, calls = files.session_logs(spark, str(tmp_path))
    assert rows(sessions.select("id", "input_tokens", "output_tokens", "lines")) == [("s", 6, 8, 2)]
    assert calls.count() == 2 and calls.first().tool_name == "Read"


def test_settings_keep_no_values(spark, rows, tmp_path):
    (tmp_path / "app.env").write_text("# c\nA=1\nexport B='true'\nURL=https://x.y\nD=\n\n")
    assert rows(files.settings(spark, str(tmp_path / "app.env"))) == [("A", "integer"), ("B", "boolean"), ("D", "empty"), ("URL", "url")]


def test_contracts_and_manifests(spark, rows, tmp_path):
    (tmp_path / "api.json").write_text(json.dumps({"paths": {"/a/{id}": {"get": {"operationId": "getA"}, "parameters": []}}}))
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"x": "^1"}, "devDependencies": {"y": "2"}}))
    assert rows(files.openapi(spark, str(tmp_path / "api.json")).select("path", "method", "operation_id")) == [("/a/{id}", "GET", "getA")]
    assert rows(files.manifests(spark, str(tmp_path / "package.json")).select("package", "version", "scope")) == [("x", "^1", "run"), ("y", "2", "dev")]


def test_source_files_and_changes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.ts").write_text("let a = 1")
    (tmp_path / "b.py").write_text("b = 1")
    seen = files.source_files(spark, str(tmp_path), "*.ts")
    assert [r.text for r in seen.collect()] == ["let a = 1"]
    assert files.changed_files(seen, files.source_files(spark, str(tmp_path))).count() == 1


def test_upsert_keeps_the_newest(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    df = lambda x: spark.createDataFrame(x, "k long, v long, x string")
    first = sinks.upsert(spark, path, df([(1, 1, "a"), (2, 1, "b")]), ["k"], "v")
    second = sinks.upsert(spark, first, df([(1, 2, "c"), (2, 0, "old")]), ["k"], "v")
    assert rows(spark.read.parquet(second)) == [(1, 2, "c"), (2, 1, "b")]


def test_exports(spark):
    e = spark.createDataFrame([("a<b", "c'd")], "src string, dst string")
    lines = [r.line for r in sinks.graphml(e.select(F.col("src").alias("node")), e).orderBy("part").collect()]
    assert lines[1] == '<node id="a&lt;b"/>' and lines[-1] == "</graph></graphml>"
    assert "c\\'d" in sinks.cypher(e).first().line
    found = spark.createDataFrame([("f.ts", 3, "todo", "smell")], "id string, line_no long, rule string, class string")
    assert json.loads(sinks.sarif(found, "id").first().line)["locations"][0]["physicalLocation"]["region"]["startLine"] == 3


def test_symbols(spark, rows):
    s = spark.createDataFrame([(1, "f::A", "m.A", "A", 10, "class", 1), (2, "g::A", "n.A", "A", 11, "class", 1), (3, "h::getUserName", "h.getUserName", "getUserName", 12, "function", 2), (4, "i::get_user_name", "i", "get_user_name", 13, "function", 2)], "id long, symbol_id string, fqn string, name string, file_id long, kind string, param_count int")
    wanted = spark.createDataFrame([("g::A",), ("m.A",), ("A",), ("none",)], "n string")
    assert rows(code.resolve_names(wanted, s, "n", homonyms=2)) == [("A", 1, 0.7, True), ("g::A", 2, 1.0, False), ("m.A", 1, 0.9, False), ("none", None, None, False)]
    assert {(r.id_a, r.id_b) for r in code.duplicate_names(s, 0.6).collect()} == {(1, 2), (3, 4)}
    text = spark.createDataFrame([(1, "a = 1\nb = 'x'\n"), (2, "c = 22\nd = 'yy' # z\n"), (3, "a(1)\nb\n")], "id long, t string")
    assert rows(code.clone_groups(text, "id", "t", 2).select("n", "first")) == [(2, 1)]
