"""Sources, sinks, code extraction and task graphs on small files."""

import datetime as dt
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from codeweft import tasks
from codeweft.functions.stems import stem
from codeweft.operators import detectors, retrieval, search, topology
from codeweft.sources import code, files, sinks


def _tree(root, texts):
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_globs_and_ignore_rules(spark, tmp_path):
    root = _tree(tmp_path, {"src/a.py": "x", "src/gen/b.py": "x", "build/c.py": "x", "docs/d.md": "x", "keep/build/e.py": "x", "big.py": "y" * 50})
    names = lambda df: {r.path.split(str(tmp_path))[1] for r in df.collect()}
    assert names(files.source_files(spark, root, include=("**/*.py",), exclude=("src/gen/**",), ignore=("/build/", "# note", "big.*"))) == {"/src/a.py", "/keep/build/e.py"}
    assert names(files.source_files(spark, root, most_bytes=10, ignore=("build", "!keep/build"))) == {"/src/a.py", "/src/gen/b.py", "/docs/d.md", "/keep/build/e.py"}
    row = files.source_files(spark, root, "a.py").first()
    assert len(row.content_hash) == 16 and row.text == "x"


def test_manifests_of_package_managers(spark, rows, tmp_path):
    root = _tree(tmp_path, {
        "package.json": json.dumps({"dependencies": {"left": "^1.0"}, "devDependencies": {"jest": "2"}}), "p/composer.json": json.dumps({"require": {"a/b": "3"}}), "requirements.txt": "Flask==2.0  # web\nnumpy\n# none\nx[extra]>=1.2",
        "go.mod": "module m\n\nrequire (\n\texample.test/lib v1.2.3\n)\n", "Cargo.toml": "[package]\nname = \"me\"\nversion = \"9\"\n[dependencies]\nserde = { version = \"1.0\" }\nrand = \"0.8\"\n[profile]\nlevel = \"3\"", "Gemfile": "gem 'rails', '~> 7.0'",
    })
    got = {tuple(r) for r in files.manifests(spark, root).select("ecosystem", "package", "version", "scope").collect()}
    assert got == {
        ("npm", "left", "^1.0", "run"), ("npm", "jest", "2", "dev"), ("composer", "a/b", "3", "run"), ("pip", "Flask", "2.0", "run"), ("pip", "numpy", "", "run"), ("pip", "x", "1.2", "run"),
        ("go", "example.test/lib", "1.2.3", "run"), ("cargo", "serde", "1.0", "run"), ("cargo", "rand", "0.8", "run"), ("gem", "rails", "7.0", "run"),
    }


def test_contracts_of_three_kinds(spark, tmp_path):
    root = _tree(tmp_path, {
        "a.json": json.dumps({"paths": {"/x": {"get": {"operationId": "readX"}}}}), "b.graphql": "type Query {\n  user(id: ID!): User # one\n  all: [User]\n}\ntype User { name: String }", "c.proto": "service Greeter {\n  rpc Hello (Req) returns (Res) {}\n  rpc Bye (Req) returns (Res);\n}\n",
    })
    got = {(r.kind, r.path, r.method) for r in files.contracts(spark, root).collect()}
    assert got == {("openapi", "/x", "GET"), ("graphql", "user", "QUERY"), ("graphql", "all", "QUERY"), ("grpc", "/Greeter/Hello", "RPC"), ("grpc", "/Greeter/Bye", "RPC")}


def test_sqlite_bundles_and_cursors(spark, rows, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as base:
        base.execute("create table t (id text, n integer)")
        base.executemany("insert into t values (?, ?)", [("a", 1), ("b", 2)])
    assert rows(files.sqlite_rows(spark, [path], "select id, n from t", "id string, n long").select("id", "n")) == [("a", 1), ("b", 2)]
    own, other = spark.createDataFrame([(1, "f")], "id int, name string"), spark.createDataFrame([(1, "g")], "id int, name string")
    assert rows(files.with_bundles(own, {"lib": other}, ("id",))) == [("1", "f", None), ("lib:1", "g", "lib")]
    log = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "at int, id string")
    first, cursor = files.after_cursor(log, "at", "id", None)
    assert first.count() == 3 and cursor == (2, "c")
    assert rows(files.after_cursor(log, "at", "id", (2, "b"))[0]) == [(2, "c")] and files.after_cursor(log, "at", "id", (9, "z"))[0].count() == 3
    assert files.reindex_plan(log, most=2).first().mode == "full" and files.reindex_plan(log.limit(0)).first().mode == "none"


CODE = {
    "app/models.py": "import os\nfrom app.base import Base\n\nclass User(Base):\n    def save(self):\n        pass\n\ndef load():\n    pass\n",
    "app/base.py": "class Base:\n    def close(self): pass\n",
    "tests/test_models.py": "from app import models\n",
    "web/a.ts": "import { b } from './lib/b'\nimport x from '../shared/x'\nexport class A extends B {\n  run(n: number): void {\n  }\n}\nexport const go = (a) => a\n",
    "web/lib/b.ts": "export class B {}\nexport type T = string\n", "shared/x.ts": "export function x() {}\n", "readme.txt": "class Nothing", "n.py": None,
}


def test_symbols_edges_and_members(spark):
    df = spark.createDataFrame(list(CODE.items()), "path string, text string")
    found = {(r.path, r.kind, r.name, r.line) for r in code.symbols(df).collect()}
    assert {("app/models.py", "class", "User", 4), ("app/models.py", "method", "save", 5), ("app/models.py", "function", "load", 8), ("web/a.ts", "class", "A", 3), ("web/a.ts", "method", "run", 4), ("web/a.ts", "function", "go", 7), ("web/lib/b.ts", "type", "T", 2)} <= found
    assert not any(p == "readme.txt" for p, *_ in found)
    edges = {(r.src, r.dst, r.type) for r in code.edges(df).collect()}
    assert edges == {("app/models.py", "app/base.py", "imports"), ("web/a.ts", "web/lib/b.ts", "imports"), ("web/a.ts", "shared/x.ts", "imports"), ("tests/test_models.py", "app/models.py", "test_covers")}
    assert {(r.member, r.owner) for r in code.member_edges(code.symbols(df)).collect()} == {("save", "User"), ("close", "Base"), ("run", "A")}
    assert {(r.src, r.dst) for r in code.heritage_edges(df).collect()} == {("app/models.py", "app/base.py"), ("web/a.ts", "web/lib/b.ts")}


def test_a_language_may_bring_its_own_parser(spark):
    code.register(code.Language("notes", (".note",), (), parse=lambda path, text: ((w, "tag", 1) for w in text.split())))
    try:
        got = {(r.name, r.kind) for r in code.symbols(spark.createDataFrame([("a.note", "x y")], "path string, text string")).collect()}
    finally:
        del code.LANGUAGES["notes"]
    assert got == {("x", "tag"), ("y", "tag")}


def test_tasks_run_once_and_are_found_again(spark, tmp_path):
    ran = []

    def make(name, df):
        ran.append(name)
        return df

    plan = [tasks.Task("a", lambda: make("a", spark.range(3))), tasks.Task("b", lambda a: make("b", a.selectExpr("id * 2 as id")), ("a",)), tasks.Task("c", lambda b: make("c", b), ("b",), keep=False), tasks.Task("z", lambda: make("z", spark.range(1)))]
    got = tasks.run(spark, plan, inputs="v1", folder=str(tmp_path), wanted=["c"])
    assert sorted(r.id for r in got["c"].collect()) == [0, 2, 4] and ran == ["a", "b", "c"]
    tasks.run(spark, plan, inputs="v1", folder=str(tmp_path), wanted=["c"])
    tasks.run(spark, plan, inputs="v2", folder=str(tmp_path), wanted=["b"])
    assert ran == ["a", "b", "c", "c", "a", "b"]
    with pytest.raises(KeyError):
        tasks.run(spark, [tasks.Task("a", lambda: None, ("nowhere",))], inputs="", folder=str(tmp_path))


def test_reports_and_snapshots(spark, rows, tmp_path):
    findings = spark.createDataFrame([("a%b.py", 3, "rule", "CWE-1"), ("b.py", 1, "todo", "note")], "path string, line_no long, rule string, class string")
    assert {r.line for r in sinks.annotations(findings, "path").collect()} == {"::error file=a%25b.py,line=3,title=rule::CWE-1", "::warning file=b.py,line=1,title=todo::note"}
    table = [r.line for r in sinks.markdown(spark.createDataFrame([("x|y", None)], "a string, b string")).orderBy("part").collect()]
    assert table == ["| a | b |", "| - | - |", "| x\\|y |  |"]
    assert json.loads(sinks.json_lines(spark.createDataFrame([(1, None)], "a int, b string")).first().line) == {"a": 1, "b": None}
    assert [r.line for r in sinks.dot(spark.createDataFrame([("a", 'b"')], "src string, dst string")).orderBy("part").collect()] == ["digraph {", '  "a" -> "b\\"";', "}"]
    folder = str(tmp_path / "s")
    for name, n in (("2025-01", 1), ("2025-02", 4)):
        sinks.capture(spark.createDataFrame([(n,)], "n long"), folder, name)
    sinks.capture(spark.createDataFrame([(6,)], "n long"), folder, "2025-02")
    assert rows(sinks.timeline(sinks.snapshots(spark, folder), ["n"])) == [("2025-01", "n", 1.0, None), ("2025-02", "n", 6.0, 5.0)]
    log = spark.createDataFrame([(dt.datetime(2025, 1, 1),), (dt.datetime(2025, 3, 1),), (None,)], "at timestamp")
    assert sinks.prune(log, "at", "2025-03-05", 30).count() == 2


def test_stems_meet_and_secrets_go(spark, rows):
    assert [stem(w) for w in ("caresses", "hopping", "relational", "generalizations", "sky", "controll", "agreed", "éa", "")] == ["caress", "hop", "relat", "gener", "sky", "control", "agre", "éa", ""]
    docs = spark.createDataFrame([(1, "Connected caches"), (2, "connection cache cached"), (3, "other"), (4, None)], "id int, t string")
    assert {r.id for r in search.stemmed_bm25(docs, "id", {"t": 1.0}, "connecting AND cache").collect()} == {1, 2}
    assert search.stemmed_bm25(docs, "id", {"t": 1.0}, "").count() == 0
    text = "a <private>x\ny</private> ghp_abcdefghijklmnopqrstu Authorization: Bearer abcdefgh12 eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM postgres://u:p@h/db"
    clean = spark.createDataFrame([(text,)], "t string").select(detectors.strip_secrets(F.col("t"))).first()[0]
    assert clean == "a  [SECRET] Authorization: Bearer [SECRET] [SECRET] postgres://u:[SECRET]@h/db"


def test_people_topics_and_retrievers(spark, rows):
    authors = spark.createDataFrame([("a@x.test", "Ann"), ("A@x.test", "ann b"), ("b@x.test", "Ann B"), ("c@x.test", None), (None, "Solo"), (None, None)], "email string, name string")
    got = {(r.email, r.name): r.person for r in topology.merge_people(authors, "email", "name").collect()}
    assert len(got) == 5 and len({got["a@x.test", "Ann"], got["A@x.test", "ann b"], got["b@x.test", "Ann B"]}) == 1 and len(set(got.values())) == 3
    items = spark.createDataFrame([(g, k, e) for g in ("p", "q") for k, e in (("package", "lodash"), ("package", "rare"), ("person", "ann"))], "g string, k string, e string")
    assert rows(topology.weighted_topics(items, "g", "k", "e", {"package": 1.0, "person": 2.0}, {"package": ["lodash"]})) == [("p", "q", 3, 3.25)]
    symbols = spark.createDataFrame([(1, "parseTree", "m.parseTree", "function", "parseTree(a)", 0.1, 0.0), (2, "treeWalk", "m.treeWalk", "function", "treeWalk(b)", 0.2, 0.0)], "id int, name string, fqn string, kind string, signature string, rank double, recency double")
    assert set(retrieval.RETRIEVERS) >= {"lexical", "near", "exact", "hybrid", "classic"} and [retrieval.lucky(q) for q in ("src/a.ts", "parseTree", "parse the tree")] == ["exact", "classic", "hybrid"]
    assert retrieval.retrieve(symbols, "parseTree").first().id == 1 and retrieval.retrieve(symbols, "m.treeWalk", "exact").first().id == 2


def test_an_index_gives_what_the_texts_give(spark, rows, tmp_path):
    docs = spark.createDataFrame([(1, "cache cache miss", "a"), (2, "Cache hit", None), (3, None, "cache"), (4, "other", "words")], "id int, t string, u string")
    search.write_index(docs, "id", {"t": 2.0, "u": 1.0}, str(tmp_path / "x"), buckets=4)
    for query in ("cache", "cache AND hit", "nothing", ""):
        assert rows(search.search_index(spark, str(tmp_path / "x"), "id", query)) == rows(search.bm25(docs, "id", {"t": 2.0, "u": 1.0}, query))


def test_questions_to_the_graph(spark, rows):
    from codeweft.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 2)], "src int, dst int")
    nodes = spark.createDataFrame([(1, "LoginForm"), (2, "AuthService"), (3, "Database"), (4, "Admin")], "node int, name string")
    ask = lambda q: (lambda r: (r[0], rows(r[1].select("node", "depth"))))(graph.answer(edges, nodes, q))
    assert ask("what depends on AuthService?") == ("dependents", [(1, -1), (2, 0), (4, -1)])
    assert ask("how does LoginForm flow to Database") == ("path", [(1, 0), (2, 1), (3, 2)])
    assert ask("what does Admin import") == ("dependencies", [(2, 1), (3, 2), (4, 0)])
    assert ask("link between LoginForm and Admin")[1] == [(1, 0), (2, 1), (4, 2)] and ask("nobody")[1] == []
    assert rows(graph.blast_radius(edges)) == [(2, 2), (3, 3)]
    assert rows(graph.label_communities(spark.createDataFrame([(1, "c"), (2, "c"), (3, "d")], "node int, community string"), spark.createDataFrame([(1, "src/auth/a.ts"), (2, "auth/x/b.ts"), (3, "a.ts")], "node int, path string"))) == [("c", "auth"), ("d", "root")]


def test_diffs_blames_and_new_logs(spark, rows, tmp_path):
    from codeweft.operators import flows, graph

    (tmp_path / "x.diff").write_text("diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +3,4 @@ def f\n+x\n@@ -9 +12 @@\n-y\ndiff --git a/b.py b/b.py\n--- a/b.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n")
    assert rows(files.diff_hunks(spark, str(tmp_path / "x.diff"))) == [("a.py", 12, 12), ("a.py", 3, 6)]
    entry = lambda sha, n, who: f"{sha * 40} {n} {n} 1\nauthor {who}\nauthor-mail <x@y.test>\nauthor-time 86400\nsummary s\nfilename a.py\n\tcode {n}\n"
    (tmp_path / "a.blame").write_text(entry("a", 1, "Ann") + entry("b", 2, "Bob B"))
    got = files.blame_lines(spark, str(tmp_path / "a.blame")).collect()
    assert [(r.line, r.author, r.commit_id[0]) for r in got] == [(1, "Ann", "a"), (2, "Bob B", "b")] and got[0].ts == dt.datetime(1970, 1, 2)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text(json.dumps({"type": "assistant", "sessionId": "s1", "timestamp": "2025-01-01T00:00:00Z"}) + "\n")
    seen = spark.createDataFrame([], "path string, modified timestamp")
    sessions, _, states = files.new_session_logs(spark, str(logs), seen)
    assert [r.id for r in sessions.collect()] == ["s1"]
    sessions, calls, states = files.new_session_logs(spark, str(logs), states)
    assert sessions.count() == 0 and calls.count() == 0 and states.count() == 0
    assert flows.uses_of("a = 1\nb = a + 1\nreturn b\ndef f():\n  print(a)") == [("a", 1, 2), ("b", 2, 3)]
    names = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "node int, name string")
    edges = spark.createDataFrame([(1, 2, "x"), (2, 1, "x"), (1, 3, "x"), (3, 2, "x"), (1, 4, "y")], "src int, dst int, type string")
    paths = [r.path for r in graph.tree(edges, names.where("node = 1"), names, types=["x"]).orderBy("path").collect()]
    assert paths == ["n1", "n1 > n2", "n1 > n3", "n1 > n3 > n2"]
    assert rows(topology.domain_tree(spark.createDataFrame([("a/b/c.ts", "ts"), ("a/d.py", "py"), ("e.py", "py")], "path string, kind string"), 2)) == [("a", "", 1, 2, 2), ("a/b", "a", 2, 1, 1)]
