"""Graph queries over the import graph and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.exprs import module_of, round_half_up
from codeweft.operators import graph, graph_local
from codeweft.operators.components import connected_components
from codeweft.plans import bindings as b
from codeweft.runtime import materialise
from codeweft.sources.tables import table

FORBIDDEN = [("ECONOMY", "PROMO"), ("STANDARD", "LARGE")]


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    return b.imports(spark, folder).agg(F.min("src").alias("node"))


def k1_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Links between successive lines of an order (the symbols) lifted to their parts (the files)."""
    lines = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), F.col("l_partkey").alias("file_id"))
    return graph.project(lines.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")), lines)


def k2_weighted(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("src"), "l_orderkey")
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("dst"))
    return graph.weighted(a.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst"))


def k4_traverse(spark: SparkSession, folder: str) -> DataFrame:
    return graph.traverse_edges(b.imports(spark, folder), _starts(spark, folder), 4)


def k5_bfs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.reach(b.imports(spark, folder), _starts(spark, folder), max_depth=5).select("node", F.col("depth").cast("long").alias("depth"))


def k6_shortest(spark: SparkSession, folder: str) -> DataFrame:
    edges = b.imports(spark, folder)
    source = edges.agg(F.min("src")).first()[0]
    paths = graph.shortest_paths(graph.symmetric(edges), source, max_depth=4)
    return paths.select("node", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


def k14_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    ranks = graph_local.ranks(b.imports(spark, folder), iterations=20)
    return ranks.select("node", round_half_up(F.col("rank"), 8).alias("rank"))


def k15_pagerank_converged(spark: SparkSession, folder: str) -> DataFrame:
    ranks = graph_local.ranks(b.imports(spark, folder), iterations=100, tolerance=1e-6)
    return ranks.select("node", round_half_up(F.col("rank"), 6).alias("rank"))


def k16_coupling(spark: SparkSession, folder: str) -> DataFrame:
    return graph.coupling(b.imports(spark, folder))


def k17_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Import cycles; graphs beyond one worker's bound take the distributed colouring."""
    edges = materialise(b.imports(spark, folder))
    return (graph_local.strong_components if edges.count() <= graph_local.LOCAL_EDGES else graph.strong_components)(edges)


def k18_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    return graph_local.edge_betweenness(b.imports(spark, folder))


def k19_bridges(spark: SparkSession, folder: str) -> DataFrame:
    return graph_local.bridges(b.imports(spark, folder))


def k21_communities(spark: SparkSession, folder: str) -> DataFrame:
    return graph_local.communities(b.imports(spark, folder))


def k21_label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return graph.label_propagation(b.imports(spark, folder), rounds=4)


def k23_partition_quality(spark: SparkSession, folder: str) -> DataFrame:
    member = b.code_files(spark, folder).select(F.col("file_id").alias("node"), module_of(F.col("path"), 2).alias("community"))
    return graph.partition_quality(b.imports(spark, folder), member)


def k24_surprises(spark: SparkSession, folder: str) -> DataFrame:
    files = b.code_files(spark, folder)
    member = files.select(F.col("file_id").alias("node"), module_of(F.col("path"), 1).alias("community"))
    return graph.surprising_edges(b.imports(spark, folder), files, member)


def k25_layers(spark: SparkSession, folder: str) -> DataFrame:
    return graph.layer_violations(b.imports(spark, folder), F.split("path", "/")[0], b.code_files(spark, folder), FORBIDDEN)


def k26_impact(spark: SparkSession, folder: str) -> DataFrame:
    edges = b.imports(spark, folder)
    changed = edges.agg(F.max("dst").alias("node"))
    modules = b.code_files(spark, folder).select(F.col("file_id").alias("node"), module_of(F.col("path"), 2).alias("module"))
    return graph.change_impact(edges, changed, modules).withColumn("depth", F.col("depth").cast("long"))


def k28_unreached(spark: SparkSession, folder: str) -> DataFrame:
    """Files that no entry point (a file that imports and is not imported) leads to."""
    edges = b.imports(spark, folder)
    entries = edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return graph.unreached(b.code_files(spark, folder).select(F.col("file_id").alias("node")), edges, entries)


def k30_untested_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Exported symbols whose file no tool call touches."""
    symbols = b.latest(spark, folder, "symbols", "file_id", "name", "metadata").where(F.get_json_object("metadata", "$.exported").eqNullSafe("true"))
    files = b.latest(spark, folder, "files", "path").select(F.col("id").alias("file_id"), "path")
    touched = table(spark, folder, "tool_calls").where("target_file is not null").select(F.col("target_file").alias("path")).distinct()
    return symbols.select("id", "file_id", "name").join(files.join(touched, "path", "left_anti"), "file_id").select("id", "name", "path")


def k31_api_surface(spark: SparkSession, folder: str) -> DataFrame:
    symbols = b.latest(spark, folder, "symbols", "file_id", "kind", "metadata").where(F.get_json_object("metadata", "$.exported") == "true")
    return symbols.groupBy("file_id", "kind").agg(F.count("*").alias("n_exported"))


def k32_related(spark: SparkSession, folder: str) -> DataFrame:
    edges = b.imports(spark, folder)
    target = edges.groupBy("dst").count().orderBy(F.col("count").desc(), "dst").first()["dst"]
    return graph.co_imported(edges, target)


def k33_extraction(spark: SparkSession, folder: str) -> DataFrame:
    complexity = b.code_files(spark, folder).select(F.col("file_id").alias("node"), F.col("max_cyclomatic").alias("complexity"))
    return graph.extraction_candidates(b.imports(spark, folder), complexity)


def k35_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between workspaces (nations of customers and suppliers) and their kinds."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    e = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    crossing = e.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("from_ws"), F.col("s_nationkey").alias("to_ws"))
    return crossing.agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("kinds"))


def k40_snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    files = b.commit_files(spark, folder).join(b.commits(spark, folder), "commit_id")
    half = lambda flag: files.where(F.col("is_fix") == flag).groupBy("file_id").agg(F.count("*").alias("n"))
    return graph.snapshot_diff(half(False), half(True), ["file_id"], "n")


def q7_components(spark: SparkSession, folder: str) -> DataFrame:
    return connected_components(b.imports(spark, folder), "src", "dst")


QUERIES = {f.__name__: f for f in (
    k1_projection, k2_weighted, k4_traverse, k5_bfs, k6_shortest, k14_pagerank, k15_pagerank_converged, k16_coupling, k17_cycles, k18_betweenness, k19_bridges,
    k21_communities, k21_label_propagation, k23_partition_quality, k24_surprises, k25_layers, k26_impact, k28_unreached, k30_untested_exports, k31_api_surface, k32_related, k33_extraction,
    k35_workspaces, k40_snapshot_diff, q7_components,
)}

_RANK = """, n AS (SELECT count(*) AS n FROM (SELECT src FROM im UNION SELECT dst FROM im)), od AS (SELECT src, count(*) AS o FROM im GROUP BY 1),
  nodes AS (SELECT node, od.o FROM (SELECT src AS node FROM im UNION SELECT dst FROM im) LEFT JOIN od ON od.src = node)"""


def _rank_rounds(rounds: int) -> str:
    sql, last = "", "r0"
    sql += ", r0 AS (SELECT node, o, 1.0 / (SELECT n FROM n)::DOUBLE AS rank FROM nodes)"
    for i in range(1, rounds + 1):
        sql += f""", r{i} AS MATERIALIZED (SELECT p.node, p.o, 0.15 / (SELECT n FROM n) + 0.85 * (coalesce(g.gain, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE o IS NULL) / (SELECT n FROM n)) AS rank
          FROM r{i - 1} p LEFT JOIN (SELECT im.dst, sum(q.rank / q.o) AS gain FROM im JOIN r{i - 1} q ON q.node = im.src GROUP BY 1) g ON g.dst = p.node)"""
        last = f"r{i}"
    return sql + f" SELECT node, floor(rank * 1e8 + 0.5) / 1e8 AS rank FROM {last}"


_DIVERGE = """(greatest(len(string_split(a.path, '/')), len(string_split(z.path, '/'))) - 1
  - CASE WHEN string_split(a.path, '/')[1] <> string_split(z.path, '/')[1] THEN 0 WHEN string_split(a.path, '/')[2] <> string_split(z.path, '/')[2] THEN 1 ELSE 2 END)"""
_REACH = """, hit(node, depth) AS (SELECT {start}, 0 FROM im UNION SELECT im.{to}, hit.depth + 1 FROM hit JOIN im ON im.{by} = hit.node WHERE hit.depth < {most})"""

ORACLES = {
    "k6_shortest": b.with_views("im", recursive=True) + """, u AS (SELECT src, dst FROM im UNION SELECT dst, src FROM im), s AS (SELECT min(src) AS s FROM im),
      f(node, depth, path) AS (SELECT s, 0, [s] FROM s UNION ALL SELECT node, depth, path FROM (SELECT u.dst AS node, f.depth + 1 AS depth, list_append(f.path, u.dst) AS path, row_number() OVER (PARTITION BY u.dst ORDER BY f.node) AS n
        FROM f JOIN u ON u.src = f.node WHERE f.depth < 4 AND NOT list_contains(f.path, u.dst)) WHERE n = 1)
      SELECT node, CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM f QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth) = 1""",
    "k1_projection": "SELECT DISTINCT a.l_partkey AS src, z.l_partkey AS dst FROM lineitem a JOIN lineitem z ON a.l_orderkey = z.l_orderkey AND z.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> z.l_partkey",
    "k2_weighted": "SELECT l_suppkey AS src, o_custkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey <> o_custkey GROUP BY 1, 2",
    "k4_traverse": b.with_views("im", recursive=True) + _REACH.format(start="min(src)", to="dst", by="src", most=3) + " SELECT DISTINCT im.src, im.dst FROM im JOIN hit ON hit.node = im.src",
    "k5_bfs": b.with_views("im", recursive=True) + _REACH.format(start="min(src)", to="dst", by="src", most=5) + " SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM hit GROUP BY 1",
    "k14_pagerank": b.with_views("im") + _RANK + _rank_rounds(20),
    "k16_coupling": b.with_views("im") + """, d AS (SELECT node, CAST(sum(i) AS BIGINT) AS ca, CAST(sum(o) AS BIGINT) AS ce FROM (SELECT src AS node, 0 AS i, 1 AS o FROM im UNION ALL SELECT dst, 1, 0 FROM im) GROUP BY 1)
      SELECT node, ca, ce, floor(ce::DOUBLE / (ca + ce) * 1000 + 0.5) / 1000 AS instability,
        CASE WHEN ce::DOUBLE / (ca + ce) <= 0.3 THEN 'stable' WHEN ce::DOUBLE / (ca + ce) <= 0.7 THEN 'neutral' ELSE 'unstable' END AS assessment FROM d""",
    "k17_cycles": b.with_views("im", recursive=True) + """, hit(node, root) AS (SELECT dst, src FROM im UNION SELECT im.dst, hit.root FROM hit JOIN im ON im.src = hit.node),
      s AS (SELECT a.root AS node, least(a.root, min(a.node)) AS component FROM hit a JOIN hit z ON z.root = a.node AND z.node = a.root WHERE a.node <> a.root GROUP BY a.root)
      SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM s""",
    "k23_partition_quality": b.with_views("im", "fl") + """, m AS (SELECT file_id AS node, regexp_extract(path, '^[^/]+/[^/]+') AS community FROM fl),
      e AS (SELECT ms.community AS cs, md.community AS cd FROM im JOIN m ms ON ms.node = im.src JOIN m md ON md.node = im.dst),
      t AS (SELECT community, sum(i) AS internal, sum(x) AS external FROM (SELECT cs AS community, CASE WHEN cs = cd THEN 1 ELSE 0 END AS i, CASE WHEN cs <> cd THEN 1 ELSE 0 END AS x FROM e
            UNION ALL SELECT cd, 0, 1 FROM e WHERE cs <> cd) GROUP BY 1)
      SELECT m.community, count(*) AS n_nodes, CAST(coalesce(max(internal), 0) AS BIGINT) AS internal, CAST(coalesce(max(external), 0) AS BIGINT) AS external,
        CASE WHEN coalesce(max(internal + external), 0) > 0 THEN floor(max(internal)::DOUBLE / max(internal + external) * 1000 + 0.5) / 1000 ELSE 0.0 END AS cohesion FROM m LEFT JOIN t ON t.community = m.community GROUP BY 1""",
    "k24_surprises": b.with_views("im", "fl") + f""", d AS (SELECT dst, count(*) AS n FROM im GROUP BY 1)
      SELECT im.src, im.dst, floor(({_DIVERGE} + 1) * ln(d.n + 2) / 2 * 1000 + 0.5) / 1000 AS score
      FROM im JOIN d ON d.dst = im.dst JOIN fl a ON a.file_id = im.src JOIN fl z ON z.file_id = im.dst WHERE string_split(a.path, '/')[1] <> string_split(z.path, '/')[1]""",
    "k25_layers": b.with_views("im", "fl") + """, l AS (SELECT file_id, string_split(path, '/')[1] AS layer FROM fl) SELECT im.src, im.dst, a.layer AS from_layer, z.layer AS to_layer
      FROM im JOIN l a ON a.file_id = im.src JOIN l z ON z.file_id = im.dst WHERE (a.layer, z.layer) IN (('ECONOMY', 'PROMO'), ('STANDARD', 'LARGE'))""",
    "k26_impact": b.with_views("im", "fl", recursive=True) + _REACH.format(start="max(dst)", to="src", by="dst", most=3) + """, f AS (SELECT node, min(depth) AS depth FROM hit GROUP BY 1)
      SELECT CAST(f.depth AS BIGINT) AS depth, regexp_extract(fl.path, '^[^/]+/[^/]+') AS module, count(*) AS n_files FROM f JOIN fl ON fl.file_id = f.node WHERE f.depth > 0 GROUP BY 1, 2""",
    "k28_unreached": b.with_views("im", "fl", recursive=True) + """, hit(node) AS (SELECT DISTINCT src FROM im WHERE src NOT IN (SELECT dst FROM im) UNION SELECT im.dst FROM hit JOIN im ON im.src = hit.node)
      SELECT file_id AS node FROM fl WHERE file_id NOT IN (SELECT node FROM hit)""",
    "k30_untested_exports": f"""WITH s AS {b.latest_sql('symbols', 'file_id', 'name', 'metadata')}, f AS {b.latest_sql('files', 'path')} SELECT s.id, s.name, f.path FROM s JOIN f ON f.id = s.file_id
      WHERE json_extract_string(s.metadata, '$.exported') = 'true' AND f.path NOT IN (SELECT target_file FROM tool_calls WHERE target_file IS NOT NULL)""",
    "k31_api_surface": f"""WITH s AS {b.latest_sql('symbols', 'file_id', 'kind', 'metadata')} SELECT file_id, kind, count(*) AS n_exported FROM s
      WHERE json_extract_string(metadata, '$.exported') = 'true' GROUP BY 1, 2""",
    "k32_related": b.with_views("im") + """, t AS (SELECT dst FROM im GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1), i AS (SELECT DISTINCT src FROM im WHERE dst = (SELECT dst FROM t))
      SELECT dst AS node, count(DISTINCT src) AS shared, floor(count(DISTINCT src)::DOUBLE / (SELECT count(*) FROM i) * 1000 + 0.5) / 1000 AS ratio
      FROM im WHERE src IN (SELECT src FROM i) AND dst <> (SELECT dst FROM t) GROUP BY 1""",
    "k33_extraction": b.with_views("im", "fl") + """, c AS (SELECT dst AS node, count(DISTINCT src) AS callers FROM im GROUP BY 1 HAVING count(DISTINCT src) >= 2)
      SELECT node, max_cyclomatic AS complexity, callers, max_cyclomatic * callers AS score FROM c JOIN fl ON fl.file_id = node WHERE max_cyclomatic >= 5""",
    "k35_workspaces": """SELECT c_nationkey AS from_ws, s_nationkey AS to_ws, count(*) AS n_edges, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS kinds
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2""",
    "k40_snapshot_diff": b.with_views("commits", "cf") + """, x AS (SELECT file_id, is_fix, count(*) AS n FROM cf JOIN commits USING (commit_id) GROUP BY 1, 2)
      SELECT coalesce(a.file_id, z.file_id) AS file_id, a.n AS before, z.n AS after, coalesce(z.n, 0) - coalesce(a.n, 0) AS delta,
        CASE WHEN a.n IS NULL THEN 'added' WHEN z.n IS NULL THEN 'removed' WHEN a.n <> z.n THEN 'modified' ELSE 'same' END AS change
      FROM (SELECT * FROM x WHERE NOT is_fix) a FULL JOIN (SELECT * FROM x WHERE is_fix) z ON a.file_id = z.file_id""",
    "q7_components": b.with_views("im", recursive=True) + """, u AS (SELECT src AS a, dst AS b FROM im UNION SELECT dst, src FROM im), hit(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, hit.root FROM hit JOIN u ON u.a = hit.node WHERE hit.root < u.b)
      SELECT node, min(root) AS component FROM hit GROUP BY 1""",
}
