"""Operators over directed graphs given as edge tables (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import identity_score, path_divergence, round_half_up
from codeweft.runtime import discard, materialise


def project(edges: DataFrame, owner: DataFrame, node: str = "node", to: str = "file_id") -> DataFrame:
    """Lift both ends of the edges to their owners; distinct, without self-loops and unowned ends.

    The polymorphic owner lookup is one equi-join per end instead of a join with OR.
    """
    a = owner.select(F.col(node).alias("src"), F.col(to).alias("_a"))
    b = owner.select(F.col(node).alias("dst"), F.col(to).alias("_b"))
    lifted = edges.join(a, "src").join(b, "dst").where(F.col("_a") != F.col("_b"))
    return lifted.select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()


def weighted(edges: DataFrame) -> DataFrame:
    """Number of parallel edges of each ordered pair without self-loops."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def coupling(edges: DataFrame) -> DataFrame:
    """Afferent and efferent coupling and instability of each node, with an assessment."""
    d = degrees(edges).select("node", F.col("n_in").alias("ca"), F.col("n_out").alias("ce"))
    i = F.col("ce") / (F.col("ca") + F.col("ce"))
    kind = F.when(i <= 0.3, "stable").when(i <= 0.7, "neutral").otherwise("unstable")
    return d.select("node", "ca", "ce", round_half_up(i, 3).alias("instability"), kind.alias("assessment"))


def page_rank(edges: DataFrame, *, damping: float = 0.85, iterations: int = 20, tolerance: float | None = None) -> DataFrame:
    """(node, rank) over edges with their multiplicity; the mass of sinks is spread evenly.

    Stops after ``iterations``, or when the total change falls below ``tolerance``. The number of
    nodes and the sink mass are scalars; ranks never reach the driver. A round uses the ranks
    several times, so each round's ranks are a written table, which also cuts the lineage.
    """
    edges = materialise(edges.select("src", "dst"))
    out = edges.groupBy("src").agg(F.count("*").alias("_out"))
    links = materialise(edges.join(out, "src").select("src", "dst", (1.0 / F.col("_out")).alias("share")))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    nodes = materialise(nodes.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("_out").isNull().alias("sink")))
    n, n_sinks = nodes.agg(F.count("*"), F.count_if("sink")).first()
    ranks, lost = nodes.withColumn("rank", F.lit(1.0 / max(n, 1))), n_sinks / max(n, 1)
    for i in range(iterations):
        gained = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        after = ranks.select("node", "sink", F.col("rank").alias("before")).join(gained, "node", "left")
        rank = (1 - damping) / n + damping * (F.coalesce("gain", F.lit(0.0)) + lost / n)
        before, ranks = ranks, materialise(after.select("node", "sink", rank.alias("rank"), F.abs(rank - F.col("before")).alias("change")))
        if i:
            discard(before)
        lost, change = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)), F.sum("change")).first()
        if tolerance is not None and change < tolerance:
            break
    return ranks.select("node", "rank")


def reach(edges: DataFrame, starts: DataFrame, *, max_depth: int | None = None, start: str = "node") -> DataFrame:
    """(node, depth): nodes reachable from the start nodes, which have depth 0.

    Breadth first: each level joins the frontier with the edges and drops the visited nodes.
    """
    edges = materialise(edges.select("src", "dst"))
    frontier = materialise(starts.select(F.col(start).alias("node")).where("node is not null").distinct())
    levels = [frontier.withColumn("depth", F.lit(0))]
    visited, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialise(step.join(visited, "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, levels)


def traverse_edges(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """Distinct edges met within ``max_depth`` steps from the starts."""
    inner = reach(edges, starts, max_depth=max_depth - 1).select(F.col("node").alias("src"))
    return edges.join(inner, "src", "left_semi").select("src", "dst").distinct()


def shortest_paths(edges: DataFrame, source, targets: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, depth, path): a shortest path from ``source``; ties take the smallest predecessor."""
    spark, edges = edges.sparkSession, materialise(edges.select("src", "dst"))
    kind = edges.schema["src"].dataType.simpleString()
    frontier = materialise(spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.array(F.lit(source).cast(kind)).alias("path")))
    found, visited, depth = [frontier.withColumn("depth", F.lit(0))], frontier.select("node"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("src"), "path"), "src")
        step = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("src", "path")).alias("p"))
        step = step.select("node", F.concat("p.path", F.array("node")).alias("path"))
        frontier = materialise(step.join(visited, "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("node"))
        found.append(frontier.withColumn("depth", F.lit(depth)))
    paths = reduce(DataFrame.unionByName, found).select("node", "depth", "path")
    return paths if targets is None else paths.join(targets.select("node").distinct(), "node", "left_semi")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of strongly connected components with more than one node.

    Nodes without an incoming or outgoing edge are trimmed until none is left; then every node is
    coloured by the smallest node that reaches it (fixpoint of minima), and within a colour the
    nodes that reach the colour's root backwards form its component. Repeats on the rest.
    """
    live = materialise(edges.where("src <> dst").select("src", "dst").distinct())
    parts: list[DataFrame] = []
    while True:
        while True:  # trim: keep edges whose ends have both an incoming and an outgoing edge
            both = live.select(F.col("src").alias("n")).distinct().join(live.select(F.col("dst").alias("n")).distinct(), "n")
            kept = materialise(live.join(both.withColumnRenamed("n", "src"), "src", "left_semi").join(both.withColumnRenamed("n", "dst"), "dst", "left_semi"))
            same = kept.count() == live.count()
            live = kept
            if same:
                break
        if live.isEmpty():
            break
        colour = materialise(live.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct())
        while True:
            offered = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
            after = materialise(colour.join(offered, "node", "left").select("node", F.least("colour", "c").alias("colour"), (F.col("c") < F.col("colour")).alias("changed")))
            colour, moved = after.select("node", "colour"), not after.where("changed").isEmpty()
            if not moved:
                break
        inside = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
        backward = materialise(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("colour")))
        roots = colour.where("node = colour").select("node")
        owned = reach(backward.select("src", "dst"), roots).select("node")
        part = materialise(colour.join(owned, "node", "left_semi"))
        parts.append(part)
        gone = part.select("node")
        live = materialise(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if not parts:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    labelled = reduce(DataFrame.unionByName, parts)
    sized = labelled.groupBy(F.col("colour").alias("component")).agg(F.count("*").alias("size")).where("size > 1")
    return labelled.withColumnRenamed("colour", "component").join(sized, "component").select("node", "component", "size")


def partition_quality(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(community, n_nodes, internal, external, cohesion) of any partition (node, community)."""
    e = weighted(edges).join(member.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src")
    e = e.join(member.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    ends = e.select(F.explode(F.array_distinct(F.array("cs", "cd"))).alias("community"), "weight", (F.col("cs") == F.col("cd")).alias("own"))
    sums = ends.groupBy("community").agg(F.sum(F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("internal"), F.sum(F.when(~F.col("own"), F.col("weight")).otherwise(0)).alias("external"))
    sizes = member.groupBy("community").agg(F.count("*").alias("n_nodes"))
    joined = sizes.join(sums, "community", "left").na.fill(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return joined.withColumn("cohesion", F.when(total > 0, round_half_up(F.col("internal") / total, 3)).otherwise(0.0))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each node takes its neighbours' most frequent label, ties the smallest."""
    links = materialise(symmetric(edges))
    labels = materialise(links.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct())
    for _ in range(rounds):
        votes = links.join(labels.select(F.col("node").alias("src"), "community"), "src").groupBy(F.col("dst").alias("node"), "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b"))
        labels = materialise(best.select("node", F.col("b.community").alias("community")))
    return labels


def surprising_edges(edges: DataFrame, paths: DataFrame, community: DataFrame) -> DataFrame:
    """Edges between communities scored by distance of the paths, popularity and rarity."""
    into = edges.groupBy(F.col("dst")).agg(F.count("*").alias("_in"))
    e = weighted(edges).join(into, "dst")
    for end in ("src", "dst"):
        e = e.join(community.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}")), end).join(paths.select(F.col("file_id").alias(end), F.col("path").alias(f"p_{end}")), end)
    score = (path_divergence(F.col("p_src"), F.col("p_dst")) + 1) * F.ln(F.col("_in") + 2) / (1 + F.col("weight"))
    return e.where("c_src <> c_dst").select("src", "dst", round_half_up(score, 3).alias("score"))


def layer_violations(edges: DataFrame, layer_of: Column, paths: DataFrame, forbidden: list[tuple[str, str]]) -> DataFrame:
    """Edges from a layer into one it must not use; ``layer_of`` maps ``path`` to its layer."""
    layered = paths.select("file_id", layer_of.alias("layer")).where("layer is not null")
    e = edges.join(layered.select(F.col("file_id").alias("src"), F.col("layer").alias("from_layer")), "src").join(layered.select(F.col("file_id").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    bad = reduce(lambda a, b: a | b, [(F.col("from_layer") == a) & (F.col("to_layer") == b) for a, b in forbidden], F.lit(False))
    return e.where(bad).select("src", "dst", "from_layer", "to_layer")


def extraction_candidates(edges: DataFrame, complexity: DataFrame, least_complexity: int = 5, least_callers: int = 2) -> DataFrame:
    """Complex nodes with several callers, scored by complexity times callers."""
    callers = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("callers")).where(F.col("callers") >= least_callers)
    hot = complexity.where(F.col("complexity") >= least_complexity).join(callers, "node")
    return hot.select("node", "complexity", "callers", (F.col("complexity") * F.col("callers")).alias("score"))


def co_imported(edges: DataFrame, target) -> DataFrame:
    """Files that share importers with ``target``: (node, shared, ratio of the target's importers)."""
    importers = edges.where(F.col("dst") == F.lit(target)).select("src").distinct()
    total = importers.agg(F.count("*").alias("total"))
    shared = edges.join(importers, "src", "left_semi").where(F.col("dst") != F.lit(target)).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("shared"))
    return shared.crossJoin(F.broadcast(total)).select("node", "shared", round_half_up(F.col("shared") / F.col("total"), 3).alias("ratio"))


def change_impact(edges: DataFrame, changed: DataFrame, modules: DataFrame, max_depth: int = 3) -> DataFrame:
    """Dependents of changed nodes by depth and module: (depth, module, n_files)."""
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hit = reach(reverse, changed, max_depth=max_depth).where("depth > 0")
    return hit.join(modules, "node").groupBy("depth", "module").agg(F.count("*").alias("n_files"))


def unreached(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes no entry point reaches."""
    return nodes.select("node").distinct().join(reach(edges, entries).select("node"), "node", "left_anti")


def snapshot_diff(base: DataFrame, head: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full diff of two keyed snapshots: values on both sides, the change, and its kind."""
    b, h = base.select(*keys, F.col(value).alias("before")), head.select(*keys, F.col(value).alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified").otherwise("same")
    delta = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    return b.join(h, keys, "full").select(*keys, "before", "after", delta.alias("delta"), kind.alias("change"))


def percent_position(df: DataFrame, value: str, key: str, alias: str) -> DataFrame:
    """Position of each row in ascending order over n - 1 (0.5 for a single row), ties by key.

    Ranks come from a range-partitioned sort: partition counts give the offsets, so no task sees
    all rows.
    """
    ordered = materialise(df.repartitionByRange(F.col(value).asc(), F.col(key).asc()).sortWithinPartitions(value, key).withColumn("_p", F.spark_partition_id()))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(value, key)) - 1
    placed = ordered.withColumn("_i", local).join(F.broadcast(before), "_p")
    at = F.when(F.col("_all") > 1, (F.col("_before") + F.col("_i")) / (F.col("_all") - 1)).otherwise(0.5)
    return placed.withColumn(alias, at).drop("_p", "_i", "_before", "_all")


def settle(links: DataFrame, sweeps: int) -> DataFrame:
    """(node, community): sweeps of moves that gain modularity, over symmetric links.

    ``links`` has node, other, weight, coin (a hash of the node) and part (the links of a part are a
    graph of their own). In each sweep the nodes whose coin shows this sweep's bit move, all at
    once, to the linked community of most gain, if it beats staying. It ends after three sweeps
    without a move. A community is named by its smallest node.
    """
    nodes = links.groupBy("node").agg(F.sum("weight").alias("degree"), F.first("part").alias("part"), F.first("coin").alias("coin"))
    sums = nodes.groupBy("part").agg(F.sum("degree").alias("twice"))
    of = materialise(nodes.join(sums, "part").select("node", "degree", "twice", "coin", F.col("node").alias("community"), F.lit(False).alias("moved")))
    still = 0
    for sweep in range(sweeps):
        total = of.groupBy("community").agg(F.sum("degree").alias("total"))
        far = of.select(F.col("node").alias("other"), F.col("community").alias("to"))
        linked = links.join(far, "other").groupBy("node", "to").agg(F.sum("weight").alias("linked"))
        own = of.join(total, "community").select("node", "degree", "twice", "coin", "community", F.col("total").alias("home"))
        cells = linked.join(total.withColumnRenamed("community", "to"), "to").join(own, "node")
        gain = F.col("linked") * F.col("twice") - F.col("degree") * (F.col("total") - F.when(F.col("to") == F.col("community"), F.col("degree")).otherwise(0.0))
        best = cells.withColumn("gain", gain).groupBy("node").agg(
            F.min(F.struct((-F.col("gain")).alias("loss"), "to")).alias("best"), F.max(F.when(F.col("to") == F.col("community"), F.col("gain"))).alias("stay")
        )
        stay = F.coalesce("stay", -F.col("degree") * (F.col("home") - F.col("degree")))
        moving = (-F.col("best.loss") > stay) & (F.shiftright("coin", sweep % 62).bitwiseAND(1) == 1)
        before, of = of, materialise(own.join(best, "node").select("node", "degree", "twice", "coin", F.when(moving, F.col("best.to")).otherwise(F.col("community")).alias("community"), moving.alias("moved")))
        discard(before)
        still = 0 if of.where("moved").head(1) else still + 1
        if still == 3:
            break
    least = of.groupBy("community").agg(F.min("node").alias("name"))
    return of.join(least, "community").select("node", F.col("name").alias("community"))


def project_typed(edges: DataFrame, nodes: DataFrame, *, excluded: list[str] = (), across: bool = False) -> DataFrame:
    """Distinct file edges (src, dst) out of symbol edges (src, dst, type) between different files.

    ``nodes`` has node, file_id and workspace. Types in ``excluded`` and, unless ``across``, edges
    between workspaces make none.
    """
    kept = edges.where(~F.col("type").isin(list(excluded))) if excluded else edges
    a = nodes.select(F.col("node").alias("src"), F.col("file_id").alias("_a"), F.col("workspace").alias("_wa"))
    z = nodes.select(F.col("node").alias("dst"), F.col("file_id").alias("_z"), F.col("workspace").alias("_wz"))
    both = kept.join(a, "src").join(z, "dst").where("_a <> _z")
    return (both if across else both.where(F.col("_wa").eqNullSafe(F.col("_wz")))).select(F.col("_a").alias("src"), F.col("_z").alias("dst")).distinct()


def traverse(
    edges: DataFrame, start, *, direction: str = "outgoing", types: list[str] = (), max_depth: int = 3, max_nodes: int = 100, token_budget: int | None = 4000, name_length: Column | None = None
) -> tuple[DataFrame, dict[str, bool]]:
    """Breadth-first walk from one node under limits: (node, depth, edge_type, in_degree), and what cut it short.

    ``edges`` has src, dst and type. A level is walked in the order of its discovery: by the
    parent's place, then the neighbour. A node costs a quarter of its two names' characters and
    fifty more (``name_length``: characters of ``node`` twice). in_degree counts the walked edges into a
    node. The result is bounded by ``max_nodes``, and so is what the driver sees of a level.
    """
    way = {"outgoing": ("src", "dst"), "incoming": ("dst", "src")}
    ends = [way[direction]] if direction in way else list(way.values())
    kept = edges.where(F.col("type").isin(list(types))) if types else edges
    steps = None
    for a, z in ends:
        part = kept.select(F.col(a).alias("_from"), F.col(z).alias("node"), "type")
        steps = part if steps is None else steps.unionByName(part)
    steps = materialise(steps)
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    cost = F.ceil(((F.length(F.col("node").cast("string")) * 2 if name_length is None else name_length) + 50) / 4)
    shape = f"node {kind.simpleString()}, place long, depth int, edge_type string"
    found, level, flags, used = [], [(start, 0, 0, None)], {"depth": False, "nodes": False, "budget": False}, 0
    seen = {start}
    while level:
        for row in level if token_budget is None else []:
            found.append(row)
        if token_budget is not None:
            costs = {r.node: r.c for r in spark.createDataFrame(level, shape).select("node", cost.alias("c")).collect()}
            for row in level:
                if used + costs[row[0]] > token_budget:
                    flags["budget"] = True
                    break
                used += costs[row[0]]
                found.append(row)
        if len(found) >= max_nodes:
            found, flags["nodes"] = found[:max_nodes], True
        if flags["budget"] or flags["nodes"]:
            break
        here = spark.createDataFrame([(r[0], r[1]) for r in level], f"_from {kind.simpleString()}, _place long")
        known = spark.createDataFrame([(n,) for n in seen], f"node {kind.simpleString()}")
        near = steps.join(F.broadcast(here), "_from").join(F.broadcast(known), "node", "left_anti")
        if level[0][2] >= max_depth:
            flags["depth"] = bool(near.head(1))
            break
        first = near.groupBy("node").agg(F.min(F.struct("_place", "type")).alias("b"))
        most = max_nodes - len(found)
        new = first.orderBy("b._place", "node").limit(most).select("node", F.col("b.type").alias("type")).collect()
        level = [(r.node, i, level[0][2] + 1, r.type) for i, r in enumerate(new)]
        seen.update(r[0] for r in level)
    nodes = spark.createDataFrame(found, shape)
    walked = nodes.where(F.col("depth") < max_depth).select(F.col("node").alias("_from"))
    into = steps.join(F.broadcast(walked), "_from").groupBy("node").agg(F.count("*").alias("in_degree"))
    return nodes.join(into, "node", "left").select("node", "depth", "edge_type", F.coalesce("in_degree", F.lit(0)).alias("in_degree")), flags


def impact(edges: DataFrame, changed: DataFrame, facts: DataFrame, together: DataFrame, tests: DataFrame, *, max_depth: int = 3) -> DataFrame:
    """(node, depth, coupled, tests, risk): what a change reaches against the edges, and how risky each is.

    ``facts`` has node and complexity; ``together`` (file_a, file_b, similarity) are files that
    change together; ``tests`` (node, n_tests). Files that only change together with a changed one
    are hidden dependents, at depth null. Risk is 0.4 for nearness, 0.3 for complexity over 20, 0.2 for
    changing together, 0.1 without tests.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = reach(back, changed, max_depth=max_depth).where("depth > 0")
    both = together.select(F.col("file_a").alias("_c"), F.col("file_b").alias("node"), "similarity").unionByName(together.select(F.col("file_b").alias("_c"), F.col("file_a").alias("node"), "similarity"))
    coupled = both.join(changed.select(F.col("node").alias("_c")), "_c").groupBy("node").agg(F.max("similarity").alias("coupled"))
    rows = reached.join(coupled, "node", "full").join(changed.select("node"), "node", "left_anti").join(facts.select("node", "complexity"), "node", "left").join(tests, "node", "left").na.fill(0, ["n_tests"])
    near = F.coalesce(1.0 / F.col("depth"), F.lit(0.0)) * 0.4
    hard = F.least(F.lit(1.0), F.coalesce("complexity", F.lit(0)) / 20.0) * 0.3
    risk = near + hard + F.coalesce("coupled", F.lit(0.0)) * 0.2 + F.when(F.col("n_tests") == 0, 0.1).otherwise(0.0)
    return rows.select("node", F.col("depth").cast("long").alias("depth"), F.coalesce("coupled", F.lit(0.0)).alias("coupled"), F.col("n_tests").alias("tests"), round_half_up(risk, 4).alias("risk"))


def renames(old: DataFrame, new: DataFrame, path: str, content: str) -> DataFrame:
    """(old_path, new_path): files that are gone and files that are new with a content only one file on each side has."""
    gone, came = old.join(new.select(path), path, "left_anti"), new.join(old.select(path), path, "left_anti")
    one = lambda df, name: df.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(path).alias(name), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return one(gone, "old_path").join(one(came, "new_path"), content).select("old_path", "new_path")


def edge_betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, betweenness) over distinct edges from the given sources, by joins a level of all walks at a time.

    Forward, each level holds how many shortest paths lead to a node; backward, each node gives its
    credit to the edges that lead to it.
    """
    level = materialise(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("source", "node")
    while True:
        step = level.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")), "node").groupBy("source", F.col("_to").alias("node")).agg(F.sum("paths").alias("paths"))
        level = materialise(step.join(seen, ["source", "node"], "left_anti"))
        if not level.head(1):
            break
        levels.append(level)
        seen = seen.unionByName(level.select("source", "node"))
    parts, credit = [], None
    for above, below in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        owed = below.withColumn("credit", F.lit(0.0)) if credit is None else below.join(credit, ["source", "node"], "left").na.fill(0.0, ["credit"])
        to = owed.select("source", F.col("node").alias("dst"), F.col("paths").alias("_all"), "credit")
        shared = above.withColumnRenamed("node", "src").join(edges, "src").join(to, ["source", "dst"])
        part = materialise(shared.select("source", "src", "dst", (F.col("paths") / F.col("_all") * (1 + F.col("credit"))).alias("part")))
        parts.append(part.groupBy("src", "dst").agg(F.sum("part").alias("part")))
        credit = part.groupBy("source", F.col("src").alias("node")).agg(F.sum("part").alias("credit"))
    if not parts:
        return edges.limit(0).select("src", "dst", F.lit(0.0).alias("betweenness"))
    return reduce(DataFrame.unionByName, parts).groupBy("src", "dst").agg(F.round(F.sum("part"), 6).alias("betweenness"))


def related(edges: DataFrame, files: DataFrame, target) -> DataFrame:
    """(node, score): files near one file by place (0.3), by shared importers (0.5) and by the parts of their names (0.2).

    ``files`` has node, module and parts (an array). Files that share nothing with it are left out.
    """
    own = files.where(F.col("node") == target).select(F.col("module").alias("_m"), F.col("parts").alias("_p"))
    shared = co_imported(edges, target).select("node", "ratio")
    both = F.array_union("parts", "_p")
    names = F.when(F.size(both) > 0, F.size(F.array_intersect("parts", "_p")) / F.size(both)).otherwise(0.0)
    rows = files.where(F.col("node") != target).join(shared, "node", "left").crossJoin(F.broadcast(own))
    score = F.when(F.col("module") == F.col("_m"), 0.3).otherwise(0.0) + F.coalesce("ratio", F.lit(0.0)) * 0.5 + names * 0.2
    return rows.select("node", round_half_up(score, 4).alias("score")).where("score > 0")


#: Folders that say nothing about what is in them.
_PLAIN_FOLDERS = ["src", "lib", "app", "dist", "build", "node_modules", "vendor", "index"]


def label_communities(member: DataFrame, paths: DataFrame) -> DataFrame:
    """(community, label): the most frequent telling folder of its members' paths, ties by name; ``root`` where there is none."""
    m = member.join(paths, "node")
    folders = F.filter(F.split("path", "/"), lambda p: ~p.isin(_PLAIN_FOLDERS) & ~p.contains(".") & (p != ""))
    counted = m.select("community", F.explode(folders).alias("_f")).groupBy("community", "_f").agg(F.count("*").alias("_n"))
    best = counted.groupBy("community").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_f").alias("f")))["f"].alias("label"))
    return m.select("community").distinct().join(best, "community", "left").select("community", F.coalesce("label", F.lit("root")).alias("label"))


def blast_radius(edges: DataFrame) -> DataFrame:
    """(node, blast): how many others import a node directly or through one more."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    over = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("_far")), "src").select(F.col("_far").alias("src"), "dst")
    return e.unionByName(over).where("src <> dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("blast"))


def answer(edges: DataFrame, nodes: DataFrame, question: str, *, max_depth: int = 2) -> tuple[str, DataFrame]:
    """Intent of a question in words, and the part of the graph that answers it: (node, depth).

    ``nodes`` has node and name. Each anchor is the node whose name answers it best (ties: the
    smallest). Dependents are found against the edges and have negative depths.
    """
    from codeweft.functions.questions import classify

    intent, anchors = classify(question)
    found = []
    for anchor in anchors:
        score = identity_score(F.col("name"), F.lit(None).cast("string"), anchor.strip("?!. "))
        best = nodes.select("node", score.alias("_s")).where("_s > 0").orderBy(F.col("_s").desc(), "node").first()
        if best is not None:
            found.append(best.node)
    kind = nodes.schema["node"].dataType.simpleString()
    starts = nodes.sparkSession.createDataFrame([(n,) for n in found], f"node {kind}")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    down = lambda: reach(edges, starts, max_depth=max_depth)
    up = lambda: reach(back, starts, max_depth=max_depth).select("node", (-F.col("depth")).alias("depth"))
    if intent in ("path", "between") and len(found) == 2:
        way = edges if intent == "path" else symmetric(edges)
        ends = nodes.sparkSession.createDataFrame([(found[1],)], f"node {kind}")
        steps = shortest_paths(way, found[0], ends).select(F.posexplode("path").alias("depth", "node"))
        return intent, steps.select("node", "depth")
    if intent == "dependents":
        return intent, up()
    if intent == "dependencies":
        return intent, down()
    return intent, down().unionByName(up().where("depth < 0"))


def tree(edges: DataFrame, roots: DataFrame, names: DataFrame, *, types: list[str] = (), max_depth: int = 10) -> DataFrame:
    """(root, node, depth, path): what hangs below the roots by edges of the given types, with the names on the way.

    A node is shown under every parent, like the components of a page; a way that comes back to a
    node of its own ends there. ``names`` has node and name.
    """
    kept = materialise((edges.where(F.col("type").isin(list(types))) if types else edges).select("src", "dst").distinct())
    level = materialise(roots.select("node").distinct().join(names, "node").select(F.col("node").alias("root"), "node", F.array("node").alias("_way"), F.col("name").alias("path")))
    levels = [level.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        step = level.join(kept.select(F.col("src").alias("node"), F.col("dst").alias("_to")), "node").where(~F.array_contains("_way", F.col("_to")))
        named = step.join(names.select(F.col("node").alias("_to"), "name"), "_to")
        level = materialise(named.select("root", F.col("_to").alias("node"), F.concat("_way", F.array("_to")).alias("_way"), F.concat_ws(" > ", "path", "name").alias("path")))
        if not level.head(1):
            break
        levels.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, levels).select("root", "node", F.col("depth").cast("long").alias("depth"), "path")
