"""Services, endpoints, contracts, packages and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import round_half_up, url_pattern


def service_map(services: DataFrame, endpoints: DataFrame, key: str) -> DataFrame:
    """Endpoints and methods per service; services without endpoints keep a zero."""
    n = endpoints.groupBy(key).agg(F.count("*").alias("n_endpoints"), F.countDistinct(F.upper("method")).alias("n_methods"))
    return services.select(key).distinct().join(n, key, "left").na.fill(0, ["n_endpoints", "n_methods"])


def link_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Best endpoint of each client call (call_id, url, method).

    The same pattern scores 1, with 0.2 more for the same method; a call whose pattern ends in an
    endpoint's scores 0.7. Both are equi-joins: a call is also keyed by each of its path suffixes.
    Ties take the smallest endpoint.
    """
    e = endpoints.select(F.col("id").alias("endpoint_id"), url_pattern(F.col("path")).alias("_p"), F.upper("method").alias("_m"))
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    c = calls.select("call_id", F.upper("method").alias("_cm"), url_pattern(path).alias("_cp"))
    parts = F.split(F.col("_cp").substr(F.lit(2), F.length("_cp")), "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    keyed = c.select("call_id", "_cm", "_cp", F.explode(F.array_distinct(suffix)).alias("_p"))
    score = F.when(F.col("_p") == F.col("_cp"), 1.0).otherwise(0.7) + F.when(F.col("_m").eqNullSafe(F.col("_cm")), 0.2).otherwise(0.0)
    best = keyed.join(e, "_p").groupBy("call_id").agg(F.max(F.struct(score.alias("s"), (-F.col("endpoint_id")).alias("e"))).alias("b"))
    return best.select("call_id", (-F.col("b.e")).alias("endpoint_id"), F.least(F.col("b.s"), F.lit(1.0)).alias("confidence"))


def contract_drift(declared: DataFrame, implemented: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are only declared or only implemented."""
    a = declared.select(*keys).distinct().join(implemented.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("declared_only"))
    z = implemented.select(*keys).distinct().join(declared.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("implemented_only"))
    return a.unionByName(z)


def shared_topics(items: DataFrame, group: str, entity: str, weight: Column) -> DataFrame:
    """Pairs of groups weighted by the entities they share; every sharing pair is a result."""
    rows = items.where(F.col(group).isNotNull() & F.col(entity).isNotNull()).select(group, entity, weight.alias("_w")).distinct()
    a, z = rows.withColumnRenamed(group, "group_a"), rows.select(F.col(group).alias("group_b"), entity)
    return a.join(z, entity).where("group_a < group_b").groupBy("group_a", "group_b").agg(F.count("*").alias("n_shared"), round_half_up(F.sum("_w"), 3).alias("weight"))


def weighted_topics(items: DataFrame, group: str, kind: str, entity: str, weights: dict[str, float], common: dict[str, list[str]] | None = None, damp: float = 0.25) -> DataFrame:
    """Pairs of groups by what they share, each kind of entity at its weight; common entities count for a part of it."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        often = F.col(entity).isin((common or {}).get(name, []) or [""])
        weight = F.when(F.col(kind) == name, F.when(often, w * damp).otherwise(w)).otherwise(weight)
    return shared_topics(items.withColumn("_e", F.concat_ws(":", kind, entity)), group, "_e", weight)


def merge_people(rows: DataFrame, email: str, name: str) -> DataFrame:
    """(email, name, person): authors who share an address or a name, whatever the case, are one person, named by the smallest of both."""
    from codeweft.operators.components import connected_components

    clean = rows.select(email, name, F.nullif(F.lower(F.trim(email)), F.lit("")).alias("_e"), F.nullif(F.lower(F.trim(name)), F.lit("")).alias("_n")).distinct()
    ends = clean.select(F.concat(F.lit("email:"), "_e").alias("a"), F.concat(F.lit("name:"), "_n").alias("b"))
    known = connected_components(ends.where("a is not null and b is not null"), "a", "b")
    own = clean.withColumn("_k", F.coalesce(F.concat(F.lit("email:"), "_e"), F.concat(F.lit("name:"), "_n")))
    return own.join(known, F.col("_k") == F.col("node"), "left").where("_k is not null").select(email, name, F.coalesce("component", "_k").alias("person"))


def classify(items: DataFrame, key: str, text: Column, keywords: dict[str, list[str]]) -> DataFrame:
    """Domain with the most keyword hits, ties by name; items without a hit are left out."""
    terms = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    count = lambda words: F.size(F.filter(F.col("_t"), lambda t: t.isin(words)))
    hits = [F.struct(F.lit(d).alias("domain"), count(w).alias("hits")) for d, w in sorted(keywords.items())]
    rows = items.select(key, terms.alias("_t")).select(key, F.explode(F.array(*hits)).alias("h")).where("h.hits > 0")
    best = rows.groupBy(key).agg(F.min(F.struct((-F.col("h.hits")).alias("n"), F.col("h.domain").alias("domain"))).alias("b"))
    return best.select(key, F.col("b.domain").alias("domain"), (-F.col("b.n")).cast("long").alias("hits"))


def domain_tree(files: DataFrame, depth: int) -> DataFrame:
    """(domain, parent, depth, n, kinds): the folders of paths down to a depth as domains, with what is at or below each.

    ``files`` has path and kind. Files without a folder are in no domain.
    """
    parts = F.split("path", "/")
    n = F.least(F.size(parts) - 1, F.lit(depth))
    prefixes = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.select(F.explode(prefixes).alias("domain"), "kind").groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"))
    parent = F.when(F.col("domain").contains("/"), F.regexp_replace("domain", r"/[^/]*$", "")).otherwise("")
    return rows.select("domain", parent.alias("parent"), F.size(F.split("domain", "/")).cast("long").alias("depth"), "n", "kinds")


def cross_domain(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Edges between domains through a many-to-many membership, and the share of each source."""
    a = member.select(F.col("node").alias("src"), F.col("domain").alias("from_domain"))
    z = member.select(F.col("node").alias("dst"), F.col("domain").alias("to_domain"))
    n = edges.join(a, "src").join(z, "dst").where("from_domain <> to_domain").groupBy("from_domain", "to_domain").agg(F.count("*").alias("n_edges"))
    return n.withColumn("share", round_half_up(F.col("n_edges") / F.sum("n_edges").over(Window.partitionBy("from_domain")), 3))


def first_match(attempts: list[tuple[DataFrame, float]], items: DataFrame, key: str, target: str) -> DataFrame:
    """Resolve items by the first attempt that knows them: (key, target, confidence)."""
    from functools import reduce

    all_ = reduce(DataFrame.unionByName, (df.select(key, target, F.lit(c).alias("confidence")) for df, c in attempts))
    best = all_.groupBy(key).agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col(target).alias("t"))).alias("b"))
    return items.select(key).distinct().join(best, key, "left").select(key, F.col("b.t").alias(target), (-F.col("b.c")).alias("confidence"))
