"""Care of recorded facts: confidence, quality of mined ones, clusters, pins, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.exprs import round_half_up, trigrams
from codeweft.operators.components import connected_components
from codeweft.runtime import materialise

# Words that a clause does not begin with, and types that say much.
OPENERS = "and but or so because which that then than with of to for the a an it its is are was were".split()
TELLING_TYPES = ["architecture_decision", "bug_root_cause"]


def confidence() -> Column:
    """Confidence of a decision from what it carries: a code reference, length, tags, type, service."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    worth = lambda met, w: F.when(met, w).otherwise(0.0)
    parts = [
        worth(filled("symbol_id") | filled("file_path"), 0.2), worth(F.length(F.coalesce("content", F.lit(""))) >= 200, 0.15), worth(filled("tags"), 0.1),
        worth(F.coalesce(F.col("type").isin(TELLING_TYPES), F.lit(False)), 0.1), worth(filled("service_name"), 0.05),
    ]
    return round_half_up(F.least(sum(parts, F.lit(0.4)), F.lit(1.0)), 4)


def _unbalanced(text: Column) -> Column:
    count = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    odd = [(count("`") % 2) == 1, (count("**") / 2 % 2) == 1]
    return odd[0] | odd[1] | (count("(") != count(")")) | (count("[") != count("]")) | (count("{") != count("}"))


def reject_reason(title: Column, content: Column) -> Column:
    """Why a mined fact is none: null for a good one, else the first reason that holds.

    Reasons in order: title_too_short, broken_encoding, non_english (a letter that is not Latin),
    title_mid_clause, title_truncated, content_too_short, content_truncated.
    """
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    foreign = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", "")) > F.length(F.regexp_replace(x, r"[^\p{IsLatin}]", ""))
    words = F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    rules = [
        ("title_too_short", F.length(t) < 8),
        ("broken_encoding", t.contains("�") | c.contains("�")),
        ("non_english", foreign(t) | foreign(c)),
        ("title_mid_clause", F.regexp_extract(t, r"^([a-z]+)", 1).isin(OPENERS)),
        ("title_truncated", _unbalanced(t)),
        ("content_too_short", (F.length(c) < 16) | (words < 4)),
        ("content_truncated", c.contains("...") | c.contains("…") | _unbalanced(c)),
    ]
    reason = F.lit(None).cast("string")
    for name, met in reversed(rules):
        reason = F.when(met, name).otherwise(reason)
    return reason


def heat_multiplier(created: Column, hit: Column, now: Column, *, fresh_days: float = 7.0, stale_days: float = 90.0, boost: float = 1.5, dampen: float = 0.3) -> Column:
    """Factor of a fact's rank by its last activity: recent ones are raised, old ones lowered."""
    active = F.greatest(created, hit)
    age = (F.unix_micros(now) - F.unix_micros(active)) / 86_400_000_000
    return F.when(active.isNull(), 1.0).when(age <= fresh_days, boost).when(age > stale_days, dampen).otherwise(1.0)


def keywords(title: Column, most: int = 8) -> Column:
    """Up to ``most`` distinct words of a title in their order, without short ones and numbers."""
    words = F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$"))), 1, most)


def similar_sets(rows: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs whose sets have a Jaccard similarity of ``least`` or more.

    Two such sets share one of their rarest items, as many of each as cannot all be missed (prefix
    filter), so rows meet only by rare items. Items are told apart by 64-bit hashes, so their kinds
    should be millions at most. Equal sets should be given once.
    """
    sets = materialise(rows.where(F.size(items) > 0).select(F.col(key).alias("_k"), F.array_distinct(F.transform(items, lambda x: F.xxhash64(x))).alias("_s")))
    seen = sets.select("_k", F.size("_s").alias("_c"), F.explode("_s").alias("_x"))
    rare = seen.join(seen.groupBy("_x").agg(F.count("*").alias("_n")), "_x").groupBy("_k", "_c").agg(F.sort_array(F.collect_list(F.struct("_n", "_x"))).alias("_o"))
    prefix = F.slice("_o", 1, F.col("_c") - F.ceil(F.lit(least) * F.col("_c") - 1e-9).cast("int") + 1)
    keyed = materialise(rare.select("_k", "_c", F.posexplode(prefix).alias("_i", "_p")).select("_k", "_c", "_i", F.col("_p._x").alias("_x")))
    a, b = (keyed.select("_x", F.col("_k").alias(side), F.col("_c").alias(f"_c{side}"), F.col("_i").alias(f"_i{side}")) for side in "ab")
    # Where the first common rare item stands bounds how many can be common at all.
    most = F.least(F.col("_ca") - F.col("_ia"), F.col("_cb") - F.col("_ib"))
    fits = most * (1 + least) >= (F.col("_ca") + F.col("_cb")) * (least - 1e-9)
    pairs = a.join(b, "_x").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("_k").alias("a"), F.col("_s").alias("_sa")), "a").join(sets.select(F.col("_k").alias("b"), F.col("_s").alias("_sb")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("_n"), (F.size("_sa") + F.size("_sb")).alias("_all"))
    return common.select("a", "b", (F.col("_n") / (F.col("_all") - F.col("_n"))).alias("similarity")).where(F.col("similarity") >= least - 1e-9)


def title_clusters(facts: DataFrame, key: str, title: str, *, least: float = 0.8) -> DataFrame:
    """(key, cluster): facts whose titles are linked by trigram similarity; a cluster is named by its smallest key.

    Equal titles (whatever the case) are compared once. Null titles take no part.
    """
    rows = facts.where(F.col(title).isNotNull()).select(F.col(key).alias("_id"), F.lower(title).alias("_t"))
    first = materialise(rows.groupBy("_t").agg(F.min("_id").alias("_first")))
    pairs = similar_sets(first.select("_first", trigrams(F.col("_t")).alias("_g")), "_first", "_g", least)
    linked = connected_components(pairs, "a", "b").select(F.col("node").alias("_first"), "component")
    named = first.join(linked, "_first", "left").select("_t", F.coalesce("component", "_first").alias("cluster"))
    return rows.join(named, "_t").select(F.col("_id").alias(key), "cluster")


def pin_weights(pins: DataFrame, now: Column, *, low: float = 0.1, high: float = 3.0) -> DataFrame:
    """(path, weight): the largest weight of a file's pins that have not expired; weights outside the bounds do not count."""
    live = pins.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).where(F.col("weight").between(low, high))
    return live.groupBy("path").agg(F.max("weight").alias("weight"))


def compare_findings(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Findings against a baseline: new, fixed or the same."""
    a, z = before.select(*keys).distinct().withColumn("_a", F.lit(1)), now.select(*keys).distinct().withColumn("_z", F.lit(1))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_z").isNull(), "fixed").otherwise("same")
    return a.join(z, keys, "full").select(*keys, state.alias("state"))
