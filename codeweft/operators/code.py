"""Operators over symbols: name resolution, hierarchies, dead code, duplicates, debt and risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import clamp, jaccard, round_half_up, segments, trigrams
from codeweft.operators.graph import reach
from codeweft.operators.history import weighted_score
from codeweft.runtime import materialise


def resolve_names(wanted: DataFrame, symbols: DataFrame, name: str, homonyms: int = 10) -> DataFrame:
    """(name, id, confidence, weak): by symbol id 1, qualified name 0.9, plain name 0.7; smallest id first.

    A plain name that ``homonyms`` or more symbols share is weak.
    """
    asked = wanted.select(F.col(name).alias("_n")).distinct()
    keys = F.explode(F.array(F.struct(F.lit(1.0).alias("c"), F.col("symbol_id").alias("k")), F.struct(F.lit(0.9).alias("c"), F.col("fqn").alias("k")), F.struct(F.lit(0.7).alias("c"), F.col("name").alias("k"))))
    known = symbols.select("id", keys.alias("x")).select("id", "x.c", F.col("x.k").alias("_n")).where("_n is not null")
    found = asked.join(known, "_n").groupBy("_n").agg(F.min(F.struct((-F.col("c")).alias("c"), "id")).alias("b"), F.count_if(F.col("c") == 0.7).alias("same"))
    weak = (F.col("b.c") == -0.7) & (F.col("same") >= homonyms)
    return asked.join(found, "_n", "left").select(F.col("_n").alias(name), F.col("b.id").alias("id"), (-F.col("b.c")).alias("confidence"), F.coalesce(weak, F.lit(False)).alias("weak"))


def ancestors(parents: DataFrame, start: DataFrame, max_depth: int = 20) -> DataFrame:
    """Symbols above the start symbols through parent links; cycles end."""
    return reach(parents.select(F.col("id").alias("src"), F.col("parent_id").alias("dst")), start, max_depth=max_depth)


def descendants(parents: DataFrame, start: DataFrame, max_depth: int = 20) -> DataFrame:
    return reach(parents.select(F.col("parent_id").alias("src"), F.col("id").alias("dst")), start, max_depth=max_depth)


def call_graph(calls: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """Callers (negative depth) and callees (positive depth) around the start nodes."""
    down = reach(calls, start, max_depth=depth)
    up = reach(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, max_depth=depth).where("depth > 0")
    return down.unionByName(up.select("node", (-F.col("depth")).alias("depth")))


def dead_code(symbols: DataFrame, signals: dict[str, DataFrame], least: float = 0.5) -> DataFrame:
    """Symbols by the share of use signals (tables of used ids) that do not know them.

    ``referenced`` is mandatory where it is given: a referenced symbol is never dead.
    """
    rows = symbols.select("id").distinct()
    for name, used in signals.items():
        rows = rows.join(used.select("id", F.lit(1).alias(name)).distinct(), "id", "left")
    if "referenced" in signals:
        rows = rows.where("referenced is null")
    fired = reduce(lambda a, b: a + b, (F.col(n).isNull().cast("int") for n in signals))
    return rows.select("id", round_half_up(fired / len(signals), 3).alias("confidence")).where(F.col("confidence") >= least)


def untested_levels(exported: DataFrame, reached: DataFrame, named: DataFrame) -> DataFrame:
    """(id, level) of exported symbols (id, file, name) without a test of their own.

    ``reached`` lists files and ``named`` names that tests know: a symbol of another file is
    ``unreached``, one of a known file that no test names is ``imported_not_called``.
    """
    rows = exported.join(reached.select("file", F.lit(1).alias("_r")).distinct(), "file", "left").join(named.select("name", F.lit(1).alias("_n")).distinct(), "name", "left")
    level = F.when(F.col("_r").isNull(), "unreached").when(F.col("_n").isNull(), "imported_not_called")
    return rows.select("id", level.alias("level")).where("level is not null")


def duplicate_names(symbols: DataFrame, least: float = 0.6) -> DataFrame:
    """All pairs of symbols of different files whose names are near: trigrams, kind, parameters, parts.

    No all-pairs comparison takes place, yet every pair with a score of ``least`` is met. Pairs
    that share two parts, or have the same sole part, meet by these. Parts of all others add at
    most 0.15 / max(2, number of parts), so ``least`` bounds their trigram similarity from below,
    by whether kind and parameters agree: they meet by a trigram of their prefixes, that is of
    the rarest trigrams, as many as cannot all be missed at that similarity.
    """
    low = float(least) - 0.00005 - 1e-9  # scores are rounded to four digits
    rows = symbols.where("name is not null").select("id", "file_id", "name", "kind", "param_count", F.array_sort(F.array_distinct(segments(F.col("name")))).alias("_p"), trigrams(F.col("name")).alias("_g"))
    grams = rows.select("name", "_g").dropDuplicates(["name"]).select("name", F.explode("_g").alias("_t"))
    order = grams.join(grams.groupBy("_t").agg(F.count("*").alias("_n")), "_t").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("_n", F.xxhash64("_t").alias("_h")))).alias("_o"))
    rows = materialise(rows.drop("_g").join(order.select("name", F.col("_o._h").alias("_t")), "name"))
    base = ["id", "file_id", "name", "kind", "param_count", "_p", "_t"]
    n_parts, n_grams = F.size("_p"), F.size("_t")

    def near(a: Column, b: Column) -> Column:
        return jaccard(a, b) * 0.45 + F.when(F.col("kind_a").eqNullSafe(F.col("kind_b")), 0.15).otherwise(0.0) + F.when(F.col("param_count_a").eqNullSafe(F.col("param_count_b")), 0.25).otherwise(0.0) + jaccard(F.col("_p_a"), F.col("_p_b")) * 0.15

    def met(keyed: DataFrame, also: Column) -> DataFrame:
        a, b = (keyed.select("_k", *[F.col(c).alias(f"{c}_{side}") for c in keyed.columns if c != "_k"]) for side in "ab")
        pairs = a.join(b, "_k").where("id_a < id_b and file_id_a <> file_id_b").where(also)
        return pairs.where(near(F.col("_t_a"), F.col("_t_b")) >= low).select("id_a", "id_b", "name_a", "name_b", "kind_a", "kind_b", "param_count_a", "param_count_b", "_p_a", "_p_b")

    two = F.when(n_parts >= 2, F.flatten(F.transform("_p", lambda x, i: F.transform(F.slice(F.col("_p"), i + 2, n_parts), lambda y: F.concat_ws("|", x, y))))).when(n_parts == 1, F.col("_p")).otherwise(F.array(F.lit("")))
    out = met(rows.select(*base, F.explode(F.array_distinct(two)).alias("_k")), F.lit(True))
    for i, (given, same) in enumerate([(0.4, ["kind", "param_count"]), (0.25, ["param_count"]), (0.15, ["kind"]), (0.0, [])]):
        need = low - given
        if need > 0.45 + 0.075:
            continue
        share = (F.lit(need) - F.lit(0.15) / F.greatest(n_parts, F.lit(2))) / 0.45
        prefix = F.slice("_t", 1, F.greatest(n_grams - F.ceil(share * n_grams - 1e-9).cast("int") + 1, F.lit(0)))
        held = rows.select(*base, share.alias("_s"), n_grams.alias("_c"), prefix.alias("_x")).where(F.col("_s") <= 1 + 1e-9)
        if need <= 0.075:  # pairs without a common trigram: by one part, or all of them
            keys = F.concat(F.col("_t"), F.transform("_p", lambda x: F.xxhash64(x)), F.array(F.lit(0).cast("bigint")) if need <= 0 else F.array().cast("array<bigint>"))
            keyed, possible = held.select(*base, F.explode(keys).alias("_v")), F.lit(True)
        else:
            keyed = held.select(*base, "_s", "_c", F.posexplode("_x").alias("_i", "_v"))
            most = F.least(F.col("_c_a") - F.col("_i_a"), F.col("_c_b") - F.col("_i_b"))
            bound = F.greatest("_s_a", "_s_b") - 1e-9
            possible = most * (bound + 1) >= bound * (F.col("_c_a") + F.col("_c_b"))
        out = out.unionByName(met(keyed.withColumn("_k", F.xxhash64(F.lit(i), *same, "_v")).drop("_v"), possible))
    score = near(trigrams(F.col("name_a")), trigrams(F.col("name_b")))
    return out.dropDuplicates(["id_a", "id_b"]).select("id_a", "id_b", round_half_up(score, 4).alias("score")).where(F.col("score") >= least)


def clone_groups(texts: DataFrame, key: str, text: str, least_lines: int = 10) -> DataFrame:
    """Texts that are equal once names, numbers, strings and comments are blanked: (hash, n, first)."""
    bare = F.regexp_replace(F.col(text), r"(//[^\n]*|#[^\n]*)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\"[^\"\n]*\"|'[^'\n]*'", "S"), r"[\p{L}_][\p{L}\p{N}_]*", "N")
    shape = F.regexp_replace(F.regexp_replace(bare, r"\p{N}+", "0"), r"\s+", " ")
    rows = texts.where(F.size(F.split(F.col(text), "\n")) >= least_lines).select(key, F.substring(F.sha1(shape), 1, 16).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def debt(modules: DataFrame) -> DataFrame:
    """Debt per module (complexity, coupling, untested, churn in 0..1) and its grade."""
    score = weighted_score({"c": (F.col("complexity"), 0.3), "k": (F.col("coupling"), 0.25), "t": (F.col("untested"), 0.25), "h": (F.col("churn"), 0.2)})
    grade = F.when(score <= 0.2, "A").when(score <= 0.4, "B").when(score <= 0.6, "C").when(score <= 0.8, "D").otherwise("F")
    return modules.select("module", score.alias("score"), grade.alias("grade"))


def change_risk(blast: Column, complexity: Column, gap: Column, churn: Column, coupling: Column) -> Column:
    return weighted_score({"b": (clamp(blast, 50), 0.25), "x": (clamp(complexity, 20), 0.2), "g": (gap, 0.2), "h": (clamp(churn, 30), 0.2), "k": (coupling, 0.15)})


def retrieval_confidence(results: DataFrame, query: str, score: str, identity: Column, fresh: Column) -> DataFrame:
    """Confidence of each query's ranking from its first score, the gap to the second, identity and freshness."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc())
    rows = results.withColumn("_r", F.row_number().over(order)).where("_r <= 2").groupBy(query).agg(
        F.max(F.when(F.col("_r") == 1, F.col(score))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("_b"), F.max(F.when(F.col("_r") == 1, identity)).alias("_i"), F.max(F.when(F.col("_r") == 1, fresh)).alias("_f")
    )
    gap = F.when(F.col("_a") > 0, (F.col("_a") - F.coalesce("_b", F.lit(0.0))) / F.col("_a")).otherwise(0.0)
    value = weighted_score({"a": (F.col("_a"), 0.4), "g": (gap, 0.25), "i": (F.col("_i"), 0.2), "f": (F.col("_f"), 0.15)}, 4)
    return rows.select(query, value.alias("confidence"), F.when(value >= 0.7, "high").when(value >= 0.4, "medium").otherwise("low").alias("level"))
