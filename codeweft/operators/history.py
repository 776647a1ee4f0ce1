"""Change history: churn, hotspots, co-change, drift, prediction scores, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import clamp, round_half_up


def churn(changes: DataFrame) -> DataFrame:
    """Per file: commits, authors, first and last change, commits a week and their assessment."""
    g = changes.groupBy("file_id").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    weeks = F.greatest(F.datediff("last_seen", "first_seen") / 7.0, F.lit(1.0))
    rate = round_half_up(F.col("commits") / weeks, 2)
    kind = F.when(rate <= 1, "stable").when(rate <= 3, "active").otherwise("volatile")
    return g.select("*", rate.alias("per_week"), kind.alias("assessment"))


def hotspots(files: DataFrame, commits: DataFrame, least: int = 3) -> DataFrame:
    """Complexity times the logarithm of commits, above zero."""
    score = round_half_up(F.col("max_cyclomatic") * F.log1p("commits"), 2)
    rows = files.where(F.col("max_cyclomatic") >= least).join(commits.select("file_id", "commits"), "file_id").withColumn("score", score).where("score > 0")
    return rows.select("file_id", "score", F.when(F.col("score") <= 3, "low").when(F.col("score") <= 10, "medium").otherwise("high").alias("risk"))


def co_changes(commit_files: DataFrame, *, most_files: int = 50, least: int = 2) -> DataFrame:
    """Pairs of files changed together, file_a < file_b, with both files' own counts.

    Commits of more than ``most_files`` files say nothing about pairs and are skipped, which also
    bounds the pairs a commit can make. Confidence is P(b | a); similarity is Jaccard.
    """
    size = commit_files.groupBy("commit_id").agg(F.count("*").alias("_n")).where(F.col("_n") <= most_files)
    kept = commit_files.join(size.select("commit_id"), "commit_id", "left_semi")
    a, z = kept.withColumnRenamed("file_id", "file_a"), kept.withColumnRenamed("file_id", "file_b")
    pairs = a.join(z, "commit_id").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    own = kept.groupBy("file_id").agg(F.count("*").alias("n"))
    both = pairs.join(own.select(F.col("file_id").alias("file_a"), F.col("n").alias("n_a")), "file_a").join(own.select(F.col("file_id").alias("file_b"), F.col("n").alias("n_b")), "file_b")
    return both.select("file_a", "file_b", "together", "n_a", "n_b", round_half_up(F.col("together") / F.col("n_a"), 3).alias("confidence"), round_half_up(F.col("together") / (F.col("n_a") + F.col("n_b") - F.col("together")), 3).alias("similarity"))


def cross_module_anomalies(pairs: DataFrame, modules: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs that change together although they belong to different modules."""
    m = modules.select("file_id", "module")
    both = pairs.where(F.col("similarity") >= least).join(m.select(F.col("file_id").alias("file_a"), F.col("module").alias("module_a")), "file_a").join(m.select(F.col("file_id").alias("file_b"), F.col("module").alias("module_b")), "file_b")
    return both.where("module_a <> module_b").select("file_a", "file_b", "module_a", "module_b", "similarity")


def shotgun(commit_files: DataFrame, modules: DataFrame, least: int = 3) -> DataFrame:
    """Commits per module and the share of them that touch at least ``least`` modules."""
    touched = commit_files.join(modules, "file_id").select("commit_id", "module").distinct()
    wide = touched.groupBy("commit_id").agg((F.count("*") >= least).alias("wide"))
    g = touched.join(wide, "commit_id").groupBy("module").agg(F.count("*").alias("commits"), F.count_if("wide").alias("wide_commits"))
    return g.select("*", round_half_up(F.col("wide_commits") / F.col("commits"), 3).alias("ratio"))


def share_of_total(df: DataFrame, group: list[str], part: list[str], digits: int = 3) -> DataFrame:
    """Count per part and its share of the group's total."""
    n = df.groupBy(*group, *part).agg(F.count("*").alias("n"))
    return n.withColumn("share", round_half_up(F.col("n") / F.sum("n").over(Window.partitionBy(*group)), digits))


def weighted_score(parts: dict[str, tuple[Column, float]], digits: int = 3) -> Column:
    """Sum of bounded signals times their weights."""
    total = F.lit(0.0)
    for signal, weight in parts.values():
        total = total + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(signal, F.lit(0.0)))) * weight
    return round_half_up(total, digits)


def bug_scores(churned: DataFrame, fixes: DataFrame, files: DataFrame, coupled: DataFrame, ranks: DataFrame) -> DataFrame:
    """Score per file from churn position, fix ratio, complexity, instability, rank position and authors."""
    rows = files.select("file_id", "max_cyclomatic").join(churned.select("file_id", "commits", "authors", "churn_position"), "file_id").join(fixes, "file_id", "left").join(coupled.select(F.col("node").alias("file_id"), "instability"), "file_id", "left").join(ranks.select(F.col("node").alias("file_id"), "rank_position"), "file_id", "left")
    parts = {
        "churn": (F.col("churn_position"), 0.2),
        "fix": (F.coalesce("fixes", F.lit(0)) / F.col("commits"), 0.2),
        "complexity": (clamp(F.col("max_cyclomatic"), 20), 0.2),
        "instability": (F.col("instability"), 0.15),
        "rank": (F.col("rank_position"), 0.1),
        "authors": (clamp(F.col("authors"), 10), 0.15),
    }
    fired = sum((F.when(F.coalesce(s, F.lit(0.0)) > 0.5, 1).otherwise(0) for s, _ in parts.values()), F.lit(0))
    return rows.select("file_id", weighted_score(parts).alias("score"), fired.cast("long").alias("signals"))


def trend(points: DataFrame, key: str, at: str, value: str, k: int = 3, band: float = 0.05) -> DataFrame:
    """Mean of the last ``k`` points less that of the first ``k``, and its direction."""
    up, down = Window.partitionBy(key).orderBy(F.col(at)), Window.partitionBy(key).orderBy(F.col(at).desc())
    rows = points.withColumn("_f", F.row_number().over(up)).withColumn("_l", F.row_number().over(down))
    g = rows.groupBy(key).agg(F.count("*").alias("n_points"), F.avg(F.when(F.col("_f") <= k, F.col(value))).alias("_a"), F.avg(F.when(F.col("_l") <= k, F.col(value))).alias("_z"))
    delta = round_half_up(F.col("_z") - F.col("_a"), 4)
    return g.select(key, "n_points", delta.alias("delta"), F.when(delta > band, "rising").when(delta < -band, "falling").otherwise("steady").alias("direction"))


def sampled_evenly(points: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """At most ``n`` evenly spaced points of each key's history, the newest included."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc())
    rows = points.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    step = F.greatest(F.ceil(F.col("_n") / n), F.lit(1))
    return rows.where(F.col("_i") % step == 0).drop("_i", "_n")


def overlapping(ranges: DataFrame, hunks: DataFrame, key: str) -> DataFrame:
    """Rows of ``ranges`` (lo, hi) that overlap a hunk (from_line, to_line) of the same key."""
    met = (F.col("lo") <= F.col("to_line")) & (F.col("hi") >= F.col("from_line"))
    return ranges.join(hunks, key).where(met)


def oldest_delta(points: DataFrame, key: str, at: str, value: str, band: float = 0.1) -> DataFrame:
    """The newest value of each key less its oldest, and its direction beyond a band (ties of the time: the larger value)."""
    g = points.groupBy(key).agg(F.min(F.struct(at, value))[value].alias("_a"), F.max(F.struct(at, value))[value].alias("_z"))
    delta = round_half_up((F.col("_z") - F.col("_a")).cast("double"), 4)
    return g.select(key, delta.alias("delta"), F.when(delta > band, "rising").when(delta < -band, "falling").otherwise("steady").alias("direction"))
