"""Traces, tool calls and sessions: hourly aggregates, percentiles, call trees, attribution."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.exprs import round_half_up
from codeweft.runtime import materialise


def nearest_rank(value: str, share: float) -> Column:
    """Exact nearest-rank percentile; each group's values are counted, not listed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def interpolated(value: str, share: float) -> Column:
    """Exact interpolated percentile as an aggregate, for groups whose distinct values one task may hold."""
    return F.expr(f"percentile({value}, {share}D)")


def group_percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group, interpolated between neighbours: (``group``, a column for each share).

    Equal values are counted first; the counted values are sorted by ranges, and sums over the
    ranges before tell each value's ranks, so a hot group is spread over tasks. Nulls do not count.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = materialise(counted.repartitionByRange("_g", "_v").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_g", "_p").agg(F.sum("_n").alias("_size"))
    of_group = Window.partitionBy("_g")
    sizes = sizes.select(F.col("_g").alias("_of"), F.col("_p").alias("_at"), (F.sum("_size").over(of_group.orderBy("_p")) - F.col("_size")).alias("_before"), F.sum("_size").over(of_group).alias("_all"))
    local = F.sum("_n").over(Window.partitionBy("_p", "_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_local", local).join(sizes, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("_p") == F.col("_at")))
    end = F.col("_before") + F.col("_local")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= end - F.col("_n")) & (rank < end), F.col("_v")))

    picked = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * share
        picked += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    mixed = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares]
    return placed.groupBy("_g").agg(*picked).select(F.col("_g").alias(group), *mixed)


def hourly(spans: DataFrame, group: str, ts: str = "ts") -> DataFrame:
    """Whole-hour aggregates: calls, errors, total, least, most and nearest-rank percentiles."""
    p = [nearest_rank("duration", s).alias(n) for n, s in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    hour = F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd'T'HH").alias("hour")
    return spans.groupBy(group, hour).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == 2).alias("errors"), round_half_up(F.sum("duration"), 2).alias("total"), F.min("duration").alias("least"), F.max("duration").alias("most"), *p)


def profile(hours: DataFrame, group: str) -> DataFrame:
    """Totals of the hours; percentiles as averages weighted by calls, and so named."""
    w = lambda p: round_half_up(F.sum(F.col(p) * F.col("calls")) / F.sum("calls"), 3).alias(f"{p}_wavg")
    return hours.groupBy(group).agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), w("p50"), w("p95"), w("p99"))


def latency(calls: DataFrame, tool: str, value: str, error: Column) -> DataFrame:
    """Calls, errors, error rate, interpolated median and p95, and the most, per tool."""
    g = calls.groupBy(tool).agg(F.count("*").alias("calls"), F.count_if(error).alias("errors"), round_half_up(F.count_if(error) / F.count("*"), 4).alias("error_rate"), F.max(value).alias("most"))
    p = group_percentiles(calls, tool, value, {"p50": 0.5, "p95": 0.95}).withColumnRenamed(tool, "_of")
    return g.join(p, F.col(tool).eqNullSafe(F.col("_of")), "left").select(tool, "calls", "errors", "error_rate", round_half_up(F.col("p50"), 4).alias("p50"), round_half_up(F.col("p95"), 4).alias("p95"), "most")


def dependencies(spans: DataFrame) -> DataFrame:
    """Calls between the services of parent and child spans."""
    parent = spans.select(F.col("span_id").alias("parent_id"), "trace_id", F.col("service").alias("caller"))
    child = spans.where("parent_id is not null").select("parent_id", "trace_id", F.col("service").alias("callee"), "duration")
    return child.join(parent, ["trace_id", "parent_id"]).groupBy("caller", "callee").agg(F.count("*").alias("calls"), round_half_up(F.avg("duration"), 4).alias("mean"))


def attribute(shown: DataFrame, accepted: DataFrame, group: str, window_seconds: int = 120) -> DataFrame:
    """Each acceptance credits the newest earlier showing of its group that is still uncredited.

    Acceptances consume showings, so a group is an ordered fold. A group is cut into runs without
    a pause longer than the window, which cannot affect each other, so no fold holds a whole group.
    """
    events = shown.select(group, "ts", F.col("id").alias("_id"), F.lit(0).alias("_kind")).unionByName(accepted.select(group, "ts", F.col("id").alias("_id"), F.lit(1).alias("_kind")))
    order = Window.partitionBy(group).orderBy("ts", "_kind", "_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp")) > window_seconds * 1_000_000
    runs = events.withColumn("_run", F.sum(F.when(gap, 1).otherwise(0)).over(order))

    def credit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, waiting = None, []
        for pdf in batches:
            rows = []
            for g, r, at, kind, key in zip(pdf["_g"], pdf["_run"], pdf["ts"], pdf["_kind"], pdf["_id"], strict=True):
                if (g, r) != run:
                    run, waiting = (g, r), []
                if kind == 0:
                    waiting.append((at, key))
                elif waiting and (at - waiting[-1][0]).total_seconds() <= window_seconds:
                    rows.append((key, waiting.pop()[1]))
            yield pd.DataFrame(rows, columns=["accepted_id", "shown_id"])

    ordered = runs.select(F.col(group).cast("string").alias("_g"), "_run", "ts", "_kind", "_id").repartition("_g", "_run").sortWithinPartitions("_g", "_run", "ts", "_kind", "_id")
    return ordered.mapInPandas(credit, "accepted_id long, shown_id long")


def nearest_before(shown: DataFrame, accepted: DataFrame, group: str, window_seconds: int = 120) -> DataFrame:
    """The newest showing at most the window before each acceptance, whether credited or not.

    An as-of join by one sort: the last showing so far is carried along the ordered union.
    """
    s = shown.select(group, "ts", F.col("id").alias("_shown"), F.lit(None).cast("long").alias("_accepted"))
    a = accepted.select(group, "ts", F.lit(None).cast("long").alias("_shown"), F.col("id").alias("_accepted"))
    order = Window.partitionBy(group).orderBy("ts", F.col("_accepted").isNotNull(), "_shown").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_shown").isNotNull(), F.struct("_shown", F.col("ts").alias("_at"))), ignorenulls=True).over(order)
    rows = s.unionByName(a).withColumn("_last", last).where("_accepted is not null and _last is not null")
    near = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_last._at").cast("timestamp")) <= window_seconds * 1_000_000
    return rows.where(near).select(F.col("_accepted").alias("accepted_id"), F.col("_last._shown").alias("shown_id"))


def repeated(calls: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups of at least ``least`` equal calls."""
    return calls.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def cohorts(calls: DataFrame, session: str, flag: Column, tokens: str) -> DataFrame:
    """Sessions with and without a flagged call: how many, mean tokens, mean calls."""
    per = calls.groupBy(session).agg(F.max(flag.cast("int")).alias("flagged"), F.sum(tokens).alias("tokens"), F.count("*").alias("calls"))
    return per.groupBy("flagged").agg(F.count("*").alias("sessions"), round_half_up(F.avg("tokens"), 2).alias("mean_tokens"), round_half_up(F.avg("calls"), 2).alias("mean_calls"))


def prune_oldest(rows: DataFrame, ts: str, key: str, limit: int, keep: float = 0.9) -> DataFrame:
    """When a log exceeds ``limit`` rows, its newest ``keep`` share of the limit."""
    n = rows.count()
    return rows if n <= limit else rows.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(int(limit * keep))


def tune_weights(stats: DataFrame, channel: str, shown: str, accepted: str, *, alpha: float = 0.5, least: float = 0.05) -> DataFrame:
    """Channel weights from smoothed acceptance rates, floored and normalised to one."""
    rate = (F.col(accepted) + alpha) / (F.col(shown) + 2 * alpha)
    raw = F.greatest(rate / F.sum(rate).over(Window.partitionBy()), F.lit(least))
    return stats.select(channel, raw.alias("_w")).select(channel, round_half_up(F.col("_w") / F.sum("_w").over(Window.partitionBy()), 6).alias("weight"))


def fit_confidence(samples: pd.DataFrame, features: list[str], label: str, *, rounds: int = 200, rate: float = 0.1, ridge: float = 0.01) -> dict[str, float]:
    """Weights of a small logistic regression by full-batch descent; needs 25 rows of both labels."""
    import numpy as np

    y = samples[label].to_numpy(float)
    if len(y) < 25 or y.min() == y.max():
        return {}
    x = np.column_stack([np.ones(len(y)), samples[features].to_numpy(float)])
    w = np.zeros(x.shape[1])
    penalty = np.r_[0.0, np.full(len(features), ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ (p - y) / len(y) + penalty * w)
    return dict(zip(["bias", *features], np.clip(w, -1, 1.5).tolist(), strict=True))


def call_tree(spans: DataFrame, roots: DataFrame, depth: int = 3, most_children: int | None = None) -> DataFrame:
    """Spans below the roots by depth, following parent links level by level.

    With ``most_children`` only that many children of a span are followed, those that took longest
    (ties: the smaller id).
    """
    from functools import reduce

    level = roots.select("span_id", F.col("span_id").alias("root"), F.lit(0).alias("depth"))
    levels = [level]
    children = spans.where("parent_id is not null")
    if most_children is not None:
        longest = Window.partitionBy("parent_id").orderBy(F.col("duration").desc_nulls_last(), "span_id")
        children = children.withColumn("_n", F.row_number().over(longest)).where(F.col("_n") <= most_children)
    children = children.select("span_id", "parent_id")
    for d in range(1, depth + 1):
        level = children.join(level.select(F.col("span_id").alias("parent_id"), "root"), "parent_id").select("span_id", "root", F.lit(d).alias("depth"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


