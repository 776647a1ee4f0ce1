"""Filling containers of fixed capacity by multiway differencing.

Items are spread over groups of near-equal total size by a hash of their key, those of a key with
very many items by a hash of the row; each group is packed alone. In a group, the Karmarkar-Karp method keeps partial partitions into k windows and
merges the two with the largest imbalance so that the imbalances oppose each other; k starts at
the least possible count and rises whenever a window exceeds the capacity.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.runtime import broadcast_if_small, materialise

#: Containers of a group, about: more lose less space at the group's end, but take longer.
GROUP_CONTAINERS = 512
#: Share of the total size that the smallest items hold which fill the windows' last room.
FILLER_SHARE = 0.1
#: A key (or null) with more items than this is spread over the groups.
KEY_ITEMS = 1_000


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Window of each item when ``sizes`` are split into ``k`` windows, and the fullest window's sum."""
    n = len(sizes)
    left, right = list(range(n)), [-1] * n  # a node joins two nodes; nodes under n are items
    states = [(sizes[i : i + 1], np.array([i])) for i in range(n)]
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapify(heap)
    while len(heap) > 1:
        _, i = heappop(heap)
        _, j = heappop(heap)
        (sums_a, nodes_a), (sums_b, nodes_b) = states[i], states[j]
        states[i] = states[j] = None
        both = len(sums_a) + len(sums_b) - k
        if both > 0:
            # The smallest windows of one side meet the largest of the other.
            sums = np.concatenate([sums_a[:-both], sums_a[-both:] + sums_b[-1 : -both - 1 : -1], sums_b[:-both]])
            joined = np.arange(len(left), len(left) + both)
            left.extend(nodes_a[-both:].tolist())
            right.extend(nodes_b[-1 : -both - 1 : -1].tolist())
            nodes = np.concatenate([nodes_a[:-both], joined, nodes_b[:-both]])
        else:
            sums, nodes = np.concatenate([sums_a, sums_b]), np.concatenate([nodes_a, nodes_b])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        states.append((sums, nodes))
        heappush(heap, (int(sums[-1] if len(sums) == k else 0) - int(sums[0]), len(states) - 1))
    sums, nodes = states[heap[0][1]]
    window = np.empty(n, np.int64)
    for w, top in enumerate(nodes.tolist()):
        todo = [top]
        while todo:
            node = todo.pop()
            if node < n:
                window[node] = w
            else:
                todo += (left[node], right[node])
    return window, int(sums[0])


def _windows(sizes: np.ndarray, capacity: int, k: int, large: int) -> np.ndarray | None:
    """Windows of the descending ``sizes`` when there are ``k``, or None if one overflows."""
    window = np.empty(len(sizes), np.int64)
    free = np.full(k, capacity)
    if large:
        window[:large], top = difference(sizes[:large], k)
        if top > capacity:
            return None
        free -= np.bincount(window[:large], sizes[:large], minlength=k).astype(np.int64)
    slack = sorted(zip(free.tolist(), range(k), strict=True))
    for i, size in enumerate(sizes[large:].tolist(), large):
        at = bisect_left(slack, (size, -1))
        if at == k:
            return None
        room, window[i] = slack.pop(at)
        insort(slack, (room - size, int(window[i])))
    return window


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, no window above ``capacity``; every size is at most ``capacity``.

    Differencing leaves windows level but not brimful, so the smallest items, ``FILLER_SHARE`` of
    the total, are kept back and then put into the tightest room that takes them. The window
    count starts at its lower bound and rises until everything fits.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    ranked = sizes[order]
    large = int((np.cumsum(ranked[::-1])[::-1] > FILLER_SHARE * ranked.sum()).sum())
    low = max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    step, k, best = 1, low, None
    while (best := _windows(ranked, capacity, k, large)) is None:
        low, k, step = k + 1, min(k + step, len(sizes)), step * 2
    while low < k:
        middle = (low + k) // 2
        if (found := _windows(ranked, capacity, middle, large)) is not None:
            best, k = found, middle
        else:
            low = middle + 1
    window = np.empty(len(sizes), np.int64)
    window[order] = best
    return window


def _dealt(items: DataFrame, groups: int, capacity: int, key_items: int) -> DataFrame:
    """Adds _group, and in _first how many parts of the row's key lie in groups before it."""
    items = items.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups))).withColumn("_first", F.lit(0).cast("bigint"))
    hot = materialise(items.groupBy(F.col("_key").alias("_hot")).count().where(F.col("count") > key_items).select("_hot"))
    if not hot.head(1):
        return items
    hot = broadcast_if_small(hot)
    same = F.col("_key").eqNullSafe(F.col("_hot"))
    spread = items.drop("_first").join(hot, same, "left_semi").withColumn("_group", F.pmod(F.xxhash64("_key", "_row"), F.lit(groups)))
    before = Window.partitionBy("_hot").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy(F.col("_key").alias("_hot"), F.col("_group").alias("_in")).agg(F.sum(F.ceil(F.col("_size") / capacity)).alias("_parts"))
    first = parts.select("_hot", "_in", F.coalesce(F.sum("_parts").over(before), F.lit(0)).alias("_first"))
    numbered = spread.join(first, same & (F.col("_group") == F.col("_in"))).drop("_hot", "_in")
    return items.join(hot, same, "left_anti").unionByName(numbered)


def pack(sizes: DataFrame, key: str, size: str, capacity: int, group_containers: int = GROUP_CONTAINERS, key_items: int = KEY_ITEMS) -> DataFrame:
    """Containers of the items: (``key``, part, container_id, size_from, size_to).

    An item above the capacity fills whole containers and leaves one part that is packed like an
    item; no other item is split. Defined cases: null, zero and negative sizes take no part;
    items with the same key are items of their own, told apart by their part; items of the full
    capacity fill a container alone; a key, or null, with more than ``key_items`` items is spread
    over all groups; an empty table gives no rows; other columns are ignored.
    Only keys and sizes are shuffled, and a group holds a bounded number of tokens.
    """
    items = materialise(sizes.where(F.col(size) > 0).select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_size"), F.monotonically_increasing_id().alias("_row")))
    total = items.agg(F.sum("_size")).first()[0] or 0
    groups = max(1, -(-total // (capacity * group_containers)))

    def pack_group(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_key", "_row"], ascending=[False, True, True], kind="stable")
        size_of = pdf["_size"].to_numpy()
        whole, rest = size_of // capacity, size_of % capacity
        left = rest > 0
        window = fill(rest[left], capacity)
        used = int(window.max()) + 1 if len(window) else 0
        keys = pdf["_key"].to_numpy()
        seen = pdf.groupby("_key", dropna=False).cumcount().to_numpy()
        row = np.repeat(np.arange(len(pdf)), whole)
        part = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        rows = np.concatenate([row, np.nonzero(left)[0]])
        parts = np.concatenate([part, whole[left]])
        container = np.concatenate([used + np.arange(len(row)), window])
        start = parts * capacity
        # Equal keys get parts of their own: each copy's parts follow those of the copy before.
        first = pd.Series(whole + left).groupby(pd.Series(keys), dropna=False).cumsum().to_numpy() - (whole + left) if seen.any() else np.zeros(len(pdf), np.int64)
        before = pdf["_first"].to_numpy()
        return pd.DataFrame({
            "key": keys[rows],
            "part": (parts + first[rows] + before[rows]).astype(np.int32),
            "container_id": (int(name[0]) << 24) + container,
            "size_from": start,
            "size_to": np.minimum(start + capacity, size_of[rows]),
        })

    kind = items.schema["_key"].dataType.simpleString()
    packed = _dealt(items, groups, capacity, key_items).groupBy("_group").applyInPandas(pack_group, f"key {kind}, part int, container_id bigint, size_from bigint, size_to bigint")
    return packed.withColumnRenamed("key", key)
