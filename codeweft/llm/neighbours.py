"""Most similar vectors of every vector: projected kd-trees searched outwards, chi-square stopping.

Vectors are put onto the unit sphere and projected by Gaussian (2-stable) directions, so the
projected difference of two vectors at distance d is d times a standard normal: its square over
d² is chi-square with one degree of freedom per direction. A kd-tree splits a low-dimensional
projection at medians into leaves of about ``LEAF`` vectors. Of every leaf the chi-square law gives,
from the query's projected distances to the faces on the way, the chance that a vector at a given
distance lies in it. A query takes leaves in the order of these chances, over the trees of a round,
and verifies what lies in them, until the chance that a neighbour lies in none of them is small
enough (the stopping test). One tree prunes little at the distances asked for, hence several; a
query that exhausts a round's leaves goes on in fresh trees, without an end but the test.

Leaves hold vectors as 8-bit codes with their exact rounding error, which bounds the error of a
similarity; what may reach the bar is computed from the full vectors afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import broadcast_if_small, materialise

#: Vectors of a leaf, about; trees of a round; leaves of a tree that a query may take; wanted chance to see a neighbour.
LEAF, TREES, BEAM, CERTAINTY = 512, 8, 8, 0.97
#: Vectors that the medians are fitted on (the leaves hold all vectors), fewest of a median of its
#: own, and most levels of a tree (its medians are sent to the executors, 2 MB a tree at most).
SAMPLE, LEAST, LEVELS = 65_536, 16, 18
#: A leaf with more vectors, or queries, than so many times ``LEAF`` is searched in blocks.
BLOCK = 8


def sound(vector: Column, length: int) -> Column:
    """Whether a vector has the right length and only finite values, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == length) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(df: DataFrame, key: str, vector: str, length: int) -> DataFrame:
    """(_key, _unit): unit vectors as packed 32-bit floats."""

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.array(pdf["_vector"].tolist(), np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                pdf["_unit"] = [v.tobytes() for v in x.astype(np.float32)]
            else:
                pdf["_unit"] = b""
            yield pdf[["_key", "_unit"]]

    rows = df.where(F.col(key).isNotNull() & sound(F.col(vector), length)).select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    rows = rows.groupBy("_key").agg(F.min("_vector").alias("_vector"))
    return rows.mapInPandas(pack, f"_key {df.schema[key].dataType.simpleString()}, _unit binary")


def _matrix(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float32).reshape(len(units), -1)


class _Forest:
    """Trees of one round: directions, and the medians of each level's nodes."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((trees, sample.shape[1], depth)).astype(np.float32)
        self.medians = [self._fit(sample @ d, depth) for d in self.directions]

    @staticmethod
    def _fit(projected: np.ndarray, depth: int) -> list[np.ndarray]:
        medians, node = [], np.zeros(len(projected), np.int64)
        for level in range(depth):
            x, own = projected[:, level], np.zeros(2**level, np.float32)
            # A node with a thin sample takes the median of its nearest ancestor with enough of it.
            for up in range(level, -1, -1):
                order = np.lexsort((x, node >> up))
                starts = np.searchsorted((node >> up)[order], np.arange(2 ** (level - up) + 1))
                counts = np.diff(starts)
                middle = x[order][np.minimum(starts[:-1] + counts // 2, len(x) - 1)] if len(x) else np.zeros(len(counts))
                own = np.where(np.repeat(counts, 2**up) >= LEAST, np.repeat(middle, 2**up), own)
                if (counts < LEAST).all():
                    break
            medians.append(own.astype(np.float32))
            node = 2 * node + (x >= medians[-1][node])
        return medians

    def leaf(self, tree: int, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        for level, median in enumerate(self.medians[tree]):
            node = 2 * node + (projected[:, level] >= median[node])
        return node

    def likely(self, tree: int, projected: np.ndarray, reach: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest leaves of a vector at distance ``reach``, by falling chance, and their chances."""
        node, chance = np.zeros((len(projected), 1), np.int64), np.ones((len(projected), 1))
        for level, median in enumerate(self.medians[tree]):
            gap = projected[:, level, None] - median[node]
            near = gap >= 0
            stay = (1 + _chi_square_1((gap / reach[:, None]) ** 2)) / 2
            node = np.concatenate([2 * node + near, 2 * node + ~near], axis=1)
            chance = np.concatenate([chance * stay, chance * (1 - stay)], axis=1)
            if node.shape[1] > beam:
                kept = np.argpartition(-chance, beam, axis=1)[:, :beam]
                node, chance = np.take_along_axis(node, kept, 1), np.take_along_axis(chance, kept, 1)
        order = np.argsort(-chance, axis=1, kind="stable")
        return np.take_along_axis(node, order, 1), np.take_along_axis(chance, order, 1)

    def plan(self, units: np.ndarray, reach: np.ndarray, need: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of own leaves; keys of leaves by falling chance and which are taken; and the chance
        that those miss a vector at ``reach``. ``need`` is minus the log of the chance wanted."""
        own, keys, chances, gains = [], [], [], []
        for t in range(len(self.medians)):
            projected = units @ self.directions[t]
            leaf, chance = self.likely(t, projected, reach, beam)
            before = np.cumsum(chance, axis=1) - chance
            own.append(self.leaf(t, projected) | t << 32)
            keys.append(leaf | t << 32)
            chances.append(chance)
            gains.append(-np.log(np.maximum(1 - chance / np.maximum(1 - before, 1e-9), 1e-9)))
        keys, chances, gains = (np.concatenate(x, axis=1) for x in (keys, chances, gains))
        order = np.argsort(-chances, axis=1, kind="stable")
        keys, gains = np.take_along_axis(keys, order, 1), np.take_along_axis(gains, order, 1)
        total = np.cumsum(gains, axis=1)
        taken = total - gains < need[:, None]
        return np.stack(own, axis=1), keys, taken, np.exp(-(gains * taken).sum(axis=1))


def _chi_square_1(x: np.ndarray) -> np.ndarray:
    """Chi-square distribution function with one degree of freedom, erf(sqrt(x / 2)), to 1e-7."""
    z = np.sqrt(x / 2)
    t = 1 / (1 + 0.3275911 * z)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 1 - series * np.exp(-z * z)


def _codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors rounded to 8 bits a value, and how far their directions are from the vectors."""
    codes = np.rint(units * (127 / np.abs(units).max(axis=1, keepdims=True))).astype(np.int8)
    rounded = codes / np.linalg.norm(codes.astype(np.float64), axis=1, keepdims=True)
    return codes, np.linalg.norm(units - rounded, axis=1)


def _place(forest: _Forest, goal: float, beam: int):
    """Keys (tree and leaf) a class lies in or looks into, with its roles there."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            units = _matrix(column("_unit").to_pylist())
            missed, active = column("_missed").to_numpy(), column("_active").to_numpy(zero_copy_only=False)
            own, keys, taken, left = forest.plan(units, column("_reach").to_numpy(), np.log(np.maximum(missed, 1e-300) / goal), beam)
            taken &= active[:, None]
            tree = keys >> 32
            at_home = np.take_along_axis(own, tree, 1) == keys
            asks = np.zeros(own.shape, bool)
            row, entry = np.nonzero(taken & at_home)
            asks[row, tree[row, entry]] = True
            # Own leaves come first in each row's list, then those it only looks into.
            held = np.concatenate([np.ones(own.shape, bool), taken & ~at_home], axis=1)
            roles = np.concatenate([_LIES + _ASKS * asks, np.full(keys.shape, _ASKS)], axis=1).astype(np.int8)
            offsets = pa.array(np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32))
            codes, error = _codes(units)
            out = [
                column("_class"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([own, keys], axis=1)[held])),
                pa.ListArray.from_arrays(offsets, pa.array(roles[held])), pa.array(np.where(active, missed * left, missed)),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["_class", "_code", "_error", "_keys", "_roles", "_missed"])

    return place


_LIES, _ASKS = 1, 2


def _verify(k: int, floor: float):
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        role, keys, error = pdf["_role"].to_numpy(), pdf["_class"].to_numpy(), pdf["_error"].to_numpy()
        lies, asks = np.nonzero(role & _LIES)[0], np.nonzero(role & _ASKS)[0]
        if not len(lies) or not len(asks):
            return pd.DataFrame({"_a": keys[:0], "_b": keys[:0]})
        codes = np.frombuffer(b"".join(pdf["_code"]), np.int8).reshape(len(pdf), -1).astype(np.float32)
        codes /= np.linalg.norm(codes, axis=1, keepdims=True)
        inside, most = codes[lies], error[lies].max()
        found = []
        for i in range(0, len(asks), 512):
            own = asks[i : i + 512]
            sims = codes[own] @ inside.T
            sims[keys[own][:, None] == keys[lies][None, :]] = -2
            bar = np.full(len(own), floor)
            if sims.shape[1] > k + 1:
                # What is below the k-th for certain: both similarities may be off by their errors.
                bar = np.maximum(bar, np.partition(sims, -k, axis=1)[:, -k] - error[own] - most)
            a, b = np.nonzero(sims >= (bar - error[own] - most - 1e-5)[:, None])
            near = sims[a, b] >= bar[a] - error[own[a]] - error[lies[b]] - 1e-5
            one, two = keys[own[a[near]]], keys[lies[b[near]]]
            found.append(pd.DataFrame({"_a": np.minimum(one, two), "_b": np.maximum(one, two)}))
        return pd.concat(found).drop_duplicates()

    return verify


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sims = np.zeros(len(pdf))
        if len(pdf):
            sims = np.einsum("ij,ij->i", _matrix(pdf["_of_a"]).astype(np.float64), _matrix(pdf["_of_b"]).astype(np.float64))
        yield pdf[["_a", "_b"]].assign(_sim=sims)


def _blocks(rows: DataFrame, leaf: int) -> DataFrame:
    """Adds _i and _j: an overfull leaf's vectors are cut into blocks _i, its queries into blocks _j, and all blocks meet."""
    lies, asks = (F.col("_role").bitwiseAND(x) > 0 for x in (_LIES, _ASKS))
    sizes = rows.groupBy("_key").agg(F.count_if(lies).alias("_n_lie"), F.count_if(asks).alias("_n_ask"))
    over = materialise(
        sizes.where((F.col("_n_lie") > BLOCK * leaf) | (F.col("_n_ask") > BLOCK * leaf)).select("_key", *[F.ceil(F.col(n) / (BLOCK * leaf // 2)).cast("int").alias(c) for n, c in (("_n_lie", "_in_i"), ("_n_ask", "_in_j"))])
    )
    if not over.head(1):
        return rows.withColumn("_i", F.lit(0)).withColumn("_j", F.lit(0))
    known = rows.join(broadcast_if_small(over), "_key", "left").withColumn("_in_i", F.greatest(F.coalesce("_in_i", F.lit(1)), F.lit(1))).withColumn("_in_j", F.greatest(F.coalesce("_in_j", F.lit(1)), F.lit(1)))
    dealt = lambda n: F.pmod(F.xxhash64("_class"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    whole = known.where("_in_i = 1 and _in_j = 1").withColumn("_i", F.lit(0)).withColumn("_j", F.lit(0))
    cut = known.where("_in_i > 1 or _in_j > 1")
    held = cut.where(lies).withColumn("_role", F.lit(_LIES).cast("tinyint")).withColumn("_i", dealt("_in_i")).withColumn("_j", F.explode(upto("_in_j")))
    asked = cut.where(asks).withColumn("_role", F.lit(_ASKS).cast("tinyint")).withColumn("_i", F.explode(upto("_in_i"))).withColumn("_j", dealt("_in_j"))
    return whole.unionByName(held).unionByName(asked).drop("_in_i", "_in_j")


def _best(pairs: DataFrame, key: str, k: int, *fields: Column) -> DataFrame:
    """The k best of each key; partial lists are cut to k at once, so no group is collected whole."""
    rank = F.struct(*fields)
    cut = lambda name: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))), 1, k)
    part = pairs.groupBy(key, F.pmod(F.xxhash64("_near"), F.lit(16)).alias("_part")).agg(F.slice(F.sort_array(F.collect_set(rank)), 1, k).alias("_top"))
    return part.groupBy(key).agg(cut("_top").alias("_top"))


def nearest(
    df: DataFrame, key: str, vector: str, *, length: int, k: int = 5, floor: float = 0.0, leaf: int = LEAF, beam: int = BEAM,
    certainty: float = CERTAINTY, trees: int = TREES, sample: int = SAMPLE, levels: int = LEVELS, seed: int = 17,
) -> DataFrame:
    """The up to ``k`` most similar other vectors of each: (``key``, neighbour, similarity, rank).

    Similarity is the cosine to six decimals, at least ``floor``; ties go to the smaller key.
    Every vector is a query and every vector is in the leaves. A pair that one end finds counts for
    both. A query stops when it misses a vector as near as its k-th neighbour so far (at first: at
    the distance of ``floor``) with a chance of at most 1 - ``certainty``.

    Defined cases: null keys, and vectors that are null, empty, of another length, all zero or
    hold null, NaN or infinite values take no part; repeated keys count once (their smallest
    vector); equal directions are searched once as a class, whose members are all neighbours of
    each other at similarity 1; an empty table gives no rows; other columns are ignored.
    """
    units = materialise(_units(df, key, vector, length))
    members = units.groupBy("_unit").agg(F.min("_key").alias("_class"), F.count("*").alias("_n"))
    classes = materialise(members.select("_class", "_unit"))
    n = classes.count()
    depth = min(levels, max(0, math.ceil(math.log2(max(n, 1) / leaf))))
    kind = classes.schema["_class"].dataType.simpleString()
    widest = math.sqrt(max(2 - 2 * floor, 1e-6))
    share = min(1.0, 1.2 * sample / max(n, 1))
    drawn = classes.select("_unit").sample(share, seed).limit(sample).toPandas()["_unit"] if n else pd.Series([], dtype=object)
    fitted = _matrix(drawn) if len(drawn) else np.zeros((0, length), np.float32)
    alone = 1 - certainty

    state = classes.select("*", F.lit(1.0).alias("_missed"), F.lit(widest).alias("_reach"), F.lit(True).alias("_active"))
    links, rounds = [], 0
    while True:
        forest = _Forest(fitted, depth, trees if depth else 1, seed + 1 + rounds)
        placed = materialise(state.mapInArrow(
            _place(forest, alone, beam), f"_class {kind}, _code binary, _error double, _keys array<bigint>, _roles array<tinyint>, _missed double"
        ))
        rows = placed.select("_class", "_code", "_error", F.explode(F.arrays_zip("_keys", "_roles")).alias("_at")).select("_class", "_code", "_error", F.col("_at._keys").alias("_key"), F.col("_at._roles").alias("_role"))
        if rounds:
            asked = rows.where(F.col("_role") >= _ASKS).select("_key").distinct()
            rows = rows.join(asked, "_key", "left_semi")
        seen = _blocks(rows, leaf).groupBy("_key", "_i", "_j").applyInPandas(_verify(k, floor), f"_a {kind}, _b {kind}").distinct()
        for side in ("_a", "_b"):
            seen = seen.join(classes.select(F.col("_class").alias(side), F.col("_unit").alias(f"_of{side}")), side)
        links.append(materialise(seen.mapInPandas(_exact, f"_a {kind}, _b {kind}, _sim double").where(F.col("_sim") >= floor - 5e-7)))
        rounds += 1
        pairs = reduce(DataFrame.unionByName, links)
        pairs = pairs.select(F.explode(F.array(F.struct(F.col("_a").alias("_class"), F.col("_b").alias("_near"), "_sim"), F.struct(F.col("_b").alias("_class"), F.col("_a").alias("_near"), "_sim"))).alias("_p")).select("_p.*")
        best = materialise(_best(pairs, "_class", k, (-F.round("_sim", 6)).alias("_minus"), F.col("_near")))
        open_ones = placed.where(F.col("_missed") > alone).select("_class", "_missed")
        if not depth or not open_ones.head(1):
            break
        kth = F.when(F.size("_top") == k, F.sqrt(F.greatest(2 + 2 * F.element_at("_top", -1)["_minus"], F.lit(1e-6))))
        # Those at rest stay in the leaves for the others.
        asking = open_ones.join(best, "_class", "left").select("_class", "_missed", F.coalesce(kth, F.lit(widest)).alias("_reach"), F.lit(True).alias("_active"))
        state = classes.join(asking, "_class", "left").select("_class", "_unit", F.coalesce("_missed", F.lit(0.0)).alias("_missed"), F.coalesce("_reach", F.lit(widest)).alias("_reach"), F.coalesce("_active", F.lit(False)).alias("_active"))

    def listed(lists: DataFrame) -> DataFrame:
        entries = lists.select("_key", F.posexplode("_top").alias("_rank", "_p"))
        return entries.select(F.col("_key").alias(key), F.col("_p._near").alias("neighbour"), (-F.col("_p._minus")).alias("similarity"), (F.col("_rank") + 1).alias("rank")).where(F.col("similarity") >= floor)

    # A class of several members stands for all of them, in its own list and in the lists it is in.
    several = materialise(members.where("_n > 1").select("_unit", "_class"))
    if not several.head(1):
        return listed(best.withColumnRenamed("_class", "_key"))
    linked = best.select("_class", F.explode("_top").alias("_p")).select("_class", F.col("_p._near").alias("_to"), (-F.col("_p._minus")).alias("_sim"))
    concerned = materialise(several.select("_class").unionByName(linked.join(several.select(F.col("_class").alias("_to")), "_to", "left_semi").select("_class")).distinct())
    plain = best.join(concerned, "_class", "left_anti")
    # k + 1 members of a class are enough for anyone's list.
    member = units.join(several, "_unit").select("_key", "_class")
    some = _best(member.withColumn("_near", F.col("_key")), "_class", k + 1, F.col("_near")).select("_class", F.transform("_top", lambda m: m["_near"]).alias("_members"))
    others = linked.join(concerned, "_class", "left_semi").join(some.withColumnRenamed("_class", "_to"), "_to", "left").select("_class", F.explode(F.coalesce("_members", F.array("_to"))).alias("_near"), "_sim")
    own = some.select("_class", F.explode("_members").alias("_near"), F.lit(1.0).alias("_sim"))
    lists = _best(others.unionByName(own), "_class", k + 1, (-F.round("_sim", 6)).alias("_minus"), F.col("_near"))
    keys = member.unionByName(concerned.join(several, "_class", "left_anti").select(F.col("_class").alias("_key"), "_class"))
    expanded = keys.join(lists, "_class").select("_key", F.slice(F.expr("filter(_top, p -> p._near <> _key)"), 1, k).alias("_top"))
    return listed(plain.withColumnRenamed("_class", "_key").unionByName(expanded))
