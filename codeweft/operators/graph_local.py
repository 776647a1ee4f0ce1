"""Graph algorithms that are sequential by nature, run where the graph fits one worker.

Betweenness is a sum over sources, so sources are spread over tasks; each task holds the adjacency
(broadcast while a count proves the bound) and walks from many sources at once. Bridges and strong
components do not depend on what else is in a piece, so a graph up to ``LOCAL_EDGES`` edges is one piece
and a larger one is cut into its weakly connected components. Betweenness, ranks and communities have
distributed twins of equal result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators import graph
from codeweft.operators.components import connected_components
from codeweft.operators.graph import symmetric, weighted
from codeweft.runtime import materialise

#: Most edges an adjacency may have that every task holds.
LOCAL_EDGES = 5_000_000

#: Nodes and edges of all walks that a task makes at once.
WALK_CELLS = 8_000_000

#: Least nodes of a piece whose later turns are walked in rows of all walks, and most turns.
LATE_NODES, LATE_TURNS = 1000, 300


def _weak_pieces(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Smallest node of each node's weak component: roots hook onto smaller ones, then paths are halved to their ends."""
    piece = np.arange(n)
    while True:
        low = np.minimum(piece[src], piece[dst])
        near = piece.copy()
        np.minimum.at(near, piece[src], low)
        np.minimum.at(near, piece[dst], low)
        while not np.array_equal(near, further := near[near]):
            near = further
        if np.array_equal(near, piece):
            return piece
        piece = near


def _peel(n: int, src: np.ndarray, dst: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[bool, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Trees that hang on the graph, taken off from their tips: (rounds, kept edges, starts, ends).

    A node with one edge into it and none out ends paths that also pass the node above it, and is counted there
    (ends); a node with one edge out and none into it starts the paths of the node below it (starts). Rounds are
    (whether the lower node was taken, edges) in their order.
    """
    number = np.arange(len(src))
    n_out, n_in = np.bincount(src, minlength=n), np.bincount(dst, minlength=n)
    # sums of edges: of a single one, the edge itself
    out, into = np.bincount(src, number, n).astype(np.int64), np.bincount(dst, number, n).astype(np.int64)
    starts, ends, kept = starts.astype(np.int64), np.ones(n, np.int64), np.ones(len(src), bool)
    rounds, near = [], np.arange(n)
    while len(near):
        tip = near[(n_out[near] == 0) & (n_in[near] == 1)]
        lower, above = into[tip], src[into[tip]]
        n_in[tip] = 0
        np.add.at(ends, above, ends[tip])
        np.subtract.at(n_out, above, 1)
        np.subtract.at(out, above, lower)
        near = np.union1d(near, above)
        tip = near[(n_in[near] == 0) & (n_out[near] == 1)]
        upper, below = out[tip], dst[out[tip]]
        n_out[tip] = 0
        np.add.at(starts, below, starts[tip])
        np.subtract.at(n_in, below, 1)
        np.subtract.at(into, below, upper)
        rounds += [(True, lower), (False, upper)]
        kept[lower] = kept[upper] = False
        near = np.union1d(above, below)
    return [r for r in rounds if len(r[1])], kept, starts, ends


def _hand_on(n: int, src: np.ndarray, dst: np.ndarray, edges: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rounds of edges by which a node with one edge out, on no cycle, hands its starts (changed) to the next; handing nodes.

    No path leads back to such a node from the next one: its paths are those of the next one after one more edge.
    """
    s, d = src[edges], dst[edges]
    single = edges[np.bincount(s, minlength=n)[s] == 1]
    on = edges
    for _ in range(100):  # fewer than all rounds leave more that may be a cycle
        s, d = src[on], dst[on]
        live = (np.bincount(d, minlength=n)[s] > 0) & (np.bincount(s, minlength=n)[d] > 0)
        if live.all():
            break
        on = on[live]
    single = single[np.isin(single, on, assume_unique=True, invert=True)]
    hands = np.full(n, -1)
    hands[src[single]] = single
    waits = np.bincount(dst[single], minlength=n)
    rounds, near = [], src[single][waits[src[single]] == 0]
    while len(near):
        rounds.append(hands[near])
        below = dst[rounds[-1]]
        np.add.at(starts, below, starts[near])
        np.subtract.at(waits, below, 1)
        near = np.unique(below)
        near = near[(waits[near] == 0) & (hands[near] >= 0)]
    return rounds, hands >= 0


def _turns(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """When a node's paths are all known, walking from the nodes of turn 0: those that lead to a cycle or far on.

    The others lead to none: each comes after all nodes with an edge to it, those of turn 0 included.
    """
    back, last = np.zeros(n, np.int64), 0
    for last in range(1, LATE_TURNS + 1):
        ended = np.bincount(src, minlength=n) == 0
        ended &= back == 0
        if not ended.any():
            break
        back[ended] = last
        on = back[dst] == 0
        src, dst = src[on], dst[on]
    return np.where(back > 0, last + 1 - back, 0)


def _walk(first: np.ndarray, last: np.ndarray, to: np.ndarray, sources: np.ndarray, lo: int, width: int, place: np.ndarray) -> tuple[list, list]:
    """Shortest paths from the sources, a level of all walks at a time: levels (node, walk, paths) and their links (above, below, edge).

    Edges ``first[v]:last[v]`` of ``to`` leave node v; the sources reach only the ``width`` nodes from ``lo``.
    ``place`` has a cell for each source and node, all -1 before and after.
    """
    node, row = sources, np.arange(len(sources))
    cells, levels, links = [row * width + node - lo], [(node, row, np.ones(len(node)))], []
    place[cells[0]] = 0
    while True:
        start = first[node]
        n_out = last[node] - start
        past = np.cumsum(n_out)
        above = np.repeat(np.arange(len(node)), n_out)
        edge = np.arange(past[-1]) + np.repeat(start - past + n_out, n_out)
        reached = to[edge]
        cell = (row * width - lo)[above] + reached
        new = np.flatnonzero(place[cell] < 0)
        if not len(new):
            break
        above, edge, reached, cell = above[new], edge[new], reached[new], cell[new]
        number = np.arange(len(cell))
        place[cell] = number
        one = np.flatnonzero(place[cell] == number)
        place[cell[one]] = number[: len(one)]
        below = place[cell]
        links.append((above, below, edge))
        cells.append(cell[one])
        node, row = reached[one], row[above[one]]
        levels.append((node, row, np.bincount(below, levels[-1][2][above], len(one))))
    place[np.concatenate(cells)] = -1
    return levels, links


def _late(levels: list, times: np.ndarray, into: np.ndarray, came: np.ndarray, goes: np.ndarray, ends: np.ndarray, steps: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...] | None:
    """What the walks pass on to the nodes of later turns, a turn at a time in rows of all walks.

    Edges ``into[v]:into[v + 1]`` lead from ``came`` to ``goes``. A node that only one edge enters, of those that any
    walk may take, follows the last node before it that has a row of its own. Returned: those edges and their credit,
    nodes reached and by how many starts, and the credit that is owed to the nodes of each level.
    """
    seen, heads, gap = np.zeros(hi - lo, bool), np.arange(hi - lo), np.zeros(hi - lo, np.int32)
    for node, _, _ in levels:
        seen[node - lo] = True
    turns = []
    for start, stop in zip(steps[:-1], steps[1:], strict=True):
        edge = np.arange(into[start], into[stop])
        edge = edge[seen[came[edge] - lo]]
        if len(edge):
            node = goes[edge] - lo
            first = np.diff(node, prepend=-1) != 0
            only = first & np.append(first[1:], True)
            seen[node] = True
            one, some = edge[only], edge[~only]
            above, node = came[one] - lo, goes[one] - lo
            heads[node], gap[node] = heads[above], gap[above] + 1
            turns.append((one, some, np.flatnonzero(first[~only])))
    if not turns:
        return None
    late = np.flatnonzero(seen[steps[0] - lo :]) + steps[0] - lo
    follows = late[heads[late] != late]
    own = seen & (heads == np.arange(hi - lo))
    place = (np.cumsum(own) - 1)[heads]
    weight = np.zeros(np.count_nonzero(own))
    np.add.at(weight, place[late], ends[late + lo])
    depth, paths = np.full((len(weight), len(times)), 1 << 30, np.int32), np.zeros((len(weight), len(times)))
    cells = [place[node - lo] * len(times) + row for node, row, _ in levels]
    for k, (cell, (_, _, n)) in enumerate(zip(cells, levels, strict=True)):
        depth.reshape(-1)[cell] = k
        paths.reshape(-1)[cell] = n
    used = []
    for _, edge, head in turns:
        if len(edge):
            at, above = place[goes[edge[head]] - lo], came[edge] - lo
            far = depth[place[above]] + gap[above][:, None]
            least = np.minimum.reduceat(far, head, axis=0)
            depth[at] = least + 1
            part = paths[place[above]]
            part *= far == np.repeat(least, np.diff(head, append=len(edge)), axis=0)
            paths[at] = np.add.reduceat(part, head, axis=0)
            used.append(part)
    n_starts = (paths > 0) @ times
    credit, flow, shares = np.zeros_like(paths), np.zeros(hi - lo), []
    flow[follows] = ends[follows + lo] * n_starts[place[follows]]
    for one, edge, head in reversed(turns):
        if len(edge):
            at, above = place[goes[edge[head]] - lo], came[edge] - lo
            share = (times * weight[at][:, None] + credit[at]) / np.maximum(paths[at], 1)
            share = np.repeat(share, np.diff(head, append=len(edge)), axis=0)
            share *= used.pop()
            shares.append(share.sum(axis=1))
            np.add.at(flow, above, shares[-1])
            order = np.argsort(place[above], kind="stable")
            row = place[above][order]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            credit[row[first]] += np.add.reduceat(share[order], first, axis=0)
        else:
            shares.append(np.zeros(0))
        shares.append(flow[goes[one] - lo])
        np.add.at(flow, came[one] - lo, shares[-1])
    early = place[np.flatnonzero(own[: steps[0] - lo])]
    credit[early] += times * weight[early][:, None]
    return np.concatenate([x for one, edge, _ in reversed(turns) for x in (edge, one)]), np.concatenate(shares), late + lo, n_starts[place[late]], [credit.reshape(-1)[cell] for cell in cells]


def edge_betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, betweenness): shortest directed paths through each edge, not normalised.

    ``sources`` (node) are the starts of the paths, all nodes by default; fewer give an estimate that
    the caller scales. Beyond ``LOCAL_EDGES`` edges the walks are joins; the result is the same. Trees that
    hang on the graph and nodes that only lead to the next are not walked from: what passes their edges
    follows from the walks of the rest.
    """
    distinct = materialise(edges.where("src <> dst").select("src", "dst").distinct())
    starts = distinct.select(F.col("src").alias("node")).distinct() if sources is None else sources.select("node").distinct()
    if distinct.count() > LOCAL_EDGES:
        return graph.edge_betweenness(distinct, starts)
    pairs = distinct.toArrow()
    m = pairs.num_rows
    codes, names = pd.factorize(pd.concat([pairs["src"].to_pandas(), pairs["dst"].to_pandas()], ignore_index=True), sort=True)
    n, src, dst = len(names), codes[:m], codes[m:]
    wanted = np.ones(n, bool)
    if sources is not None:
        known = starts.join(distinct.select(F.col("src").alias("node")), "node", "left_semi").toArrow()["node"].to_pandas()
        wanted = np.isin(np.arange(n), pd.Index(names).get_indexer(known))
    rounds, kept, weight, ends = _peel(n, src, dst, wanted)
    handed, hands = _hand_on(n, src, dst, np.flatnonzero(kept), weight)
    rounds += [(False, edge) for edge in handed]
    piece, turn = _weak_pieces(n, src[kept], dst[kept]), _turns(n, src[kept], dst[kept])
    # nodes are numbered piece by piece and turn by turn, and edges by their source, those of the trees last: a piece is a range of both
    order = np.lexsort((turn, piece))
    position = np.empty_like(order)
    position[order] = np.arange(n)
    names, weight, ends, piece, turn, hands = np.asarray(names)[order], weight[order].astype(float), ends[order].astype(float), piece[order], turn[order], hands[order]
    src, dst = position[src], position[dst]
    by = np.lexsort((dst, src, ~kept))
    at = np.empty_like(by)
    at[by] = np.arange(m)
    rounds = [(lower, at[edge].astype(np.int32)) for lower, edge in rounds]
    src, to = src[by].astype(np.int32), dst[by].astype(np.int32)
    walks = kept.sum()
    first = np.searchsorted(src[:walks], np.arange(n + 1)).astype(np.int32)
    inner = (first[:-1] + np.bincount(src[:walks], turn[to[:walks]] == 0, n)).astype(np.int32)
    entering = np.argsort(to[:walks], kind="stable").astype(np.int32)
    into = np.searchsorted(to[:walks][entering], np.arange(n + 1)).astype(np.int32)
    bounds = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), n)
    steps = np.flatnonzero((np.diff(piece, prepend=-1) != 0) | (np.diff(turn, prepend=-1) != 0))
    steps = np.append(steps, n)
    walked = np.flatnonzero((np.diff(first) > 0) & (weight > 0) & ~hands)
    spark = edges.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    # neighbouring sources share what they reach; those of later turns reach less, by a rough guess
    cost = np.cumsum(np.diff(bounds)[np.searchsorted(bounds, walked, "right") - 1] * np.where(turn[walked] == 0, 1, 1 / 32))
    cuts = np.append(np.searchsorted(cost, np.linspace(0, cost[-1:].sum(), tasks + 1)[:-1]), len(walked))
    shared = spark.sparkContext.broadcast((names, src, first, inner, to, into, entering, weight, ends, turn, rounds, bounds, steps, walked, cuts))

    def brandes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, src, first, inner, to, into, entering, weight, ends, turn, rounds, bounds, steps, walked, cuts = shared.value
        score, starts_of, ends_of, place = np.zeros(len(to)), np.zeros(len(names)), np.zeros(len(names)), np.full(0, -1, np.int32)
        came, goes = src[entering], to[entering]
        rows = np.append(0, np.cumsum((turn == 0) | (np.diff(into) > 1)))
        for task in (k for pdf in batches for k in pdf["id"]):
            if task == 0:  # every node starts and ends paths itself
                starts_of += weight
                ends_of += ends
            own, at = walked[cuts[task] : cuts[task + 1]], 0
            while at < len(own):
                ahead = own[at : at + 4096]
                lo, hi = (int(bounds[np.searchsorted(bounds, ahead[0], "right") - k]) for k in (1, 0))
                by_turns = hi - lo >= LATE_NODES and turn[ahead[0]] == 0 and turn[hi - 1] > 0
                if by_turns:
                    # walks in one piece, of its nodes of turn 0; the rest of it follows
                    inside = steps[np.searchsorted(steps, lo) : np.searchsorted(steps, hi, "right")]
                    n = max(1, min(64, int(2 * WALK_CELLS // (rows[hi] - rows[lo])), int(np.searchsorted(ahead, inside[1]))))
                    width, last = int(inside[1]) - lo, inner
                else:
                    # as many sources as the cells allow, each with the nodes and edges of all pieces in the batch
                    end = bounds[np.searchsorted(bounds, ahead, "right")]
                    cost = np.arange(1, len(ahead) + 1) * (end - lo + first[end] - first[lo])
                    n = max(1, int(np.searchsorted(cost, WALK_CELLS, "right")))
                    width, last = int(end[n - 1]) - lo, first[1:]
                if len(place) < n * width:
                    place = np.full(n * width, -1, np.int32)
                ahead = ahead[:n]
                times = weight[ahead]
                levels, links = _walk(first, last, to, ahead, lo, width, place)
                late = _late(levels, times, into, came, goes, ends, inside[1:], lo, hi) if by_turns else None
                if late is not None:
                    edge, share, node, n_starts, owed = late
                    score[entering[edge]] += share
                    starts_of[node] += n_starts
                credit = np.zeros(len(levels[-1][0]))
                for k in range(len(levels) - 1, -1, -1):
                    node, row, paths = levels[k]
                    if late is not None:
                        credit = credit + owed[k]
                    if k:
                        above, below, edge = links[k - 1]
                        n_starts = times[row]
                        np.add.at(starts_of, node, n_starts)
                        share = levels[k - 1][2][above] * ((n_starts * ends[node] + credit) / paths)[below]
                        np.add.at(score, edge, share)
                        credit = np.bincount(above, share, len(levels[k - 1][0]))
                ends_of[ahead] += np.rint(credit / times)
                at += n
        for lower, edge in reversed(rounds):
            up, down = src[edge], to[edge]
            if lower:
                score[edge] += starts_of[up] * ends[down]
                starts_of[down] += starts_of[up]
            else:
                score[edge] += weight[up] * ends_of[down]
                ends_of[up] += ends_of[down]
        edge = np.flatnonzero(score)
        yield pd.DataFrame({"src": names[src[edge]], "dst": names[to[edge]], "part": score[edge]})

    kind = edges.schema["src"].dataType.simpleString()
    parts = spark.range(0, tasks, 1, tasks).mapInPandas(brandes, f"src {kind}, dst {kind}, part double")
    return parts.groupBy("src", "dst").agg(F.round(F.sum("part"), 6).alias("betweenness"))


def _pieces(edges: DataFrame) -> DataFrame:
    """The graph as one piece while a task may hold it, else its weak components."""
    edges = materialise(edges)
    if edges.count() <= LOCAL_EDGES:
        return edges.withColumn("component", F.lit(0))
    component = connected_components(edges, "src", "dst").withColumnRenamed("node", "src")
    return edges.join(component, "src")


def _bridges_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Low links by an explicit stack."""
    near: dict = defaultdict(list)
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        near[a].append(b)
    number, low, cut, found = {}, {}, set(), []
    for root in sorted(near):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        children, stack = 0, [(root, None, iter(sorted(near[root])))]
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[v])
                    if low[v] > number[up]:
                        found.append((min(up, v), max(up, v)))
                    if up != root and low[v] >= number[up]:
                        cut.add(up)
            elif w not in number:
                if v == root:
                    children += 1
                number[w] = low[w] = len(number)
                stack.append((w, v, iter(sorted(near[w]))))
            elif w != parent:
                low[v] = min(low[v], number[w])
        if children > 1:
            cut.add(root)
    rows = [("bridge", a, b) for a, b in found] + [("articulation", c, c) for c in cut]
    return pd.DataFrame(rows, columns=["kind", "a", "b"])


def _strong_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Path-based strong components by an explicit stack."""
    out: dict = defaultdict(list)
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        out[a].append(b)
    number: dict = {}
    done: set = set()
    rows: list = []
    for root in sorted(out):
        if root in number:
            continue
        open_nodes, place, borders, stack = [root], {root: 0}, [root], [(root, iter(out[root]))]
        number[root] = len(number)
        while stack:
            v, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if borders[-1] == v:
                    borders.pop()
                    at = place[v]
                    members = open_nodes[at:]
                    del open_nodes[at:]
                    done.update(members)
                    if len(members) > 1:
                        rows += [(m, min(members), len(members)) for m in members]
            elif w not in number:
                number[w] = len(number)
                place[w] = len(open_nodes)
                open_nodes.append(w)
                borders.append(w)
                stack.append((w, iter(out.get(w, ()))))
            elif w not in done:
                while number[borders[-1]] > number[w]:
                    borders.pop()
    return pd.DataFrame(rows, columns=["node", "component", "size"])


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) like the distributed operator, per weakly connected component."""
    kind = edges.schema["src"].dataType.simpleString()
    return _pieces(edges.where("src <> dst").select("src", "dst").distinct()).groupBy("component").applyInPandas(_strong_of, f"node {kind}, component {kind}, size bigint")


def page_rank(edges: DataFrame, *, damping: float = 0.85, iterations: int = 20, tolerance: float | None = None) -> DataFrame:
    """(node, rank) like the distributed operator, for graphs that one task may hold."""

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
        src, dst, n = ends[: len(pdf)], ends[len(pdf) :], len(nodes)
        out = np.bincount(src, minlength=n)
        sink, ranks = out == 0, np.full(n, 1.0 / n)
        for _ in range(iterations):
            gained = np.bincount(dst, (ranks / np.maximum(out, 1))[src], minlength=n)
            after = (1 - damping) / n + damping * (gained + ranks[sink].sum() / n)
            change, ranks = np.abs(after - ranks).sum(), after
            if tolerance is not None and change < tolerance:
                break
        return pd.DataFrame({"node": nodes, "rank": ranks})

    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").groupBy(F.lit(0).alias("_")).applyInPandas(rank, f"node {kind}, rank double")


def ranks(edges: DataFrame, **options) -> DataFrame:
    """Page rank in one task while it may hold the edges (counted first), else distributed."""
    edges = materialise(edges.select("src", "dst"))
    return (page_rank if edges.count() <= LOCAL_EDGES else graph.page_rank)(edges, **options)


def bridges(edges: DataFrame) -> DataFrame:
    """(kind, a, b): bridges (a < b) and articulation points (a = b) of the undirected graph."""
    kind = edges.schema["src"].dataType.simpleString()
    both = symmetric(edges.where("src <> dst"))
    return _pieces(both).groupBy("component").applyInPandas(_bridges_of, f"kind string, a {kind}, b {kind}")


def _settle(pdf: pd.DataFrame, sweeps: int) -> pd.DataFrame:
    """The sweeps of ``graph.settle`` over links that one task holds."""
    nodes, ends = np.unique(np.concatenate([pdf["node"], pdf["other"]]), return_inverse=True)
    src, dst, weight, n = ends[: len(pdf)], ends[len(pdf) :], pdf["weight"].to_numpy(float), len(nodes)
    group, coin = np.zeros(n, np.int64), np.zeros(n, np.int64)
    group[src], coin[src] = pdf["part"].factorize()[0], pdf["coin"].to_numpy()
    degree = np.bincount(src, weight, minlength=n)
    twice = np.bincount(group, degree)[group]
    of, still = np.arange(n), 0
    for sweep in range(sweeps):
        total = np.bincount(of, degree, minlength=n)
        cells, at = np.unique(src * n + of[dst], return_inverse=True)
        v, c, linked = cells // n, cells % n, np.bincount(at, weight)
        home = c == of[v]
        gain = linked * twice[v] - degree[v] * (total[c] - home * degree[v])
        stay = -degree * (total[of] - degree)
        stay[v[home]] = gain[home]
        order = np.lexsort((c, -gain, v))
        first = order[np.searchsorted(v[order], np.arange(n))]
        moving = (gain[first] > stay) & ((coin >> (sweep % 62)) & 1 == 1)
        of = np.where(moving, c[first], of)
        still = 0 if moving.any() else still + 1
        if still == 3:
            break
    least = np.full(n, n)
    np.minimum.at(least, of, np.arange(n))
    return pd.DataFrame({"node": nodes, "community": nodes[least[of]]})


def settle(links: DataFrame, sweeps: int) -> DataFrame:
    """Communities like ``graph.settle``, for links that one task may hold."""
    kind = links.schema["node"].dataType.simpleString()
    return links.groupBy(F.lit(0).alias("_")).applyInPandas(lambda pdf: _settle(pdf, sweeps), f"node {kind}, community {kind}")


def communities(edges: DataFrame, *, sweeps: int = 40, split_size: int = 50, split_cohesion: float = 0.05) -> DataFrame:
    """(node, community) by local moving on modularity, a community named by its smallest node.

    In a sweep about half of the nodes, told by a bit of their hash, move at once to the community
    of most gain (ties: the smallest name). Communities of at least ``split_size`` nodes whose
    links inside are less than ``split_cohesion`` of all their links are settled again alone. Up to
    ``LOCAL_EDGES`` links the sweeps run in one task, beyond it as joins; the result is the same.
    """
    ends = weighted(edges).where("src <> dst")
    both = ends.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionByName(ends.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))
    links = materialise(both.groupBy("node", "other").agg(F.sum("weight").cast("double").alias("weight")).withColumn("coin", F.xxhash64("node")))
    run = settle if links.count() <= LOCAL_EDGES else graph.settle
    first = materialise(run(links.withColumn("part", F.lit(0)), sweeps))
    named = links.join(first.withColumnRenamed("community", "part"), "node").join(first.select(F.col("node").alias("other"), F.col("community").alias("_far")), "other")
    inside = F.sum(F.when(F.col("part") == F.col("_far"), F.col("weight")).otherwise(0.0)) / 2
    share = inside / (F.sum("weight") - inside)
    loose = named.groupBy("part").agg(F.countDistinct("node").alias("_n"), share.alias("_share")).where((F.col("_n") >= split_size) & (F.col("_share") < split_cohesion))
    again = materialise(named.where("part = _far").join(loose.select("part"), "part", "left_semi").select("node", "other", "weight", "coin", "part"))
    if not again.head(1):
        return first
    second = materialise(run(again, sweeps)).withColumnRenamed("community", "_new")
    return first.join(second, "node", "left").select("node", F.coalesce("_new", "community").alias("community"))
