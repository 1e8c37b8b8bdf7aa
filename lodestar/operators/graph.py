"""Dependency graphs: coupling, components, feedback edges, layers, reachability, hierarchy roll-ups and forests.

Edges have edge_id, src and dst (src depends on dst); vertices have id. Whatever grows with the graph is a DataFrame. A
graph that is counted and found small is solved in one task by the textbook algorithm; a larger one by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.tables import join_large_groups, written

#: Edges up to which a graph goes to one task.
SMALL_EDGES = 1_000_000
#: Vertices up to which feedback edges are found over one set of descendants per vertex, as bits (32 MiB).
BIT_VERTICES = 1 << 14
#: Edges of a pair of nodes that a task collects at a time, about.
CHUNK_ROWS = 200_000
#: Edges that a task reduces at a time.
CHUNK_EDGES = 500_000
#: Rows of a table of vertices up to which it is broadcast.
BROADCAST_ROWS = 200_000
#: Edges of a larger component that one task takes at a time, and different sources among them.
BATCH_EDGES, BLOCK = 1_000_000, 2048
#: Of a vertex's edges that are sure to be kept, so many decide others where they lie.
NEAR = 8


def coupling(vertices: DataFrame, edges: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """id, efferent, afferent: distinct targets and sources, self-edges apart; vertices without edges count 0.

    `external` (src, reference) adds distinct references to the efferent side only.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("efferent"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("afferent"))
    joined = vertices.select("id").join(out, "id", "left").join(into, "id", "left")
    efferent = F.coalesce("efferent", F.lit(0).cast("long"))
    if external is not None:
        ext = external.select(F.col("src").alias("id"), "reference").distinct().groupBy("id").agg(F.count("*").alias("n_ext"))
        joined, efferent = joined.join(ext, "id", "left"), efferent + F.coalesce("n_ext", F.lit(0).cast("long"))
    return joined.select("id", efferent.alias("efferent"), F.coalesce("afferent", F.lit(0).cast("long")).alias("afferent"))


def merged_edges(observations: DataFrame, keys: list[str], evidence: str) -> DataFrame:
    """One edge per key with its count and its sorted distinct evidence."""
    return observations.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(evidence)).alias("evidence"))


def projected_chunks(nodes: DataFrame, edges: DataFrame, selected: list[str], rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(node, members) and (src_node, dst_node, chunk, edge_ids): the distinct edges of each pair of nodes, sorted, in chunks
    that follow one another; a pair's edges are sorted and collected by many tasks, however few pairs there are."""
    depth = len(selected)
    inside = nodes.filter(F.slice("hierarchy", 1, depth) == F.lit(selected)) if depth else nodes
    placed = written(inside.filter(F.size("hierarchy") > depth).select("id", F.array_join(F.slice("hierarchy", 1, depth + 1), "/").alias("node")))
    members = placed.groupBy("node").agg(F.count("*").alias("members"))
    ends = edges.join(placed.select(F.col("id").alias("src"), F.col("node").alias("src_node")), "src").join(placed.select(F.col("id").alias("dst"), F.col("node").alias("dst_node")), "dst")
    keys = ["src_node", "dst_node", "edge_id"]
    ends = written(ends.select(*keys))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ends.count() // rows))
    dealt = ends.repartitionByRange(parts, *keys).dropDuplicates().withColumn("chunk", F.spark_partition_id())
    return members, dealt.groupBy("src_node", "dst_node", "chunk").agg(F.sort_array(F.collect_list("edge_id")).alias("edge_ids"))


def hierarchy_projection(nodes: DataFrame, edges: DataFrame, selected: list[str]) -> tuple[DataFrame, DataFrame]:
    """The view one level below `selected`: nodes (id, hierarchy) fold to their prefix, edges are re-keyed and merged.

    Returns (node, members) and (src_node, dst_node, n, edge_ids); edges within a node are kept as its own, edges with
    an end outside the selection are left out.
    """
    members, chunks = projected_chunks(nodes, edges, selected)
    merged = chunks.groupBy("src_node", "dst_node").agg(F.sum(F.size("edge_ids")).alias("n"), F.array_sort(F.collect_list(F.struct("chunk", "edge_ids"))).alias("chunks"))
    return members, merged.select("src_node", "dst_node", "n", F.flatten("chunks.edge_ids").alias("edge_ids"))


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id) for every vertex reached from each start (column id), itself included; semi-naive rounds over all edges.

    Pairs take so little Parquet that Spark would broadcast many millions of them: rows decide, not the size of files."""
    e = edges.select("src", "dst").distinct()
    e = F.broadcast(e) if e.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else e.hint("merge")
    seen = written(starts.select(F.col("id").alias("start"), "id").distinct())
    frontier, rows = seen, seen.count()
    new = rows
    while new:
        step = frontier.join(e, frontier["id"] == e["src"]).select("start", F.col("dst").alias("id")).distinct()
        frontier = written(step.join(seen if rows <= BROADCAST_ROWS else seen.hint("merge"), ["start", "id"], "left_anti"))
        new = frontier.count()
        seen, rows = seen.unionByName(frontier), rows + new
    return seen


def reachability(edges: DataFrame, starts: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """As `reached`, for graphs with cycles: strongly connected vertices reach the same, so rounds run over components, and
    each pair of components gives the pairs of its members once. (Where too many edges are left for one task, only the
    components of one round of colouring are told; the others' vertices stand alone, which changes nothing but the work.)"""
    e, fits = _reduced_to(edges, small)
    begin = starts.select("id").filter("id is not null").distinct()
    every = begin.unionByName(e.select(F.col("src").alias("id"))).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    of = written(_components(every, e, fits, 1))
    low, high = (of.select(F.col("id").alias(k), F.col("component").alias(c)) for k, c in (("src", "a"), ("dst", "b")))
    between = written(e.join(low, "src").join(high, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    begin = written(begin.join(of, "id"))
    pairs = reached(between, begin.select(F.col("component").alias("id")).distinct())
    out = join_large_groups(begin, pairs.select(F.col("start").alias("component"), F.col("id").alias("to")), "component", "id", "to")
    out = written(out.select(F.col("id").alias("start"), "to"))
    out = join_large_groups(out, of.select("id", F.col("component").alias("to")), "to", "start", "id").select("start", "id")
    return out.unionByName(starts.filter("id is null").select(F.col("id").alias("start"), "id").distinct())


def bounded_traversal(children: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(id, depth): vertices within `depth` steps of a root, at the depth of their first visit."""
    seen = written(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(children.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id")).distinct()
        frontier = written(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def tarjan(vertices: list, out: dict) -> list[list]:
    """Strongly connected components, iteratively; members and components are sorted."""
    index, low, stack, on, found = {}, {}, [], set(), []
    for root in vertices:
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, successors = work[-1]
            for w in successors:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    found.append(sorted(part))
    return sorted(found)


def _spread(value: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ufunc, steps: int) -> bool:
    """Carries `value` along all edges a to b at once until nothing changes; whether `steps` were enough."""
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    at = b[heads]
    for _ in range(steps):
        new = least(value[at], least.reduceat(value[a], heads))
        if (new == value[at]).all():
            return True
        value[at] = new
    return False


def least_members(n: int, a: np.ndarray, b: np.ndarray, rounds: int = 4, steps: int = 40) -> np.ndarray:
    """For each vertex (numbered from 0) the least one of its strongly connected component. In rounds over all edges at once: the
    least vertex that reaches another is its colour, and what reaches a colour's own vertex within the colour is a component.
    What a few rounds leave, or paths of more than `steps` edges, goes through Tarjan's algorithm."""
    found = np.arange(n)
    for _ in range(rounds):
        a, b = a[a != b], b[a != b]
        colour = np.arange(n)
        if not len(a) or not _spread(colour, a, b, np.minimum, steps):
            break
        same = colour[a] == colour[b]
        done = np.zeros(n, bool)
        done[a] = done[b] = True  # vertices of earlier rounds have no edges left
        done &= colour == np.arange(n)
        x, y = a[same], b[same]
        if len(x) and not _spread(done, y, x, np.logical_or, steps):
            break
        found[done] = colour[done]
        left = same & ~done[a] & ~done[b]
        a, b = a[left], b[left]
    out: dict = {}
    for s, d in zip(a.tolist(), b.tolist(), strict=True):
        out.setdefault(s, []).append(d)
    for part in tarjan(list(out), out):
        found[part] = part[0]
    return found


def _reduced(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fewer edges that reach the same: a ring through each component of these edges, and what leads from one to another."""
    at, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]]))
    a, b = at[: len(pdf)], at[len(pdf) :]
    of = least_members(len(names), a, b)
    order = np.argsort(of, kind="stable")
    size = np.bincount(of, minlength=len(names))
    after = np.r_[order[1:], order[:1]]
    last = np.r_[of[order[1:]] != of[order[:-1]], True] if len(order) else np.zeros(0, bool)
    after[last] = of[order[last]]  # a component's least comes first
    ring = size[of[order]] > 1
    codes = np.unique((of[a] * len(names) + of[b])[of[a] != of[b]])
    src, dst = np.r_[order[ring], codes // max(1, len(names))], np.r_[after[ring], codes % max(1, len(names))]
    return pd.DataFrame({"src": names[src], "dst": names[dst]}).astype(pdf.dtypes[["src", "dst"]].to_dict())


def thinned(e: DataFrame, chunk: int = CHUNK_EDGES) -> DataFrame:
    """Edges (src, dst) over the same vertices that reach the same, self-edges apart: each task reduces its own, `chunk` at a time."""
    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in parts:
            held, n = [*held, pdf], n + len(pdf)
            if n >= chunk:
                one = _reduced(pd.concat(held, ignore_index=True))
                held, n = ([one], len(one)) if 2 * len(one) <= chunk else ([], 0)
                if not held:
                    yield one
        if held:
            yield _reduced(pd.concat(held, ignore_index=True))

    return e.select("src", "dst").filter("src <> dst").mapInPandas(solve, e.select("src", "dst").schema)


def _reduced_to(e: DataFrame, small: int, chunk: int = CHUNK_EDGES) -> tuple[DataFrame, bool]:
    """Edges that reach the same as the edges `e`, and whether there are `small` of them at most; reduced by all tasks where
    they lie, then by ever fewer as long as that leaves half of them or less."""
    e = written(thinned(e, chunk))
    n = e.count()
    while n > small:
        e = written(thinned(e.distinct(), chunk).distinct())
        before, n = n, e.count()
        if n > small and 2 * n > before:
            return e, False
        e = e.repartition(max(1, -(-n // small)), "src") if n > small else e
    return e, True


def strong_components(vertices: DataFrame, edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(id, component): component is the least id of the vertex's strongly connected component."""
    return _components(vertices, *_reduced_to(edges, small))


def _components(vertices: DataFrame, e: DataFrame, fits: bool, rounds: int | None = None) -> DataFrame:
    if fits:
        return _small_components(vertices, e)
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    found = _large_components(ends, e, rounds)
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _small_components(vertices: DataFrame, e: DataFrame) -> DataFrame:
    kind = vertices.schema["id"].dataType.simpleString()

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts), ignore_index=True)
        out: dict = {}
        for s, d in pdf[["src", "dst"]].itertuples(index=False):
            out.setdefault(s, []).append(d)
            out.setdefault(d, [])
        yield pd.DataFrame([(v, part[0]) for part in tarjan(sorted(out), out) for v in part], columns=["id", "component"])

    found = e.coalesce(1).mapInPandas(solve, f"id {kind}, component {kind}")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _large_components(vertices: DataFrame, e: DataFrame, rounds: int | None = None) -> DataFrame:
    """Colouring: the least id that reaches a vertex is its colour; what a colour's own vertex is reached from, within the colour, is a component.

    After `rounds`, if given, the vertices that are left stand alone."""
    left, done = written(vertices.select("id").distinct()), None
    e = written(e)
    while rounds != 0 and not left.isEmpty():
        rounds = None if rounds is None else rounds - 1
        colour = written(left.withColumn("c", F.col("id")))
        while True:
            pushed = colour.select(F.col("id").alias("src"), "c").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("p"))
            after = written(colour.join(pushed, "id", "left").select("id", F.least("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") < F.col("c")).alias("moved")))
            colour = after.select("id", "c")
            if after.filter("moved").isEmpty():
                break
        ends = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd")
        back = written(ends.select(F.col("dst").alias("at"), F.col("src").alias("id")))
        seen = written(colour.filter("id = c").select("id", "c"))
        frontier = seen
        while True:
            step = frontier.select(F.col("id").alias("at"), "c").join(back, "at").select("id", "c").distinct()
            frontier = written(step.join(seen, "id", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        found = seen.select("id", F.col("c").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = written(left.join(seen.select("id"), "id", "left_anti"))
        e = written(e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    alone = left.select("id", F.col("id").alias("component"))
    return done.unionByName(alone) if done is not None else alone


def cycle_groups(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, members, size) of components with more than one vertex or a self-edge."""
    own = edges.filter("src = dst").select(F.col("src").alias("id")).distinct().withColumn("self", F.lit(True))
    groups = components.join(own, "id", "left").groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"), F.coalesce(F.bool_or("self"), F.lit(False)).alias("self"))
    return groups.withColumn("size", F.size("members").cast("long")).filter("size > 1 or self").select("component", "members", "size")


class Descendants:
    """Which vertices (numbered from 0) each vertex reaches over the edges kept so far: a matrix of bits."""

    def __init__(self, n: int, bits: np.ndarray | None = None) -> None:
        self.bits = np.zeros((n, -(-n // 64)), np.uint64) if bits is None else bits

    def reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.bits[a, b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1) > 0

    def decided(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(closes a cycle, adds nothing) of edges a to b. Both stay true however many edges are kept later."""
        closes = (a == b) | self.reach(b, a)
        return closes, ~closes & self.reach(a, b)

    def keep(self, a: int, b: np.ndarray) -> None:
        """Edges from a to each of b, none of which reaches a."""
        more = np.bitwise_or.reduce(self.bits[b], axis=0)
        np.bitwise_or.at(more, b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
        if (more & ~self.bits[a]).any():
            above = np.flatnonzero(self.bits[:, a >> 6] >> np.uint64(a & 63) & np.uint64(1))
            self.bits[np.append(above, a)] |= more

    def greedy(self, a: np.ndarray, b: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Which edges, taken in this order, close a cycle; the others are kept.

        Edges that leave one vertex do not change what reaches it, so a run of edges with one source is judged at once.
        """
        closed = np.zeros(len(a), bool)
        for s in range(0, len(a), chunk):
            x, y = a[s : s + chunk], b[s : s + chunk]
            closes, idle = self.decided(x, y)
            closed[s : s + chunk] = closes
            left = np.flatnonzero(~(closes | idle))
            for run in np.split(left, np.flatnonzero(np.diff(x[left])) + 1) if len(left) else ():
                p, q = int(x[run[0]]), y[run]
                shut = self.reach(q, np.full(len(q), p))
                closed[s + run[shut]] = True
                if not shut.all():
                    self.keep(p, q[~shut])
        return closed

    def spare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the kept edges a to b another of them leads around: without these the rest reaches the same."""
        order = np.argsort(a, kind="stable")
        found = np.zeros(len(a), bool)
        for some in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else ():
            more = np.bitwise_or.reduce(self.bits[b[some]], axis=0)
            found[some] = more[b[some] >> 6] >> (b[some] & 63).astype(np.uint64) & np.uint64(1) > 0
        return found


def _set_bits(rows: np.ndarray, at: np.ndarray, bit: np.ndarray) -> None:
    np.bitwise_or.at(rows, (at, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))


def _has_bit(rows: np.ndarray, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return rows[at, bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1) > 0


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose of a square matrix of bits, one row of 64-bit words a vertex."""
    n = len(rows)
    plain = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")[:, :n]
    turned = np.zeros((n, rows.shape[1] * 8), np.uint8)
    turned[:, : -(-n // 8)] = np.packbits(plain.T, axis=1, bitorder="little")
    return turned.view(np.uint64)


def judged(n: int, a0: np.ndarray, b0: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a greedy pass makes of edges a to b (vertices numbered from 0 to n), after the edges a0 to b0 were kept: which close a
    cycle; and which of a0 to b0, and of a to b, can be left out since what else is kept leads around them.

    Only the vertices that edges a to b leave are told apart, as bits: one row of them for each vertex holds which it
    reaches over a0 to b0. A new edge's target reaches its source if one that it reaches does so by new edges.
    """
    block, at = np.unique(a), np.full(n, -1)
    at[block] = np.arange(len(block))
    rows = np.zeros((n, -(-len(block) // 64)), np.uint64)
    inside = at[b0] >= 0
    _set_bits(rows, a0[inside], at[b0[inside]])
    order, far = np.argsort(a0, kind="stable"), np.zeros_like(rows)  # far: reached in more than one step
    ends, first = b0[order], np.searchsorted(a0[order], np.arange(n + 1))
    for v in np.argsort(longest_paths(a0, b0, np.zeros(n, np.int64)), kind="stable"):
        if first[v] < first[v + 1]:
            far[v] = np.bitwise_or.reduce(rows[ends[first[v] : first[v + 1]]], axis=0)
            rows[v] |= far[v]
    spare0, spare, p = np.zeros(len(a0), bool), np.zeros(len(a), bool), at[a]
    spare0[inside] = _has_bit(far, a0[inside], at[b0[inside]])
    del far
    _set_bits(rows, block, at[block])
    up = _turned(rows[block])  # who of the block reaches each of the block
    closes, near = _has_bit(rows, b, p), np.flatnonzero(at[b] >= 0)
    spare[near] = _has_bit(up, at[b[near]], p[near])
    open_ = np.flatnonzero(~closes & ~spare & rows.any(axis=1)[b])
    for i in range(0, len(open_), chunk):
        some = open_[i : i + chunk]
        shut = (rows[b[some]] & up[p[some]]).any(axis=1)
        closes[some[shut]] = True
        some = some[~shut]
        known = at[b[some]] >= 0
        known[known] = _has_bit(up, at[b[some[known]]], p[some[known]])
        spare[some[known]] = True
        some = some[~known]
        for run in np.split(some, np.flatnonzero(np.diff(p[some])) + 1) if len(some) else ():
            s, ahead = p[run[0]], rows[b[run]]
            shut = (ahead & up[s]).any(axis=1)
            closes[run[shut]] = True
            if not shut.all():
                below = np.flatnonzero((up & np.bitwise_or.reduce(ahead[~shut], axis=0)).any(axis=1))
                up[below] |= up[s]
    near = near[~(closes | spare)[near]]
    direct = np.zeros_like(up)
    _set_bits(direct, p[near], at[b[near]])
    for i in range(0, len(near), chunk):
        some = near[i : i + chunk]
        between = direct[p[some]] & up[at[b[some]]]
        own = np.arange(len(some)), at[b[some]] >> 6
        between[own] &= ~(np.uint64(1) << (at[b[some]] & 63).astype(np.uint64))
        spare[some] = between.any(axis=1)
    return closes, spare0, spare


def stretches(a: np.ndarray, block: int, batch: int) -> list[int]:
    """Where to cut a row of edges so that a stretch has `batch` edges and `block` sources (of them, a) at most."""
    cuts = [0]
    while cuts[-1] < len(a):
        first = np.sort(np.unique(a[cuts[-1] : cuts[-1] + batch], return_index=True)[1])
        size = first[block] if len(first) > block else min(batch, len(a) - cuts[-1])
        cuts.append(cuts[-1] + int(size))
    return cuts


def _greedy_in_stretches(n: int, a: np.ndarray, b: np.ndarray, block: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges that close a cycle, places of kept edges that reach the same as all kept ones), edges in order."""
    closed, held = np.zeros(len(a), bool), np.zeros(0, np.int64)
    cuts = stretches(a, block, batch)
    for i, j in zip(cuts, cuts[1:]):
        now, spare0, spare = judged(n, a[held], b[held], a[i:j], b[i:j])
        closed[i:j] = now
        held = np.concatenate([held[~spare0], i + np.flatnonzero(~now & ~spare)])
    return closed, held


def feedback_edges(components: DataFrame, edges: DataFrame, small: int = SMALL_EDGES, bit_vertices: int = BIT_VERTICES, batch: int = BATCH_EDGES) -> DataFrame:
    """edge_id of the edges that a greedy pass in edge_id order leaves out of each component so that the rest is acyclic."""
    return greedy_pass(components, edges, small, bit_vertices, batch).filter("closes").select("edge_id")


def skeleton(components: DataFrame, edges: DataFrame, passed: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) with the same layers as all edges but the feedback ones: those between components, and those
    that the pass has retained. (A vertex's layer comes by its longest path, which never takes an edge that another path leads around.)"""
    between = with_components(components, edges).filter("cs <> cd").select("src", "dst")
    return between.unionByName(passed.filter("not closes").select("src", "dst")).distinct()


def with_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the components of their ends, which are broadcast if they are few."""
    few = F.broadcast if components.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    low, high = (few(components.select(F.col("id").alias(k), F.col("component").alias(c))) for k, c in (("src", "cs"), ("dst", "cd")))
    return edges.join(low, "src").join(high, "dst")


def greedy_pass(components: DataFrame, edges: DataFrame, small: int = SMALL_EDGES, bit_vertices: int = BIT_VERTICES, batch: int = BATCH_EDGES) -> DataFrame:
    """(edge_id, src, dst, closes): the edges within components that a greedy pass in edge_id order leaves out, and of those that it
    keeps enough to reach the same; written.

    Components of at most `small` edges are solved in parallel, one task each. Of larger ones most edges are decided where they lie
    (see `_sorted_out`); if more than `small` are left, they are cut into stretches
    of `batch` edges and of `bit_vertices` / 2 and BLOCK sources at most, one round each for all components: a task gets a stretch and
    what reaches the same as all that was kept before (see `judged`). An edge is kept for certain if its target has no edges of its
    own until a later stretch; it waits for that one, so that no task gets it twice. Where edges of few vertices
    (`bit_vertices`) change their sources so often that there would be many more stretches than batches, batches go over a matrix of bits.
    Edges and components are read several times: written ones, best.
    """
    kind, end = (edges.schema[c].dataType.simpleString() for c in ("edge_id", "src"))
    out = f"edge_id {kind}, src {end}, dst {end}, closes boolean"
    block = max(1, min(BLOCK, bit_vertices // 2))
    inner = with_components(components, edges).filter("cs = cd").select("cs", "edge_id", "src", "dst")
    sources = written(inner.groupBy("cs", F.col("src").alias("id")).agg(F.min("edge_id").alias("first"), F.count("*").alias("n")))
    giant = _giants(sources, small)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("edge_id")
        at, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]]))
        a, b = at[: len(pdf)], at[len(pdf) :]
        if len(names) <= bit_vertices and (np.diff(a) != 0).sum() > 4 * len(names):  # sources in no order
            own = Descendants(len(names))
            closed = own.greedy(a, b)
            held = np.flatnonzero(~closed)
            held = held[~own.spare(a[held], b[held])]
        else:
            closed, held = _greedy_in_stretches(len(names), a, b, block, batch)
        told = closed.copy()
        told[held] = True
        return pdf[["edge_id", "src", "dst"]].assign(closes=closed)[told]

    if giant.isEmpty():
        return written(inner.groupBy("cs").applyInPandas(solve, out))
    marked = _sorted_out(components, edges, sources, giant)
    inner, closed = marked.filter("not closes").drop("closes"), marked.filter("closes").drop("cs")
    giant = _giants(written(inner.groupBy("cs").agg(F.count("*").alias("n"))), small)
    found = written(inner.join(F.broadcast(giant), "cs", "left_anti").groupBy("cs").applyInPandas(solve, out)).unionByName(closed)
    if giant.isEmpty():
        return found
    rest = written(inner.join(F.broadcast(giant), "cs"))
    dealt, rounds, parts = _in_rounds(rest, block, batch)
    ends = rest.select(F.col("src").alias("id")).unionByName(rest.select(F.col("dst").alias("id"))).distinct()
    if rounds > bit_vertices // block + 2 * parts and (ends := written(ends)).limit(bit_vertices + 1).count() <= bit_vertices:
        more = _batched_over_bits(rest.select("edge_id", "src", "dst"), ends, batch, kind)
    else:
        more = _by_rounds(dealt, rounds, out)
    for part in more:
        found = found.unionByName(part)
    return found


def _giants(sizes: DataFrame, small: int) -> DataFrame:
    """Components (cs) of more than `small` edges (n): fewer than edges / small of them."""
    return sizes.groupBy("cs").agg(F.sum("n").alias("n")).filter(F.col("n") > small).select("cs")


def _sorted_out(components: DataFrame, edges: DataFrame, sources: DataFrame, giant: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(cs, edge_id, src, dst, closes): the edges within components that close a cycle for certain (closes), and those that a greedy
    pass still has to go over in order, which then closes the same others and reaches the same as one over all edges; written.

    `sources` (cs, id, first, n) has each vertex's first edge. An edge that comes before the first one of its target can't close a
    cycle. All cycles go through the target's own edges, so the pass may take such an edge at any time up to the first of these;
    hence ids rise along any path of such edges, and the pass has all of the path before it comes to an edge of the path's end. Up to NEAR
    of each vertex's are retained, and what their paths prove (see `_along_a_path`) decides edges anywhere: an edge back to where
    a path begins closes a cycle, and another one that can't close any, but has a path around it, is not needed.
    Components with more than `most` vertices are left as they are.
    """
    count = Window.partitionBy("cs")
    own = sources.join(F.broadcast(giant), "cs").withColumn("m", F.count("*").over(count)).filter(F.col("m") <= most)
    own = written(own.select("cs", "id", "first", F.row_number().over(count.orderBy("first", "id")).alias("rank")))
    at = components.select("id", F.col("component").alias("cs")).join(own, ["cs", "id"], "left")
    low, high = at.select(F.col("id").alias("src"), "cs", F.col("rank").alias("a")), at.select(F.col("id").alias("dst"), F.col("cs").alias("cd"), "first", F.col("rank").alias("b"))
    few = F.broadcast if components.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    sure = edges.join(few(high), "dst").filter("edge_id < first").join(few(low), "src").filter("cs = cd and a < b")
    near = sure.groupBy("cs", "a", F.pmod("b", F.lit(NEAR)).alias("k")).agg(F.min("b").alias("b"))
    proofs = near.groupBy("cs").applyInPandas(lambda pdf: _along_a_path(pdf), f"cs {components.schema['component'].dataType.simpleString()}, rank int, leads int, led int, near array<int>")
    at = written(components.select("id", F.col("component").alias("cs")).join(own.join(proofs, ["cs", "rank"], "left"), ["cs", "id"], "left"))
    low, high = at.select(F.col("id").alias("src"), "cs", F.col("leads").alias("ls"), F.col("led").alias("es"), "near"), at.select(F.col("id").alias("dst"), F.col("cs").alias("cd"), "first", "rank", F.col("leads").alias("ld"), F.col("led").alias("ed"))
    inner = edges.join(few(low), "src").join(few(high), "dst").filter("cs = cd")
    closes = F.coalesce(F.expr("src = dst or ld <= es"), F.lit(False))
    spare = F.coalesce(F.expr("edge_id < first and ls <= ed and not array_contains(near, rank)"), F.lit(False))
    return written(inner.select("cs", "edge_id", "src", "dst", closes.alias("closes"), spare.alias("spare")).filter("closes or not spare").drop("spare"))


def _along_a_path(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each vertex of the edges a to b, a < b, of a component (cs), by its rank: the first place on a longest path that it leads to (`leads`),
    the last that it is led to from (`led`), itself included, null if there is none; and the b of its edges (`near`).
    So there is a path from x to y if x leads to a place up to the one that y is led to from."""
    ranks, at = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
    a, b = at[: len(pdf)].tolist(), at[len(pdf) :].tolist()
    out: list[list[int]] = [[] for _ in ranks]
    for x, y in zip(a, b, strict=True):
        out[x].append(y)
    high = [0] * len(ranks)
    for x in range(len(ranks) - 1, -1, -1):
        high[x] = max((high[y] + 1 for y in out[x]), default=0)
    place, x, far = {}, int(np.argmax(high)), len(ranks)
    while x not in place:
        place[x] = len(place)
        x = max(out[x], key=high.__getitem__, default=x)
    leads, led = [place.get(x, far) for x in range(far)], [place.get(x, -1) for x in range(far)]
    for x in range(far - 1, -1, -1):
        for y in out[x]:
            leads[x] = min(leads[x], leads[y])
    for x in range(far):
        for y in out[x]:
            led[y] = max(led[y], led[x])
    none = lambda some, null: pd.Series(some, dtype="Int32").mask(np.array(some) == null)
    return pd.DataFrame({"cs": pdf["cs"].iloc[0], "rank": ranks, "leads": none(leads, far), "led": none(led, -1), "near": [ranks[y].tolist() for y in out]})


def _in_rounds(rest: DataFrame, block: int, batch: int) -> tuple[DataFrame, int, int]:
    """Edges (cs, edge_id, src, dst, given, round), and numbers of rounds and of tasks: each edge in the round that judges it, or
    first has to know that it was kept (given)."""
    spark = rest.sparkSession
    parts = max(1, -(-rest.count() // batch))

    def cut(some: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(some)
        if held:
            for _, pdf in pd.concat(held, ignore_index=True).groupby("cs", sort=False):
                pdf = pdf.sort_values("edge_id")
                cuts = stretches(pd.factorize(pdf["src"])[0], block, batch)
                yield pdf.assign(stretch=np.repeat(pdf["edge_id"].to_numpy()[cuts[:-1]], np.diff(cuts)))

    kind = rest.schema["edge_id"].dataType
    named = written(rest.repartitionByRange(parts, "cs", "edge_id").mapInPandas(cut, rest.select("cs", "edge_id", "src", "dst", F.col("edge_id").cast(kind).alias("stretch")).schema))
    numbers = written(named.select("cs", "stretch").distinct().withColumn("round", F.row_number().over(Window.partitionBy("cs").orderBy("stretch"))))
    few = F.broadcast(numbers)  # a row for `batch` edges or `block` sources
    start = written(named.groupBy("cs", F.col("src").alias("dst")).agg(F.min("stretch").alias("stretch")).join(few, ["cs", "stretch"]).select("cs", "dst", F.col("round").alias("start")))
    dealt = named.join(few, ["cs", "stretch"]).join(start, ["cs", "dst"], "left")
    dealt = dealt.select("cs", "edge_id", "src", "dst", F.coalesce(F.col("start") > F.col("round"), F.lit(False)).alias("given"), F.greatest("round", "start").alias("round"))
    rounds = numbers.agg(F.max("round")).head()[0]
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartitionByRange(max(shares, min(rounds, parts)), "round", F.xxhash64("edge_id")).sortWithinPartitions("round"), rounds, parts


def _by_rounds(dealt: DataFrame, rounds: int, out: str) -> list[DataFrame]:
    """The written parts of the pass over `dealt` (see _in_rounds): what closes cycles by rounds, and at last what is retained."""
    dealt, held, found = written(dealt), None, []

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        at, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]]))
        a, b = at[: len(pdf)], at[len(pdf) :]
        given = pdf["given"].to_numpy(bool)
        old, new = np.flatnonzero(given), np.flatnonzero(~given)
        new = new[np.argsort(pdf["edge_id"].to_numpy()[new], kind="stable")]
        closes, spare0, spare = judged(len(names), a[old], b[old], a[new], b[new])
        told = np.concatenate([new[closes], old[~spare0], new[~closes & ~spare]])
        return pdf.iloc[told][["cs", "edge_id", "src", "dst"]].assign(closes=np.arange(len(told)) < closes.sum())

    for k in range(1, rounds + 1):
        now = dealt.filter(F.col("round") == k).drop("round")
        if held is not None:
            now = now.unionByName(held)
        schema = now.drop("given").withColumn("closes", F.lit(False)).schema
        solved = written(now.groupBy("cs").applyInPandas(solve, schema))
        found.append(solved.filter("closes").drop("cs"))
        held = solved.filter("not closes").withColumn("given", F.lit(True)).drop("closes")
    return [*found, held.withColumn("closes", F.lit(False)).select("edge_id", "src", "dst", "closes")]


def _batched_over_bits(rest: DataFrame, ends: DataFrame, batch: int, kind: str) -> list[DataFrame]:
    """The pass over the edges of `rest`, as written parts; all its vertices have a row in one matrix of bits."""
    spark, end = rest.sparkSession, rest.schema["src"].dataType.simpleString()
    names = pd.Index(sorted(r[0] for r in ends.collect()))  # bit_vertices at most
    known, found = Descendants(len(names)), []
    while True:
        sent = spark.sparkContext.broadcast(known)

        def sort_out(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                closes, idle = sent.value.decided(names.get_indexer(pdf["src"]), names.get_indexer(pdf["dst"]))
                yield pdf.assign(closes=closes)[~idle]

        def solve(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            some = list(parts)
            if not some:
                return
            pdf = pd.concat(some, ignore_index=True).sort_values("edge_id")
            own = Descendants(len(names), sent.value.bits.copy())
            a, b = names.get_indexer(pdf["src"]), names.get_indexer(pdf["dst"])
            closed = own.greedy(a, b)
            held = np.flatnonzero(~closed)
            told = closed.copy()
            told[held[~own.spare(a[held], b[held])]] = True
            yield pdf[["edge_id", "src", "dst"]].assign(closes=closed, bits=None)[told]
            yield pd.DataFrame({"edge_id": pdf["edge_id"].tail(1), "src": None, "dst": None, "closes": False, "bits": [own.bits.tobytes()]})

        sorted_out = written(rest.mapInPandas(sort_out, rest.withColumn("closes", F.lit(False)).schema))
        found.append(sorted_out.filter("closes"))
        rest = sorted_out.filter("not closes").drop("closes")
        first = rest.orderBy("edge_id").limit(batch)
        solved = written(first.coalesce(1).mapInPandas(solve, f"edge_id {kind}, src {end}, dst {end}, closes boolean, bits binary"))
        found.append(solved.filter("bits is null").drop("bits"))
        upto, bits = solved.agg(F.max("edge_id"), F.max("bits")).head()
        if bits is None:
            return found
        known = Descendants(len(names), np.frombuffer(bits, np.uint64).reshape(known.bits.shape))
        rest = rest.filter(F.col("edge_id") > F.lit(upto))


def _small_layers(vertices: DataFrame, e: DataFrame) -> DataFrame:
    kind = vertices.schema["id"].dataType.simpleString()

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, into, layer = {}, {}, {}
        for pdf in parts:
            for s, d in pdf[["src", "dst"]].itertuples(index=False):
                left[s] = left.get(s, 0) + 1
                into.setdefault(d, []).append(s)
        todo = [d for d in into if d not in left]
        layer = dict.fromkeys(todo, 0)
        while todo:
            d = todo.pop()
            for s in into.get(d, ()):
                layer[s] = max(layer.get(s, 0), layer[d] + 1)
                left[s] -= 1
                if not left[s]:
                    todo.append(s)
        if any(left.values()):
            raise ValueError("edges without their feedback edges hold a cycle")
        yield pd.DataFrame({"id": list(layer), "layer": list(layer.values())})

    found = e.coalesce(1).mapInPandas(solve, f"id {kind}, layer int")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("layer", F.lit(0)).alias("layer"))


def longest_paths(a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Layers of an acyclic graph of edges a to b (vertices numbered from 0): above all their targets', and `low` at least."""
    n, order = len(low), np.argsort(b, kind="stable")
    into, first = a[order], np.searchsorted(b[order], np.arange(n + 1))
    left, layer, done = np.bincount(a, minlength=n), low.copy(), 0
    todo = np.flatnonzero(left == 0)
    while len(todo):
        done += len(todo)
        counts = first[todo + 1] - first[todo]
        s = into[np.repeat(first[todo] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        np.maximum.at(layer, s, np.repeat(layer[todo], counts) + 1)
        np.subtract.at(left, s, 1)
        s = np.unique(s)
        todo = s[left[s] == 0]
    if done < n:
        raise ValueError("edges without their feedback edges hold a cycle")
    return layer


def _large_layers(vertices: DataFrame, e: DataFrame, small: int) -> DataFrame:
    """Rounds over ranges of at most about `small` edges in order of the layers found so far: a task carries layers along
    all paths within its range, so a round lifts a vertex over many edges, not over one, and ranges follow the paths
    better with each round. Layers only rise and every edge is looked at in each round: when none rises, all are right."""
    kind = vertices.schema["id"].dataType.simpleString()
    parts = -(-e.count() // max(1, small))
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    layer = written(ends.withColumn("layer", F.lit(0)))
    n = layer.count()

    def solve(some: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(some) or [pd.DataFrame(columns=["src", "dst", "ls", "ld"])], ignore_index=True)
        if pdf.empty:
            return
        at, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]]))
        low = np.zeros(len(names), np.int64)
        low[at] = np.concatenate([pdf["ls"], pdf["ld"]])
        found = longest_paths(at[: len(pdf)], at[len(pdf) :], low)
        yield pd.DataFrame({"id": names[found > low], "to": found[found > low]})

    while True:
        known = e.join(layer.select(F.col("id").alias("src"), F.col("layer").alias("ls")), "src").join(layer.select(F.col("id").alias("dst"), F.col("layer").alias("ld")), "dst")
        dealt = known.select("src", "dst", "ls", "ld").repartitionByRange(parts, "ls", "src", "dst")
        up = written(dealt.mapInPandas(solve, f"id {kind}, to int").groupBy("id").agg(F.max("to").alias("to")))
        highest = up.agg(F.max("to")).head()[0]
        if highest is None:
            return vertices.select("id").join(layer, "id", "left").select("id", F.coalesce("layer", F.lit(0)).alias("layer"))
        if highest >= n:
            raise ValueError("edges without their feedback edges hold a cycle")
        layer = written(layer.join(up, "id", "left").select("id", F.coalesce("to", "layer").alias("layer")))


def dependency_layers(vertices: DataFrame, edges: DataFrame, feedback: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(id, layer): 0 without outgoing edges, else one more than the highest target; feedback edges do not count."""
    return acyclic_layers(vertices, edges.join(feedback.select("edge_id"), "edge_id", "left_anti").filter("src <> dst").select("src", "dst").distinct(), small)


def acyclic_layers(vertices: DataFrame, edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(id, layer) as dependency_layers, over edges (src, dst) that hold no cycle."""
    e = written(edges)
    if e.limit(small + 1).count() <= small:
        return _small_layers(vertices, e)
    return _large_layers(vertices, e, small)


def layered_layout(layers: DataFrame, label: str, dx: int = 240, dy: int = 96) -> DataFrame:
    """x by the layer's ordinal, y by the order (label, id) within it; ranks run per layer, over distinct layers alone."""
    ordinal = layers.select("layer").distinct().withColumn("column", F.dense_rank().over(Window.orderBy("layer")) - 1)
    y = F.row_number().over(Window.partitionBy("layer").orderBy(label, "id")) - 1
    return layers.join(F.broadcast(ordinal), "layer").select("id", "layer", (F.col("column") * dx).alias("x"), (y * dy).alias("y"))


def parents_without_cycles(parents: DataFrame) -> DataFrame:
    """(child, parent) of a functional graph without the edges of cycle members; branches below a cycle stay.

    Pointer doubling: after enough rounds every pointer ends in the cycle it leads to, and all of the cycle is marked.
    """
    jump = written(parents.select("child", F.col("parent").alias("to")))
    n, steps = max(1, parents.count()), 0
    while 1 << steps < n:
        step = jump.select(F.col("child").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(step, "to").select("child", F.col("far").alias("to")))
        steps += 1
    mark = written(jump.select(F.col("to").alias("child")).distinct().join(parents.select("child"), "child", "left_semi"))
    frontier = mark
    while not frontier.isEmpty():
        step = frontier.join(parents, "child").select(F.col("parent").alias("child")).distinct().join(parents.select("child"), "child", "left_semi")
        frontier = written(step.join(mark, "child", "left_anti"))
        mark = mark.unionByName(frontier)
    return parents.join(mark, "child", "left_anti")


def paths_to_roots(parents: DataFrame) -> DataFrame:
    """(id, path): ancestors from the root to the vertex, itself last. A path that would meet one of its own vertices again
    ends there, so a cycle ends too."""
    at = written(parents.select(F.col("child").alias("id"), F.col("parent").alias("top"), F.array("parent", "child").alias("path")))
    up = parents.select(F.col("child").alias("top"), F.col("parent").alias("next"))
    done = None
    while True:
        stepped = written(at.join(up, "top", "left").withColumn("next", F.when(~F.array_contains("path", F.col("next")), F.col("next"))))
        ended = stepped.filter("next is null").select("id", "path")
        done = ended if done is None else done.unionByName(ended)
        at = stepped.filter("next is not null").select("id", F.col("next").alias("top"), F.concat(F.array("next"), "path").alias("path"))
        if at.isEmpty():
            break
    roots = parents.select(F.col("parent").alias("id")).distinct().join(parents.select(F.col("child").alias("id")), "id", "left_anti")
    return done.unionByName(roots.select("id", F.array("id").alias("path")))
