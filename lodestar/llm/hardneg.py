"""Hard negatives by exact dual-tree search over anchors and candidates.

Both sides of a cell (a block of candidates and a part of the anchors) become trees: nodes of rows near each other, each
with the box and the ball that hold its vectors. For a pair of nodes these give an interval that holds every inner
product between them. A pair whose interval cannot matter to any anchor of its node is dropped with everything below it;
what remains comes down to pairs of leaves, which are scored exactly. What matters: for positives an upper end that
reaches some anchor's k-th best score so far; for negatives an interval that meets the range allowed by some positive and
reaches the last of those found for it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import Table, heavy_keys, join_heavy

#: Rows of a block of candidates and of a part of the anchors; rows of a leaf of either tree.
CANDIDATES, ANCHORS, LEAF, ANCHOR_LEAF = 8192, 1024, 256, 32
#: From this size on sums of products are not exact in doubles: no pair is dropped, and products are taken in whole
#: numbers of any size and held to 64 bits.
WIDE, LONG = 1 << 52, (1 << 63) - 1


class Tree:
    """Rows in the order of a tree of halves: by label first, then at the median of the widest component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int) -> None:
        order = np.argsort(labels, kind="stable")
        self.start, self.end, self.child = [0], [len(ids)], [(-1, -1)]
        at = 0
        while at < len(self.start):  # children come after their parent
            s, e = self.start[at], self.end[at]
            rows = order[s:e]
            first, last = labels[rows[0]], labels[rows[-1]]
            if first != last:  # at the change of label nearest to the middle
                cuts = s + 1 + np.flatnonzero(np.diff(labels[rows]))
                mid = int(cuts[np.argmin(np.abs(cuts - (s + e) // 2))])
            elif e - s > leaf:
                x = vectors[rows]
                wide = np.argmax(x.max(axis=0).astype(float) - x.min(axis=0))
                order[s:e] = rows[np.argsort(x[:, wide], kind="stable")]
                mid = (s + e) // 2
            else:
                at += 1
                continue
            self.child[at] = (len(self.start), len(self.start) + 1)
            self.start += [s, mid]
            self.end += [mid, e]
            self.child += [(-1, -1)] * 2
            at += 1
        self.order, self.ids, self.labels, self.v = order, ids[order], labels[order], vectors[order]
        self.x = self.v.astype(float)
        spans = list(zip(self.start, self.end, strict=True))
        self.low = np.array([self.x[s:e].min(axis=0) for s, e in spans])
        self.high = np.array([self.x[s:e].max(axis=0) for s, e in spans])
        self.centre = (self.low + self.high) / 2
        self.radius = np.array([np.sqrt(((self.x[s:e] - c) ** 2).sum(axis=1).max()) for (s, e), c in zip(spans, self.centre, strict=True)])
        self.far = np.sqrt((self.centre**2).sum(axis=1))

    def one_label(self, node: int) -> int | None:
        """The label of all rows of a node, if there is one."""
        first, last = self.labels[self.start[node]], self.labels[self.end[node] - 1]
        return int(first) if first == last else None


class Pair:
    """Two trees, and how large their products can be."""

    def __init__(self, anchors: Tree, candidates: Tree) -> None:
        self.a, self.c = anchors, candidates
        self.size = float(np.abs(anchors.x).max(initial=0)) * float(np.abs(candidates.x).max(initial=0)) * anchors.x.shape[1]
        self.wide = not self.size < WIDE
        self.scored = self.dropped = 0

    def interval(self, i: int, j: int) -> tuple[float, float]:
        """Ends that hold every product of rows below node i with rows below node j."""
        if self.wide:
            return -np.inf, np.inf
        a, c = self.a, self.c
        corners = np.stack([a.low[i] * c.low[j], a.low[i] * c.high[j], a.high[i] * c.low[j], a.high[i] * c.high[j]])
        middle = float(a.centre[i] @ c.centre[j])
        reach = float(a.far[i] * c.radius[j] + c.far[j] * a.radius[i] + a.radius[i] * c.radius[j]) * (1 + 1e-9) + 1e-9
        return max(float(corners.min(axis=0).sum()), middle - reach), min(float(corners.max(axis=0).sum()), middle + reach)

    def products(self, s: int, e: int, x: int, y: int) -> np.ndarray:
        if not self.wide:
            return (self.a.x[s:e] @ self.c.x[x:y].T).astype(np.int64)
        whole = self.a.v[s:e].astype(object) @ self.c.v[x:y].astype(object).T
        return np.clip(whole, -LONG - 1, LONG).astype(np.int64)

    def search(self, matters: Callable[[int, int, float, float], bool], score: Callable[[int, int, int, int, np.ndarray], None]) -> None:
        """Visits the pairs of leaves that matter, always the pair of the highest upper end next."""
        low, high = self.interval(0, 0)
        heap = [(-high, 0, 0, low)]
        a, c = self.a, self.c
        while heap:
            high, i, j, low = heapq.heappop(heap)
            high = -high
            if not matters(i, j, low, high):
                self.dropped += (a.end[i] - a.start[i]) * (c.end[j] - c.start[j])
                continue
            left, right = a.child[i][0] >= 0, c.child[j][0] >= 0
            if not (left or right):
                s, e, x, y = a.start[i], a.end[i], c.start[j], c.end[j]
                self.scored += (e - s) * (y - x)
                score(s, e, x, y, self.products(s, e, x, y))
                continue
            if left and (not right or (a.end[i] - a.start[i]) * LEAF > (c.end[j] - c.start[j]) * ANCHOR_LEAF):
                below = [(k, j) for k in a.child[i]]
            else:
                below = [(i, k) for k in c.child[j]]
            for p, q in below:
                low, high = self.interval(p, q)
                heapq.heappush(heap, (-high, p, q, low))


class Best:
    """The k best (score, id) of each of n searches: scores fall, ids rise among equals; `count` of them are there."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score, self.id, self.count = np.full((n, k), -LONG - 1), np.full((n, k), LONG), np.zeros(n, np.int64)
        self.bar = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, good: np.ndarray) -> None:
        """Scores of the rows (searches) with the candidates `ids`, where `good`."""
        good = good & (score >= self.score[rows, -1][:, None])
        some = good.any(axis=1)
        if not some.any():
            return
        rows, score, good = rows[some], score[some], good[some]
        s = np.concatenate([self.score[rows], np.where(good, score, -LONG - 1)], axis=1)
        d = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        empty = np.concatenate([np.arange(self.k) >= self.count[rows][:, None], ~good], axis=1)
        at = np.lexsort((d, ~s, empty), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, at, axis=1), np.take_along_axis(d, at, axis=1)
        self.count[rows] = np.minimum(self.k, self.count[rows] + good.sum(axis=1))
        self.bar[rows] = np.where(self.count[rows] == self.k, self.score[rows, -1].astype(float), -np.inf)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, id, score) of all that are there."""
        there = np.arange(self.k) < self.count[:, None]
        return np.nonzero(there)[0], self.id[there], self.score[there]


def best_positives(pair: Pair, k: int) -> Best:
    """Of every anchor the k candidates of highest product, rows with its own id apart. All are of one label."""
    a, c = pair.a, pair.c
    best = Best(len(a.ids), k)

    def matters(i: int, j: int, low: float, high: float) -> bool:
        return high >= best.bar[a.start[i] : a.end[i]].min()

    def score(s: int, e: int, x: int, y: int, p: np.ndarray) -> None:
        best.add(np.arange(s, e), p, c.ids[x:y], a.ids[s:e, None] != c.ids[None, x:y])

    pair.search(matters, score)
    return best


def best_negatives(pair: Pair, low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """Of every anchor and positive the k candidates of another label with the highest products in [low, high].

    low and high have a row for each anchor, in the order of its tree, and a column for each positive; where there is no
    positive, low > high. Search i * columns + p of the result is anchor i with positive p.
    """
    a, c = pair.a, pair.c
    best, m = Best(low.size, k), low.shape[1]
    lo, hi = low.astype(float), high.astype(float)  # rounding is at most half a unit in the last place
    if pair.wide:
        lo, hi = np.where(low > high, np.inf, -np.inf), np.where(low > high, -np.inf, np.inf)

    def matters(i: int, j: int, least: float, most: float) -> bool:
        label = c.one_label(j)
        if label is not None and label == a.one_label(i):
            return False
        s, e = a.start[i], a.end[i]
        return bool(((lo[s:e] <= most) & (hi[s:e] >= least) & (best.bar[s * m : e * m].reshape(-1, m) <= most)).any())

    def score(s: int, e: int, x: int, y: int, p: np.ndarray) -> None:
        other = a.labels[s:e, None] != c.labels[None, x:y]
        for q in range(m):
            best.add(np.arange(s, e) * m + q, p, c.ids[x:y], other & (p >= low[s:e, q, None]) & (p <= high[s:e, q, None]))

    pair.search(matters, score)
    return best


def percent(score: np.ndarray, share: int, up: bool) -> np.ndarray:
    """score * share / 100, rounded up or down, without leaving 64 bits; `share` is 0 to 100."""
    whole, rest = score // 100, score % 100
    return whole * share + (-(-rest * share // 100) if up else rest * share // 100)


def labelled(vectors: DataFrame, relabel_every: int | None, labels: int, scale: int) -> DataFrame:
    """vec_id, label, d, v (floor(scale * x) of each component): a row per vec_id, the least label and vector where it repeats."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    x = x.filter("vec_id is not null and label is not null and size(x) > 0 and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    if relabel_every:
        x = x.withColumn("label", F.when(F.pmod("vec_id", F.lit(relabel_every)) == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")))
    v = x.select("vec_id", F.struct("label", F.transform("x", lambda e: F.floor(e * scale)).alias("v")).alias("row"))
    return v.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", F.size("row.v").alias("d"), "row.v")


def dealt(rows: DataFrame, anchors: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Candidates and anchors dealt out to cells: every block of candidates meets every part of the anchors of its keys."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(anchors.groupBy(*keys).agg(F.count("*").alias("asked")), keys)
    sizes = Table(sizes.select(*keys, "n", F.ceil(F.col("n") / CANDIDATES).alias("blocks"), F.ceil(F.col("asked") / ANCHORS).alias("parts")), name)

    def sized(df: DataFrame) -> DataFrame:
        small = sizes.bytes <= 4 << 20
        return df.join(F.broadcast(sizes.df.drop("n")), keys) if small else join_heavy(df, sizes.df.drop("n"), keys, heavy_keys(sizes.df, keys, "n"), "vec_id")

    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), n)
    there = sized(rows).select(*keys, of("blocks").alias("block"), up_to("parts").alias("part"), F.lit(False).alias("asks"), *[c for c in rows.columns if c not in keys], F.expr("cast(null as array<struct<id:long,score:long>>)").alias("positives"))
    own = anchors if "positives" in anchors.columns else anchors.withColumn("positives", F.expr("cast(null as array<struct<id:long,score:long>>)"))
    asking = sized(own).select(*keys, up_to("blocks").alias("block"), of("parts").alias("part"), F.lit(True).alias("asks"), *[c for c in there.columns if c not in (*keys, "block", "part", "asks")])
    return there.unionByName(asking)


def trees(t: pa.Table) -> tuple[Pair, pa.Array] | None:
    """The two trees of a cell, and the positives of the anchors in the order of their tree; None if a side is empty."""
    t = t.combine_chunks()
    asks, ids, labels = (t[c].to_numpy() for c in ("asks", "vec_id", "label"))
    if asks.all() or not asks.any():
        return None
    v = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    anchors = Tree(ids[asks], labels[asks], v[asks], ANCHOR_LEAF)
    positives = t["positives"].combine_chunks().filter(pa.array(asks)).take(pa.array(anchors.order))
    return Pair(anchors, Tree(ids[~asks], labels[~asks], v[~asks], LEAF)), positives


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, relabel_every: int | None = None, labels: int = 10, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: negatives near each anchor's positives.

    `vectors` has vec_id, label and embedding; anchors are the rows whose vec_id is divisible by `every`. A score is the
    integer inner product with the anchor of components floor(scale * x); higher scores come first, ties go to the smaller
    vec_id. An anchor's positives are its first other rows of the same label. Its negatives for a positive are the first
    rows of other labels that score from `least` to `most` percent of the positive's score; a negative score allows none,
    and fewer than asked for give all. Where vec_id is divisible by `relabel_every`, the label is taken as (label + 1)
    modulo `labels`.

    Rows without vec_id, label or vector, with an empty vector or with null or non-finite components take no part; where a
    vec_id repeats, its least label and vector count. Vectors of different lengths meet only their like. Components and
    products beyond 64 bits count as the nearest number of 64 bits. An empty table gives no rows; other columns are ignored.
    """
    rows = Table(labelled(vectors, relabel_every, labels, scale), "vectors").df
    anchors = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    near = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def first_cell(t: pa.Table) -> pa.Table:
        made = trees(t)
        if made is None:
            return near.empty_table()
        at, ids, score = best_positives(made[0], positives).found()
        return pa.table([pa.array(made[0].a.ids[at]), pa.array(ids), pa.array(score)], schema=near)

    found = dealt(rows, anchors, ["label", "d"], "labels").groupBy("label", "d", "block", "part").applyInArrow(first_cell, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pos = Table(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "positives")
    lists = pos.df.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))  # `positives` of them at most
    asking = anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "d", "v", F.transform("p", lambda x: F.struct(x["positive_id"].alias("id"), x["positive_score"].alias("score"))).alias("positives"))
    asking = Table(asking, "anchors").df
    hard = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def second_cell(t: pa.Table) -> pa.Table:
        made = trees(t)
        if made is None:
            return hard.empty_table()
        pair, lists_ = made
        sizes = np.asarray(lists_.value_lengths())
        flat = lists_.flatten()
        i, q = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids, score = (flat.field(c).to_numpy() for c in (0, 1))
        low, high, of = np.ones((len(sizes), positives), np.int64), np.zeros((len(sizes), positives), np.int64), np.zeros((len(sizes), positives, 2), np.int64)
        low[i, q], high[i, q] = percent(score, least, True), percent(score, most, False)
        of[i, q, 0], of[i, q, 1] = ids, score
        at, ids, score = best_negatives(pair, low, high, negatives).found()
        mine = of[at // positives, at % positives]
        return pa.table([pa.array(pair.a.ids[at // positives]), pa.array(mine[:, 0]), pa.array(ids), pa.array(mine[:, 1]), pa.array(score)], schema=hard)

    got = dealt(rows, asking, ["d"], "lengths").groupBy("d", "block", "part").applyInArrow(second_cell, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
