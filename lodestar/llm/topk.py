"""Exact top-k inner products by aggregation without random access.

The candidates come in blocks. For a block, every dimension has its list of (value, row) in order; a query reads the lists
from the end that suits the sign of its component, in steps. What it has read gives every row a lower and an upper
bound: values not yet read lie between the last value read and the far end of the list. Reading stops when at most a
few rows have an upper bound that reaches the k-th best lower bound; their scores are then resolved exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import Table

#: Rows of a block of candidates, and of a block of queries.
CANDIDATES, QUERIES = 8192, 1024
#: Rows whose scores are resolved at the end of reading, for each k.
RESOLVED = 16
#: Products whose size may reach WIDE are taken in whole numbers of any size and held to LONG, the largest of 64 bits.
WIDE, LONG = 1 << 62, (1 << 63) - 1


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): v is floor(scale * x) of each component; vectors that are null, empty or not finite are left out."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    x = x.filter("vec_id is not null and size(x) > 0 and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    return x.select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


class SortedLists:
    """A block of vectors as one ordered list per dimension.

    A list is kept as the rank of every row in it, so "read so far" is a comparison of ranks with a depth, and the sums
    over what is read are matrix products. Depths are tried in growing steps, from the depth at which the last query of
    the block could stop.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[by_id], vectors[by_id]
        order = np.argsort(self.v, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.v, order, axis=0)  # depth x dimension
        self.rank = np.empty(self.v.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.largest = max(int(self.v.max(initial=0)), -int(self.v.min(initial=0)))
        self.floats: dict[type, np.ndarray] = {}
        self.depth = len(ids) // 2

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of this block, the query's own row apart."""
        n = len(self.ids)
        rows = np.arange(n)
        size = self.largest * sum(abs(x) for x in q.tolist())  # no product is larger
        if n > RESOLVED * k and size < WIDE:
            kind = np.float32 if size < 1 << 23 else np.float64  # sums are exact
            slack = size * (len(q) + 2) * 2.0**-50 if size >= 1 << 52 else 0.0  # or off by less
            if kind not in self.floats:
                self.floats[kind] = self.v.astype(kind)
            values, weight, down = self.floats[kind], q.astype(kind), q > 0
            worst = np.where(down, self.sorted[0], self.sorted[-1]) * q
            depth, step = self.depth, max(1, n // 16)
            while True:
                # read the lists to this depth, each from the end that its component prefers
                edge = np.where(down, self.sorted[n - depth], self.sorted[depth - 1]) * q
                ranks = self.rank[rows] if len(rows) < n else self.rank
                read = np.where(down, ranks >= n - depth, ranks < depth).astype(kind)
                bounds = read @ np.stack([edge, worst], axis=1).astype(kind)
                known = (read * (values[rows] if len(rows) < n else values)) @ weight
                upper, lower = known + (edge.sum() - bounds[:, 0]), known + (worst.sum() - bounds[:, 1])
                lower[self.ids[rows] == query_id] = -np.inf
                bar = np.partition(lower, len(rows) - k)[len(rows) - k]
                rows = rows[upper >= bar - slack]
                if len(rows) <= RESOLVED * k or depth == n:
                    break
                depth = min(n, depth + step)
            self.depth = max(1, min(n - 1, depth) - step // 2)
        rows = rows[self.ids[rows] != query_id]
        if size < WIDE:
            score = self.v[rows] @ q
        else:
            whole = (sum(x * y for x, y in zip(row, q.tolist(), strict=True)) for row in self.v[rows].tolist())
            score = np.array([min(max(x, -LONG - 1), LONG) for x in whole], np.int64)
        best = np.lexsort((self.ids[rows], ~score))[:k]
        return self.ids[rows[best]], score[best]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` largest integer inner products of each query with every other row.

    `vectors` has vec_id and embedding; queries are the rows whose vec_id is divisible by `every`. Ties go to the
    smaller vec_id; fewer rows than k give all. Components and products beyond 64 bits count as the nearest number of 64
    bits. Vectors null, empty or with null or non-finite components take no part;
    vectors of different lengths meet only their like. Rows with the query's own vec_id are not its candidates; other
    repeated vec_ids give a row each, and query rows of one vec_id share its k ranks. An empty table gives no rows; other columns are ignored. Every block of candidates
    keeps k rows a query, so what is shuffled to be ranked is k rows a query and block.
    """
    # quantized once, with ids that a repeated task finds again
    table = Table(quantized(vectors, scale).withColumn("d", F.size("v")), "vectors")
    rows, spark = table.df, vectors.sparkSession
    n = rows.count()
    n_blocks = max(1, -(-n // CANDIDATES))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    n_parts = max(1, -(-rows.filter(is_query).count() // QUERIES))
    block, part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)), F.pmod(F.xxhash64("vec_id"), F.lit(n_parts))
    # every block of candidates meets every block of queries: both sides are dealt out to the cells of that grid
    grid_c = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "d", F.lit(False).alias("query"), "vec_id", "v")
    grid_q = rows.filter(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), part.cast("int").alias("part"), "d", F.lit(True).alias("query"), "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ask = group["query"].to_numpy()
        ids = group["vec_id"].to_numpy()
        d = group["d"][0].as_py()
        values = group["v"].combine_chunks()
        v = values.flatten().to_numpy().reshape(-1, d)
        if ask.all() or not ask.any():
            return schema.empty_table()
        lists = SortedLists(ids[~ask], v[~ask])
        out = [], [], []
        for query_id, q in zip(ids[ask].tolist(), v[ask], strict=True):
            found, score = lists.top(query_id, q, k)
            out[0].append(np.full(len(found), query_id))
            out[1].append(found)
            out[2].append(score)
        return pa.Table.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], schema=schema)

    cells = grid_c.unionByName(grid_q).repartition(n_blocks * n_parts, "block", "part").groupBy("block", "part", "d").applyInArrow(cell, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
