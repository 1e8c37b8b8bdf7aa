"""Connected components of an edge table: in one task while the edges are few, else by large-star and small-star steps.

Every step is a minimum per vertex and a join with it, so a vertex with any number of neighbours is aggregated before it
is shuffled and never held in one place. Edges come out as stars around the least vertex of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import Table


#: Edges (of 16 bytes) up to which one task solves them all.
SMALL_EDGES = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, least vertex of the component of each): labels fall along edges and are then followed to their own."""
    vertex, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertex))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return vertex, vertex[label]


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        v, r = roots(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(r)], ["v", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of `edges` (a, b: longs): root is the least vertex of its component."""
    now = Table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.df.count() <= SMALL_EDGES:
        return now.df.coalesce(1).mapInArrow(solve, "v long, root long")
    before = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = Table(large, "large-star")
        low = large.df.groupBy("a").agg(F.min("b").alias("m"))
        small = large.df.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = Table(small, "small-star")
        # equal sums of counts and hashes: the edges did not change
        state = after.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        now.drop()
        large.drop()
        now = after
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.df.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.df.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
