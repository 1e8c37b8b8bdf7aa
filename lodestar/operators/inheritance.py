"""Options that are inherited: every node has its own and those of its bases, nearest first.

The order in which a node looks for an option is the depth-first one: itself, then its last base with all that it
inherits, then the base before. With the steps to a base numbered downwards, that is the lexicographic order of the paths
of numbers, a path before its continuations. So a node's bases are found by rounds of joins which keep the least path to
each, and every option comes from the least path that leads to a node with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.tables import written


def inherited_nodes(nodes: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, id, steps) for every node (id) and all it inherits from, itself included, by least steps; and diagnostics
    (id, code, subject): `not_found` for a base that is no node, `cycle` for a base that already stands on the path to it.

    `bases` (id, ord, base) lists a node's bases; a higher ord overrides a lower one.
    """
    known = nodes.select(F.col("id").alias("base"), F.lit(True).alias("known")).distinct()
    edges = written(bases.select("id", (-F.col("ord")).cast("int").alias("step"), "base").join(known, "base", "left").select("id", "step", "base", F.coalesce("known", F.lit(False)).alias("known")))
    up = edges.filter("known").select(F.col("id").alias("at"), "step", "base")
    none = F.expr("cast(array() as array<int>)")
    best = written(nodes.select(F.col("id").alias("root"), F.col("id").alias("at"), none.alias("steps"), F.array("id").alias("trail")).distinct())
    frontier, cycles = best, None
    while not frontier.isEmpty():
        stepped = written(frontier.join(up, "at").select("root", "base", F.concat("steps", F.array("step")).alias("steps"), "trail", F.array_contains("trail", F.col("base")).alias("back")))
        again = stepped.filter("back").select("root", "base")
        cycles = again if cycles is None else cycles.unionByName(again)
        ahead = stepped.filter("not back").select("root", F.col("base").alias("at"), "steps", F.concat("trail", F.array("base")).alias("trail"))
        ahead = ahead.groupBy("root", "at").agg(F.min(F.struct("steps", "trail")).alias("new")).join(best.select("root", "at", F.col("steps").alias("old")), ["root", "at"], "left")
        frontier = written(ahead.filter("old is null or new.steps < old").select("root", "at", "new.steps", "new.trail"))
        best = written(best.join(frontier.select("root", "at"), ["root", "at"], "left_anti").unionByName(frontier))
    found = best.select("root", F.col("at").alias("id"), "steps")
    missing = edges.filter("not known").select(F.col("id").alias("at"), F.col("base").alias("subject"))
    lost = best.join(missing, "at").select(F.col("root").alias("id"), F.lit("not_found").alias("code"), F.col("subject").cast("string").alias("subject"))
    if cycles is not None:
        lost = lost.unionByName(cycles.select(F.col("root").alias("id"), F.lit("cycle").alias("code"), F.col("base").cast("string").alias("subject")))
    return found, lost.distinct()


def effective_options(nodes: DataFrame, bases: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, key, value, origin, depth) of every option that a node has or inherits, and its diagnostics.

    `options` (id, key, value) are the nodes' own; a value is taken whole, so a list replaces a list, and maps that merge
    are given key by key. `origin` is the node it comes from, `depth` the steps to it. A null value is a value.
    """
    found, diagnostics = inherited_nodes(nodes, bases)
    met = found.join(options.select("id", "key", "value"), "id")
    least = met.groupBy("root", "key").agg(F.min_by(F.struct("value", F.col("id").alias("origin"), F.size("steps").alias("depth")), "steps").alias("o"))
    return least.select(F.col("root").alias("id"), "key", "o.value", "o.origin", "o.depth"), diagnostics


def profile_states(nodes: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(id, status): invalid where a base is missing or inheritance runs in a cycle, else valid."""
    bad = diagnostics.select("id").distinct().withColumn("bad", F.lit(True))
    return nodes.select("id").join(bad, "id", "left").select("id", F.when(F.col("bad"), "invalid").otherwise("valid").alias("status"))
