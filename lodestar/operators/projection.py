"""Bounded projection of a concept forest: nodes in reading order up to a budget, then the relationships between them.

The reading order is depth first, children by id. In a forest that is the order of the paths of ids from the roots, so a
breadth-first frontier of paths gives it, and the node budget is a cut in one total order, whatever the depth.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.tables import written

#: Budgets where none is given, and the most that may be asked for.
NODES, RELATIONSHIPS, MOST_NODES, MOST_RELATIONSHIPS = 1000, 10_000, 3000, 30_000
COUNTS = "visible_nodes long, hidden_nodes long, visible_relationships long, hidden_relationships long, nodes_cut boolean, relationships_cut boolean, status string"


class Projection(NamedTuple):
    nodes: DataFrame  # id, depth, place (from 0, in reading order)
    relationships: DataFrame  # kind, relationship_id, src, dst, place
    counts: DataFrame  # one row: visible_nodes, hidden_nodes, visible_relationships, hidden_relationships, nodes_cut, relationships_cut, status
    diagnostics: list[str]


def budget(asked: int, usual: int, most: int) -> tuple[int, list[str]]:
    """The budget that holds, and a diagnostic where it is not the one asked for."""
    if asked < 1:
        return usual, [f"the limit {asked} is not positive; {usual} is used"]
    if asked > most:
        return most, [f"the limit {asked} is above {most}, which is used"]
    return asked, []


def reading_paths(concepts: DataFrame, parents: DataFrame, focus=None, depth: int | None = 2) -> DataFrame:
    """(id, depth, path) of the concepts (id) at most `depth` steps (None: all) below the focus, or below all concepts without a
    parent; `parents` (child, parent) is a forest. The path holds the ids from the root."""
    ids = concepts.select("id").distinct()
    tree = written(parents.join(ids.withColumnRenamed("id", "child"), "child", "left_semi").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").select("child", "parent"))
    roots = ids.filter(F.col("id") == F.lit(focus)) if focus is not None else ids.join(tree.select(F.col("child").alias("id")), "id", "left_anti")
    frontier = written(roots.select("id", F.lit(0).alias("depth"), F.array("id").alias("path")))
    seen, d = frontier, 0
    while (depth is None or d < depth) and not frontier.isEmpty():
        d += 1
        down = frontier.select(F.col("id").alias("parent"), "path").join(tree, "parent")
        frontier = written(down.select(F.col("child").alias("id"), F.lit(d).alias("depth"), F.concat("path", F.array("child")).alias("path")))
        seen = seen.unionByName(frontier)
    return seen


def bounded_projection(concepts: DataFrame, parents: DataFrame, relationships: DataFrame, focus=None, depth: int | None = 2, max_nodes: int = NODES, max_relationships: int = RELATIONSHIPS, containment: bool = True, semantic: bool = True) -> Projection:
    """What a view of the concepts shows.

    `concepts` has id and visible (null counts as true; an invisible concept takes no room, and what is below it is still
    looked at); `parents` (child, parent) is a forest; `relationships` (kind, relationship_id, src, dst, contains) are shown
    where both ends are, by kind and relationship_id, up to their own budget after the nodes' one. A switched-off group
    counts as hidden. The nodes are cut if any concept follows the last one shown. `focus` must be one of the concepts.
    """
    if depth is not None and depth < 1:
        raise ValueError(f"the depth {depth} is below 1")
    concepts = written(concepts.select("id", F.coalesce("visible", F.lit(True)).alias("visible")))
    if focus is not None and concepts.filter(F.col("id") == F.lit(focus)).isEmpty():
        raise ValueError(f"the focus {focus} is not among the concepts")
    n_nodes, notes = budget(max_nodes, NODES, MOST_NODES)
    n_edges, more = budget(max_relationships, RELATIONSHIPS, MOST_RELATIONSHIPS)
    paths = written(reading_paths(concepts, parents, focus, depth).join(concepts, "id"))
    shown = written(paths.filter("visible").orderBy("path").limit(n_nodes))  # MOST_NODES rows at most
    in_order = Window.orderBy("path")
    nodes = shown.select("id", "depth", (F.row_number().over(in_order) - 1).alias("place"))
    n_shown, last = shown.agg(F.count("*"), F.max("path")).head()
    nodes_cut = n_shown == n_nodes and not paths.filter(F.col("path") > F.array(*[F.lit(x) for x in last])).isEmpty()
    ends = F.broadcast(shown.select("id"))
    enabled = F.when(F.col("contains"), F.lit(containment)).otherwise(F.lit(semantic))
    between = relationships.filter(enabled)
    for end in ("src", "dst"):
        between = between.join(ends.withColumnRenamed("id", end), end, "left_semi")
    between = written(between.select("kind", "relationship_id", "src", "dst"))
    kept = written(between.orderBy("kind", "relationship_id").limit(n_edges))  # MOST_RELATIONSHIPS rows at most
    edges = kept.withColumn("place", F.row_number().over(Window.orderBy("kind", "relationship_id")) - 1)
    n_kept, n_between, n_all, n_concepts = (df.count() for df in (kept, between, relationships, concepts))
    edges_cut = n_between > n_edges
    row = (n_shown, n_concepts - n_shown, n_kept, n_all - n_kept, nodes_cut, edges_cut, "truncated" if nodes_cut or edges_cut else "ready")
    counts = concepts.sparkSession.createDataFrame([row], COUNTS)
    return Projection(nodes, edges, counts, [*notes, *more])
