"""What a graph view shows: folded edges and their states, references by scope, confidence, labels, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confidence_state(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.6, "medium").when(score.isNotNull(), "low").otherwise("unknown")


def confidence(observations: DataFrame, key: str) -> DataFrame:
    """Least score (at most 1), its state, and the basis if there is but one, else `mixed`."""
    least = F.least(F.lit(1.0), F.min("score"))
    out = observations.groupBy(key).agg(least.alias("score"), F.when(F.count_distinct("basis") > 1, "mixed").otherwise(F.min("basis")).alias("basis"))
    return out.withColumn("state", confidence_state(F.col("score")))


def cycle_state(cyclic: Column, feedback: Column) -> Column:
    """Aggregate over contributors: a cycle beats feedback, feedback beats none."""
    return F.when(F.coalesce(F.bool_or(cyclic), F.lit(False)), "cycle").when(F.coalesce(F.bool_or(feedback), F.lit(False)), "feedback").otherwise("none")


def visible_edges(edges: DataFrame, placed: DataFrame, unique: bool = False) -> DataFrame:
    """Edges (edge_id, type, src, dst, cyclic, feedback) folded onto nodes; a node's own edges are summarised unless cyclic.

    Where the caller knows that each edge_id has one row (`unique`), edges are counted where they lie."""
    ends = edges.join(placed.select(F.col("id").alias("src"), F.col("node").alias("src_node")), "src").join(placed.select(F.col("id").alias("dst"), F.col("node").alias("dst_node")), "dst")
    out = ends.groupBy("type", "src_node", "dst_node").agg((F.count if unique else F.count_distinct)("edge_id").alias("n"), cycle_state(F.col("cyclic"), F.col("feedback")).alias("state"))
    return out.withColumn("summary", (F.col("src_node") == F.col("dst_node")) & (F.col("state") != "cycle"))


def reference_summary(uses: DataFrame, expanded: list[str] = ()) -> DataFrame:
    """Per scope and in total (scope null): distinct references, uses, and whether the scope's references are expanded."""
    out = uses.rollup("scope").agg(F.count_distinct("reference").alias("references"), F.count("*").alias("uses"), F.grouping("scope").cast("int").alias("total"))
    return out.withColumn("expanded", F.coalesce(F.col("scope").isin(*expanded) if expanded else F.lit(False), F.lit(False)))


def layer_labels(layers: DataFrame, placed: DataFrame) -> DataFrame:
    """Layers with visible nodes: distinct nodes and modules."""
    return layers.join(placed.select("id", "node"), "id").groupBy("layer").agg(F.count_distinct("node").alias("nodes"), F.count("*").alias("modules"))


def cycle_indicators(cycles: DataFrame, placed: DataFrame) -> DataFrame:
    """Cycles (component, members) with a visible node, and their nodes."""
    each = cycles.select("component", F.explode("members").alias("id")).join(placed.select("id", "node"), "id")
    return each.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def diagnostic_indicators(diagnostics: DataFrame, placed: DataFrame) -> DataFrame:
    """Each diagnostic (diagnostic_id, id of its module) with its visible nodes; kept even without any."""
    met = diagnostics.join(placed.select("id", "node"), "id", "left")
    return met.groupBy("diagnostic_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def orthogonal_route(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Four points that leave and arrive along the longer axis, bending half-way."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    across = F.abs(x2 - x1) >= F.abs(y2 - y1)
    return F.when(across, F.array(point(x1, y1), point(mx, y1), point(mx, y2), point(x2, y2))).otherwise(F.array(point(x1, y1), point(x1, my), point(x2, my), point(x2, y2)))


def overlay(base: Column, own: Column) -> Column:
    """A style field: the overlay's, unless it is empty."""
    return F.coalesce(F.nullif(own, F.lit("")), base)


def label(template: Column, title: Column, kind: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{title}"), title), F.lit("{type}"), kind)
