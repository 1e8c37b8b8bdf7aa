"""From observations to one canonical model: merging, conflicts, dangling ends, scopes, set operations, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.ids import namespaced
from lodestar.functions.paths import ancestors, matches_deep


def merge_observations(observations: DataFrame, key: str, order: str, scalars: list[str], sets: list[str] = (), fills: list[str] = ()) -> DataFrame:
    """One row per key. Scalars come from the first observation by `order`, which must be total; set columns are united
    and sorted; fill columns take the first value that is not null."""
    aggs = [F.min_by(c, order).alias(c) for c in scalars]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fills]
    return observations.groupBy(key).agg(*aggs)


def merge_metadata(observations: DataFrame, key: str, order: str, metadata: str) -> DataFrame:
    """Maps united per key; the first observation by `order` wins for each entry."""
    entries = observations.select(key, order, F.explode(metadata).alias("k", "v"))
    first = entries.groupBy(key, "k").agg(F.min_by("v", order).alias("v"))
    return first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(metadata))


def conflicts(observations: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Keys whose observations differ in a compared column; a null differs from a value."""
    seen = F.sha2(F.to_json(F.struct(*compared), {"ignoreNullFields": "false"}), 256)
    return observations.groupBy(key).agg(F.count_distinct(seen).alias("variants")).filter("variants > 1")


def dangling(edges: DataFrame, vertices: DataFrame, end: str = "src") -> DataFrame:
    """Edges whose end is no vertex."""
    return edges.join(vertices.select(F.col("id").alias(end)), end, "left_anti")


def scope_cascade(files: DataFrame, modules: DataFrame, edges: DataFrame, include: list[str], exclude: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a source scope leaves: files in it, modules with a file left (module_id on files), edges with both ends left."""
    kept = files.filter(matches_deep(F.col("path"), include) & ~matches_deep(F.col("path"), exclude))
    left = modules.join(kept.select(F.col("module_id").alias("id")).distinct(), "id", "left_semi")
    ends = left.select("id")
    return kept, left, edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def deepest_owner(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path with the deepest root that contains it: every ancestor is looked up, so the join is an equality."""
    up = paths.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "root"))
    met = up.join(roots.select("root").distinct(), "root")
    return paths.join(met.groupBy("path").agg(F.max_by("root", "depth").alias("owner")), "path", "left")


def union_of_scopes(scopes: list[tuple[str, DataFrame]], ids: list[str]) -> DataFrame:
    """UNION ALL of the scopes' tables with every id column put in its scope's namespace."""
    parts = [df.withColumns({c: namespaced(F.lit(s), F.col(c)) for c in ids}).withColumn("scope_id", F.lit(s)) for s, df in scopes]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sorted_distinct(c: Column, drop_empty: bool = False) -> Column:
    x = F.array_remove(c, "") if drop_empty else c
    return F.array_sort(F.array_distinct(x))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def not_ascending(rows: DataFrame, position: str, id_: str, by: str) -> DataFrame:
    """Rows whose id is not greater than the one before, within each collection `by`."""
    before = F.lag(id_).over(Window.partitionBy(by).orderBy(position))
    return rows.withColumn("before", before).filter(F.col("before") >= F.col(id_))


def violations(model: dict[str, DataFrame]) -> DataFrame:
    """Every breach of a canonical model as (check, subject): repeated ids, unknown ends, unknown members, bad layers."""
    v, e = model["modules"], model["relationships"]
    checks = [
        v.groupBy("id").count().filter("count > 1").select(F.lit("module-id-repeats").alias("check"), F.col("id").cast("string").alias("subject")),
        e.groupBy("edge_id").count().filter("count > 1").select(F.lit("relationship-id-repeats").alias("check"), F.col("edge_id").cast("string").alias("subject")),
        dangling(e, v, "src").select(F.lit("source-unknown").alias("check"), F.col("edge_id").cast("string").alias("subject")),
        dangling(e.filter("dst is not null"), v, "dst").select(F.lit("target-unknown").alias("check"), F.col("edge_id").cast("string").alias("subject")),
    ]
    if "layers" in model:
        one = model["layers"].groupBy("id").agg(F.count("*").alias("n"))
        checks.append(v.select("id").join(one, "id", "left").filter("coalesce(n, 0) <> 1").select(F.lit("not-one-layer").alias("check"), F.col("id").cast("string").alias("subject")))
    if "feedback" in model:
        checks.append(model["feedback"].join(e.select("edge_id"), "edge_id", "left_anti").select(F.lit("feedback-unknown").alias("check"), F.col("edge_id").cast("string").alias("subject")))
    return reduce(DataFrame.unionByName, checks)


def collection_counts(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, n) of every collection."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("collection"), "n") for k, df in sorted(collections.items())]
    return reduce(DataFrame.unionByName, parts)
