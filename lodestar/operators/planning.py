"""Choosing analyzers, scoping sources, keying caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.paths import matches_deep

#: How a selection was made, by priority.
PRIORITY = {"cli": 3, "assignment": 2, "automatic": 1}


def choose(candidates: DataFrame, by: list[str], score: str, id_: str) -> DataFrame:
    """The best candidate of each group; where the best score is shared the choice is null and `tied` is true."""
    top = candidates.groupBy(*by).agg(F.max(F.col(score)).alias("best"))
    met = candidates.join(top, by).filter(F.col(score) == F.col("best")).groupBy(*by, "best").agg(F.count("*").alias("n"), F.min(id_).alias("first"))
    return met.select(*by, "best", F.when(F.col("n") == 1, F.col("first")).alias(id_), (F.col("n") > 1).alias("tied"))


def consolidate(selections: DataFrame, by: list[str]) -> DataFrame:
    """Selections of the highest priority made for each group."""
    p = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v)])[F.col("source")]
    return selections.withColumn("priority", p).withColumn("top", F.max("priority").over(Window.partitionBy(*by))).filter("priority = top").drop("top")


def source_scope(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Files with in_scope: an include pattern matches (none given: all do) and no exclude pattern does."""
    took = matches_deep(F.col("path"), include) if include else F.lit(True)
    return files.withColumn("in_scope", took & ~matches_deep(F.col("path"), exclude))


def scope_fingerprint(files: DataFrame, by: list[str]) -> DataFrame:
    """One digest per group over its sorted (path, hash) pairs; an unreadable file counts by name."""
    entry = F.sha2(F.concat_ws("\x00", "path", F.coalesce("hash", F.lit("unreadable"))), 256)
    return files.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ""), 256).alias("fingerprint"), F.count("*").alias("files"))


def cache_key(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


#: Compared in this order; the first that differs is the reason.
REASONS = ("analyzer_version", "options", "source_scope", "manifest", "content")


def cache_decisions(previous: DataFrame, current: DataFrame, reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """(scope_id, decision): reuse where all is equal, cache_miss where nothing was kept, else the first difference."""
    p = previous.select("scope_id", F.lit(True).alias("kept"), *[F.col(c).alias(f"p_{c}") for c in reasons])
    c = current.join(p, "scope_id", "left")
    out = F.when(F.col("kept").isNull(), "cache_miss")
    for r in reasons:
        out = out.when(~F.col(r).eqNullSafe(F.col(f"p_{r}")), f"{r}_changed")
    return c.select("scope_id", out.otherwise("reuse").alias("decision"))


def invalidation(changed: DataFrame, scopes: DataFrame) -> DataFrame:
    """(group_id, full, scopes): a group of changed paths rescans its scopes if each path lies in exactly one root."""
    from lodestar.functions.paths import ancestors

    changed = changed.select("group_id", "path").distinct()
    up = changed.select("group_id", "path", F.explode(ancestors(F.col("path"))).alias("root"))
    met = up.join(scopes.select("root", "scope_id"), "root").groupBy("group_id", "path").agg(F.count("*").alias("n"), F.min("scope_id").alias("scope_id"))
    each = changed.join(met, ["group_id", "path"], "left")
    full = F.bool_or(F.coalesce("n", F.lit(0)) != 1)
    return each.groupBy("group_id").agg(full.alias("full"), F.array_sort(F.collect_set("scope_id")).alias("scopes")).withColumn("scopes", F.when(F.col("full"), F.expr("cast(array() as array<string>)")).otherwise(F.col("scopes").cast("array<string>")))


def layered_options(defaults: dict, project: dict, cli: dict) -> dict[str, tuple[object, str]]:
    """Every option's value and the layer it comes from."""
    out = {}
    for name, layer in (("default", defaults), ("project", project), ("cli", cli)):
        out |= {k: (v, name) for k, v in layer.items()}
    return out
