"""File-change events: per-path coalescing, debounced groups, snapshots and their differences, as batch and as stream.

Events have seq (long), path, kind (create, modify, delete, rename, overflow, error) and ts (timestamp).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Debounce and most pending events.
DEBOUNCE_MS, MAX_PENDING = 250, 10_000
KINDS = ("create", "modify", "delete", "rename")
RESCAN = ("overflow", "error")


def merged_kind(before: Column, now: Column) -> Column:
    """The kind of two events on one path; null: they cancel out."""
    return (
        F.when(before.isNull(), now)
        .when((before == "rename") | (now == "rename"), F.lit("rename"))
        .when((before == "create") & (now == "modify"), F.lit("create"))
        .when((before == "create") & (now == "delete"), F.lit(None).cast("string"))
        .when((before == "delete") & (now == "create"), F.lit("modify"))
        .otherwise(now)
    )


def merge_kinds(before: str | None, now: str) -> str | None:
    """merged_kind for plain values."""
    if before is None:
        return now
    if "rename" in (before, now):
        return "rename"
    return {("create", "modify"): "create", ("create", "delete"): None, ("delete", "create"): "modify"}.get((before, now), now)


def coalesced(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """One pending event per path (and group): the fold of its events in sequence order; paths that cancel out are gone."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind")))
    out = events.filter(F.col("kind").isin(*KINDS)).groupBy(*by, "path").agg(ordered.alias("e"))
    kind = F.aggregate("e", F.lit(None).cast("string"), lambda acc, x: merged_kind(acc, x["kind"]))
    return out.select(*by, "path", kind.alias("kind"), F.element_at("e", 1)["seq"].alias("first_seq"), F.element_at("e", -1)["seq"].alias("last_seq")).filter("kind is not null")


def debounced(events: DataFrame, gap: str, by: list[str] = ()) -> DataFrame:
    """Groups of events with no pause longer than `gap`: count, distinct paths, first and last sequence."""
    w = F.session_window("ts", gap)
    return events.groupBy(*by, w).agg(F.count("*").alias("events"), F.count_distinct("path").alias("paths"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).drop("session_window")


def debounced_stream(events: DataFrame, gap: str, lateness: str, by: list[str]) -> DataFrame:
    """debounced over a stream; groups come out once the watermark has passed them. Distinct paths are counted as a set.
    Session windows of a stream need a key, so `by` names at least one column."""
    return events.withWatermark("ts", lateness).groupBy(*by, F.session_window("ts", gap)).agg(F.count("*").alias("events"), F.size(F.collect_set("path")).cast("long").alias("paths"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).drop("session_window")


def sequence_gaps(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sequence numbers that a newer event skips, per source: a repeat is no gap."""
    w = Window.partitionBy(*by).orderBy("seq")
    return events.select(*by, "seq").distinct().withColumn("before", F.lag("seq").over(w)).filter(F.col("seq") > F.col("before") + 1)


def needs_rescan(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, rescan, pending): an overflow, an error or too many pending paths ask for a full scan."""
    pending = coalesced(events, by).groupBy(*by).agg(F.count("*").alias("pending"))
    bad = events.groupBy(*by).agg(F.bool_or(F.col("kind").isin(*RESCAN)).alias("bad"))
    n = F.coalesce("pending", F.lit(0).cast("long"))
    return bad.join(pending, by, "left").select(*by, (F.col("bad") | (n > MAX_PENDING)).alias("rescan"), n.alias("pending"))


def coalesced_stream(events: DataFrame) -> DataFrame:
    """The pending kind of every path after each micro-batch, by arbitrary state per path (update mode; null: none)."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kind, last = state.get if state.exists else (None, -1)
        pdf = pd.concat(list(parts)).sort_values("seq")
        for seq, now in zip(pdf["seq"].tolist(), pdf["kind"].tolist(), strict=True):
            if seq > last and now in KINDS:
                kind, last = merge_kinds(kind, now), seq
        state.update((kind, last))
        yield pd.DataFrame({"path": [key[0]], "kind": [kind], "last_seq": [last]})

    return events.groupBy("path").applyInPandasWithState(fold, "path string, kind string, last_seq long", "kind string, last_seq long", "update", GroupStateTimeout.NoTimeout)


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, kind) of paths whose hash or size differ, or that are in one snapshot only."""
    p, c = (df.select("path", F.struct("hash", "size").alias(n)) for df, n in ((previous, "p"), (current, "c")))
    both = p.join(c, "path", "full").filter(~F.col("p").eqNullSafe(F.col("c")))
    return both.select("path", F.when(F.col("p").isNull(), "create").when(F.col("c").isNull(), "delete").otherwise("modify").alias("kind"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, size, hash) of files (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


def snapshot_digest(prints: DataFrame) -> DataFrame:
    """One row, digest: of the files' own digests in order of path. Sums of parts of them would not do, so 64 hex digits a
    file meet in one task; groups of paths are folded first."""
    each = prints.select("path", F.sha2(F.concat_ws("\x00", "path", "hash"), 256).alias("d"))
    part = each.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))
