"""Filters, pages and text search over file, symbol and documentation facts."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.paths import matches_glob

#: Page bounds (default, most), live bounds (items, bytes), excerpt bounds (lines, bytes).
PAGE, LIVE_ITEMS, LIVE_BYTES, EXCERPT = (50, 200), (50, 5_000), (16 << 10, 1 << 20), (120, 4 << 20)


def file_filter(prefix: str = "", glob: str = "", language: str = "", roles: list[str] = (), statuses: list[str] = ()) -> Column:
    """All given conditions on path, language, roles and status; none given accepts every file."""
    out = F.lit(True)
    if prefix:
        out = out & T.has_prefix(F.col("path"), prefix, case_sensitive=True)
    if glob:
        out = out & matches_glob(F.col("path"), glob)
    if language:
        out = out & T.contains(F.col("language"), language)
    if roles:
        out = out & F.arrays_overlap(F.col("roles"), F.lit(list(roles)))
    if statuses:
        out = out & F.exists(F.lit(list(statuses)), lambda s: T.contains(F.col("status"), s))
    return out


def symbol_filter(name: str = "", category: str = "", kind: str = "", status: str = "") -> Column:
    out = F.lit(True)
    for column, want in (("name", name), ("category", category), ("kind", kind), ("status", status)):
        if want:
            hit = T.contains(F.col(column), want)
            out = out & (hit | T.contains(F.col("qualified_name"), want) if column == "name" else hit)
    return out


def in_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with a location (location_file_ids) in one of the files."""
    where = symbols.select("symbol_id", F.explode("location_file_ids").alias("file_id")).join(files.select("file_id"), "file_id", "left_semi")
    return symbols.join(where.select("symbol_id").distinct(), "symbol_id", "left_semi")


def members(relations: DataFrame, modules: DataFrame, kinds: tuple[str, ...] = ("contains",)) -> DataFrame:
    """ids reached from the given modules (column id) by relations of these kinds; unknown modules reach nothing."""
    own = relations.filter(F.col("kind").isin(*kinds)).join(modules.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return own.select(F.col("dst").alias("id")).distinct()


def callers_and_callees(relations: DataFrame, entity) -> DataFrame:
    """Call edges of an entity with their direction; a call of itself counts as callee only."""
    calls = relations.filter(F.col("kind").isin("call", "calls", "source:call"))
    callees = calls.filter(F.col("src") == entity).select(F.lit("callee").alias("direction"), F.col("dst").alias("id"), "relation_id")
    callers = calls.filter((F.col("dst") == entity) & (F.col("src") != entity)).select(F.lit("caller").alias("direction"), F.col("src").alias("id"), "relation_id")
    return callees.unionByName(callers)


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int | None = None, most: int = PAGE[1]) -> DataFrame:
    """A page in a total order; the limit has a default and an upper bound."""
    n = PAGE[0] if limit is None else limit
    if not 0 < n <= most or offset < 0:
        raise ValueError("the page is out of bounds")
    return rows.orderBy(*order).offset(offset).limit(n)


def budgeted_page(rows: DataFrame, order: list[str], max_items: int = LIVE_ITEMS[0], max_bytes: int = LIVE_BYTES[0], offset: int = 0) -> DataFrame:
    """Rows in order until either budget is spent, with the running size of their JSON.

    At most max_items rows can be in a page, so only those are ranked and summed. A budget out of bounds is an error, and
    so is a first row that no page of that many bytes can hold.
    """
    if not 0 < max_items <= LIVE_ITEMS[1] or not 0 < max_bytes <= LIVE_BYTES[1] or offset < 0:
        raise ValueError("the page is out of bounds")
    sized = rows.orderBy(*order).offset(offset).limit(max_items).withColumn("json_bytes", F.octet_length(F.to_json(F.struct(*rows.columns))))
    first = sized.limit(1).select("json_bytes").collect()
    if first and first[0][0] > max_bytes:
        raise ValueError(f"the first row alone has {first[0][0]} bytes")
    return sized.withColumn("used", F.sum("json_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= max_bytes)


def query_digest(request: dict, revision: int) -> str:
    own = {k: v for k, v in request.items() if k != "cursor"}
    return hashlib.sha256(json.dumps([own, revision], sort_keys=True, default=str).encode()).hexdigest()


def encode_cursor(offset: int, digest: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"offset": offset, "query": digest}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, digest: str) -> int:
    """The offset of a cursor; one made for another query is an error."""
    if not cursor:
        return 0
    try:
        got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if got["query"] != digest or got["offset"] < 0:
            raise ValueError
        return int(got["offset"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the cursor does not belong to this query") from e


def find_text(files: DataFrame, pattern: str, case_sensitive: bool = True, regex: bool = False) -> DataFrame:
    """(path, line, column, match_bytes) for all matches: lines and byte columns from 1. One engine judges a pattern: only a
    case-sensitive literal is looked for before lines reach Python."""
    lines = files.select("path", F.posexplode(T.split_lines(F.col("content"))).alias("n", "text"))
    near = lines if regex or not case_sensitive else lines.filter(T.contains(F.col("text"), pattern, True))
    hits = near.select("path", (F.col("n") + 1).cast("int").alias("line"), F.explode(T.matches(F.col("text"), pattern, case_sensitive, regex)).alias("m"))
    return hits.select("path", "line", (F.col("m.start") + 1).alias("column"), (F.col("m.end") - F.col("m.start")).alias("match_bytes"))


def find_literal(files: DataFrame, needle: str) -> DataFrame:
    """find_text for a case-sensitive literal, by built-in functions alone."""
    lines = files.select("path", F.posexplode(T.split_lines(F.col("content"))).alias("n", "text")).filter(F.contains("text", F.lit(needle)))
    hits = lines.select("path", (F.col("n") + 1).cast("int").alias("line"), F.explode(T.literal_matches(F.col("text"), needle)).alias("m"))
    return hits.select("path", "line", (F.col("m.start") + 1).cast("int").alias("column"))


def excerpt(files: DataFrame, first: int, last: int, max_lines: int = 40) -> DataFrame:
    """Lines first..last of each file, at most max_lines of them."""
    lines = files.select("path", F.posexplode(T.split_lines(F.col("content"))).alias("n", "text")).withColumn("line", (F.col("n") + 1).cast("int"))
    return lines.filter(F.col("line").between(first, min(last, first + max_lines - 1))).select("path", "line", "text")


def compact_documentation(docs: DataFrame, limit: int = 512) -> DataFrame:
    return docs.select("symbol_id", F.substring("normalized", 1, limit).alias("normalized"), (F.char_length("normalized") > limit).alias("truncated"))


def evidence(tables: dict[str, DataFrame], entity) -> DataFrame:
    """(kind, path, line) of every span that symbols, documentation, occurrences or relations give for one entity."""
    out = None
    for kind, df in sorted(tables.items()):
        own = df.filter(F.col("entity") == entity).select(F.lit(kind).alias("kind"), "path", "line")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def nearest_comment(comments: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each declaration the block of comment lines that ends on the line before it.

    comments (path, line, text), anchors (path, anchor). Lines without a gap are an island; the island that ends just
    above the anchor is met by an equality join.
    """
    w = Window.partitionBy("path").orderBy("line")
    islands = comments.withColumn("island", F.col("line") - F.row_number().over(w)).groupBy("path", "island").agg((F.max("line") + 1).alias("anchor"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("comment"))
    return anchors.join(islands.select("path", "anchor", "comment"), ["path", "anchor"], "left")
