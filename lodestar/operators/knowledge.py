"""Bundles of concept documents: front matter, links, the hierarchy they claim, rules and states."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar.operators.graph import parents_without_cycles

#: Most files of a bundle, bytes of it and of a document.
MAX_FILES, MAX_BYTES, MAX_DOCUMENT = 10_000, 64 << 20, 8 << 20
LINK = r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)"


def _scalar(text: str):
    t = text.strip()
    if t[:1] in "\"'" and t[-1:] == t[:1] and len(t) > 1:
        return t[1:-1]
    if t.startswith("[") and t.endswith("]"):
        return [_scalar(x) for x in t[1:-1].split(",") if x.strip()]
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if t.lower() in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def front_matter(text: str) -> dict | None:
    """The fenced block at the head of a document: scalars, inline and block lists, one level of maps. None without a
    fence or without a non-empty `type`."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(\r?\n|$)", text, re.S)
    if not m:
        return None
    out: dict = {}
    key = None
    for line in m[1].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if item := re.match(r"\s*-\s+(.*)$", line):
            if key is None:
                return None
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(_scalar(item[1]))
        elif pair := re.match(r"(\s*)([\w.-]+)\s*:\s*(.*)$", line):
            if pair[1] and key is not None:
                if not isinstance(out[key], dict):
                    out[key] = {}
                out[key][pair[2]] = _scalar(pair[3])
            else:
                key = pair[2]
                out[key] = _scalar(pair[3])
        else:
            return None
    return out if isinstance(out.get("type"), str) and out["type"].strip() else None


def concepts(files: DataFrame) -> DataFrame:
    """(concept_id, type, title, parents, children, metadata JSON, valid) from files (path, content); caps are checked per document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                meta = front_matter(content or "") if len((content or "").encode()) <= MAX_DOCUMENT else None
                names = lambda k, m=meta: [str(x) for x in (m.get(k) if isinstance(m.get(k), list) else [m[k]] if m.get(k) else [])]
                if meta is None:
                    rows.append((path.removesuffix(".md"), None, None, [], [], "{}", False))
                else:
                    rows.append((path.removesuffix(".md"), meta["type"], str(meta.get("title") or posixpath.basename(path).removesuffix(".md")), names("parents"), names("children"), json.dumps(meta, sort_keys=True, default=str), True))
            yield pd.DataFrame(rows, columns=["concept_id", "type", "title", "parents", "children", "metadata", "valid"])

    return files.select("path", "content").mapInPandas(run, "concept_id string, type string, title string, parents array<string>, children array<string>, metadata string, valid boolean")


def links(documents: DataFrame) -> DataFrame:
    """(concept_id, ordinal, target) of inline links in document order; images are none."""
    found = F.regexp_extract_all(F.col("content"), F.lit(LINK), F.lit(1))
    return documents.select("concept_id", F.posexplode(found).alias("ordinal", "target"))


@F.pandas_udf(StringType())
def resolved_target(source: pd.Series, target: pd.Series) -> pd.Series:
    """The concept a link leads to: relative to its document, inside the bundle, `.md` taken off; null for anything else."""
    out = []
    for s, t in zip(source, target, strict=True):
        t = re.sub(r"[#?].*$", "", t or "")
        if not t or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", t):
            out.append(None)
            continue
        p = posixpath.normpath(t.lstrip("/") if t.startswith("/") else posixpath.join(posixpath.dirname(s), t))
        out.append(None if p.startswith("..") or not p.endswith(".md") else p.removesuffix(".md"))
    return pd.Series(out)


def resolve_links(found: DataFrame, known: DataFrame) -> DataFrame:
    """Links with the concept they reach; those outside the bundle or without a document have null."""
    to = found.withColumn("to", resolved_target(F.col("concept_id"), F.col("target")))
    return to.join(known.select(F.col("concept_id").alias("to"), F.lit(True).alias("exists")), "to", "left").select("concept_id", "ordinal", "target", F.when(F.col("exists"), F.col("to")).alias("to"))


def forest(claims: DataFrame, fallback: DataFrame) -> DataFrame:
    """(child, parent): one parent each. More than one claimed parent excludes them all; the fallback counts only for a
    child without any claim; members of a cycle lose their parent, branches below stay."""
    distinct = claims.select("child", "parent").distinct()
    single = distinct.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).filter("n = 1").select("child", "parent")
    rest = fallback.select("child", "parent").join(distinct.select("child").distinct(), "child", "left_anti")
    return parents_without_cycles(single.unionByName(rest))


def nearest_directory_parent(known: DataFrame) -> DataFrame:
    """(child, parent): the nearest existing document named like a directory above."""
    parts = F.split("concept_id", "/")
    up = known.select(F.col("concept_id").alias("child"), F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.expr("cast(array() as array<string>)"))).alias("parent"))
    return up.join(known.select(F.col("concept_id").alias("parent")), "parent", "left_semi").groupBy("child").agg(F.max_by("parent", F.length("parent")).alias("parent"))


def rolled_up_state(parents: DataFrame, states: DataFrame) -> DataFrame:
    """(parent, state): the children's state if all have the same and none is unknown."""
    each = parents.join(states.select(F.col("id").alias("child"), "state"), "child", "left")
    known = F.bool_and(F.col("state").isNotNull() & (F.col("state") != "unknown"))
    return each.groupBy("parent").agg(F.when(known & (F.min("state") == F.max("state")), F.min("state")).otherwise("unknown").alias("state"))


def merged_rules(outputs: DataFrame) -> DataFrame:
    """(concept_id, field, value, conflict): the highest priority wins; different values at it blank the field."""
    top = outputs.groupBy("concept_id", "field").agg(F.max("priority").alias("top"))
    met = outputs.join(top, ["concept_id", "field"]).filter("priority = top").groupBy("concept_id", "field").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    return met.select("concept_id", "field", F.when(F.col("n") == 1, F.col("value")).otherwise("").alias("value"), (F.col("n") > 1).alias("conflict"))


def metadata_field(metadata: Column, path: str) -> Column:
    return F.get_json_object(metadata, f"$.{path}")


def metadata_equals(metadata: Column, path: str, value) -> Column:
    """Equality of typed JSON values: 1 equals 1.0, "1" does not."""
    got = F.try_variant_get(F.try_parse_json(metadata), f"$.{path}", "variant")
    text = F.to_json(got)
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return F.coalesce(text == json.dumps(value, ensure_ascii=False), F.lit(False))
    return F.coalesce(~F.startswith(text, F.lit('"')) & (F.try_to_number(text, F.lit("S999999999D999999999")).cast("double").eqNullSafe(F.lit(float(value))) | (text == json.dumps(value))), F.lit(False))


def metadata_contains(metadata: Column, path: str, needle: str) -> Column:
    """A substring without case for a string, an equal member for a list."""
    text = F.get_json_object(metadata, f"$.{path}")
    members = F.from_json(text, "array<string>")
    is_list = F.startswith(F.trim(text), F.lit("["))
    return F.coalesce(F.when(is_list, F.array_contains(members, needle)).otherwise(F.contains(F.lower(text), F.lit(needle.lower()))), F.lit(False))
