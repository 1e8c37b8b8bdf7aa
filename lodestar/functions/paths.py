"""Slash-separated paths and the two glob languages, as column expressions."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Directories that no scan enters, compared without case.
EXCLUDED_DIRECTORIES = (
    ".cache", ".git", ".hg", ".mypy_cache", ".nox", ".pytest_cache", ".svn", ".tox", ".venv", "bin", "build", "cache", "coverage", "dist", "env", "external", "generated",
    "node_modules", "out", "target", "tmp", "vendor", "venv",
)


def single_level_regex(glob: str) -> str | None:
    """`*` and `?` stay within a segment, `[...]` is a class; None if the pattern is malformed (it matches nothing)."""
    out, i = "^", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out += re.escape(glob[i])
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\\\]])+)\]", glob[i:])
            if not m:
                return None
            out += f"[{m[1]}{m[2].replace('[', chr(92) + '[').replace('&', chr(92) + '&')}]"
            i += m.end() - 1
        else:
            out += re.escape(c)
        i += 1
    return out + "$"


def deep_regex(glob: str) -> str:
    """`**` spans directories, and a match of a directory accepts everything below it."""
    out = ""
    for k, part in enumerate(parts := glob.strip("/").split("/")):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part) + ("" if last else "/")
    return f"^{out}(?:/.*)?$"


def matches_glob(path: Column, glob: str) -> Column:
    pattern = single_level_regex(glob)
    return F.lit(False) if pattern is None else F.rlike(path, F.lit(pattern))


def matches_deep(path: Column, globs: list[str]) -> Column:
    """Any of the patterns; no pattern matches nothing."""
    out = F.lit(False)
    for g in globs:
        out = out | F.rlike(path, F.lit(deep_regex(g)))
    return out


def in_excluded_directory(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.lower(s).isin(*EXCLUDED_DIRECTORIES))


def repository_relative(path: Column) -> Column:
    """Not empty, not absolute, no drive, no way out."""
    return (F.length(path) > 0) & ~F.rlike(path, F.lit(r"^(/|\\|[A-Za-z]:|\.\.(/|$))")) & ~F.rlike(path, F.lit(r"/\.\.(/|$)"))


def joined(root: Column, path: Column) -> Column:
    return F.when(root.isin("", "."), path).when(path.isin("", "."), root).otherwise(F.concat_ws("/", root, path))


def ancestors(path: Column) -> Column:
    """Every directory above a path, the nearest last; `.` for the top."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.concat(F.array(F.lit(".")), F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.expr("cast(array() as array<string>)")))


@F.pandas_udf(StringType())
def cleaned(paths: pd.Series) -> pd.Series:
    """Backslashes become slashes, `.` and `..` are resolved; an empty path stays empty."""
    return pd.Series([None if p is None else "" if not p else "/" + posixpath.normpath(x).lstrip("/") if (x := p.replace("\\", "/")).startswith("/") else posixpath.normpath(x) for p in paths])
