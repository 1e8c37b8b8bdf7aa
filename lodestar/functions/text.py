"""Lines, bytes and matches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def unified_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def physical_lines(c: Column) -> Column:
    """Line terminators LF, CR and CRLF, and one more for an unterminated last line; an empty text has none."""
    x = unified_newlines(c)
    ends = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    return (ends + F.when((F.length(x) > 0) & ~F.endswith(x, F.lit("\n")), 1).otherwise(0)).cast("long")


def split_lines(c: Column) -> Column:
    """Lines after CR and CRLF became LF; a trailing newline gives a last empty line."""
    return F.split(unified_newlines(c), "\n", -1)


def contains(c: Column, needle: Column | str, case_sensitive: bool = False) -> Column:
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(c, n) if case_sensitive else F.contains(F.lower(c), F.lower(n))


def has_prefix(c: Column, prefix: Column | str, case_sensitive: bool = False) -> Column:
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.startswith(c, p) if case_sensitive else F.startswith(F.lower(c), F.lower(p))


@F.pandas_udf(StringType())
def truncate_utf8(texts: pd.Series, limits: pd.Series) -> pd.Series:
    """At most so many bytes, cut before the character that would pass them."""
    return pd.Series([None if t is None else t.encode()[:n].decode(errors="ignore") for t, n in zip(texts, limits, strict=True)])


def matches(c: Column, pattern: str, case_sensitive: bool = True, regex: bool = False) -> Column:
    """All non-overlapping matches in a line, as an array of byte positions [start, end).

    Where case does not matter, letters match as Unicode folds them, and positions are those of the line itself. Patterns that are blank or over 512 bytes
    are rejected, as are look-around and back-references, which not every engine has.
    """
    if not pattern.strip() or len(pattern.encode()) > 512:
        raise ValueError("the pattern is blank or too long")
    if regex and re.search(r"\(\?(?:[=!]|<[=!]|P=)|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    flags = 0 if case_sensitive else re.IGNORECASE
    source = pattern if regex else re.escape(pattern)

    def find(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = re.compile(source, flags)
        for s in series:
            out = []
            for line in s:
                if line is None:
                    out.append([])
                    continue
                ascii_ = line.isascii()
                out.append([{"start": a if ascii_ else len(line[:a].encode()), "end": b if ascii_ else len(line[:b].encode())} for a, b in (m.span() for m in own.finditer(line)) if b > a])
            yield pd.Series(out)

    find.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(find, "array<struct<start:int,end:int>>")(c)


def literal_matches(c: Column, needle: str) -> Column:
    """Byte positions [start, end) of a literal's non-overlapping matches, by built-in functions alone."""
    n = F.octet_length(F.lit(needle))
    parts = F.split(c, re.sub(r"([^0-9A-Za-z\s\x80-\U0010FFFF])", r"\\\1", needle), -1)  # each sign by itself: \\Q would end at a \\E
    ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.expr("cast(array() as array<struct<start:int,end:int>>)"), lambda acc, p: F.concat(acc, F.array(F.struct((F.coalesce(F.element_at(acc, F.when(F.size(acc) > 0, -1))["end"], F.lit(0)) + F.octet_length(p)).cast("int").alias("start"), (F.coalesce(F.element_at(acc, F.when(F.size(acc) > 0, -1))["end"], F.lit(0)) + F.octet_length(p) + n).cast("int").alias("end")))))
    return ends


def clean_comment(c: Column) -> Column:
    """Comment text without its markers, white space collapsed."""
    x = F.regexp_replace(c, r"(?m)^\s*(//+!?|/\*+|\*+/|\*|#+|;+)\s?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\*+/\s*$", ""), r"\s+", " "))


def shortened(c: Column, limit: int = 48) -> Column:
    """At most `limit` characters, the last an ellipsis if any are cut."""
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)
