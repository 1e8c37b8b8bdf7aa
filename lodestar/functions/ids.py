"""Identities and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def nul_joined(*parts: Column | str) -> Column:
    return F.concat_ws(NUL, *[_text(p) for p in parts])


def stable_id(kind: str, *parts: Column | str) -> Column:
    """`model:<kind>:` and 16 hex digits of the SHA-256 of kind and parts, NUL between them; a null part is empty."""
    return F.concat(F.lit(f"model:{kind}:"), F.substring(F.sha2(nul_joined(F.lit(kind), *parts), 256), 1, 16))


def digest_part(*parts: Column | str) -> Column:
    return F.substring(F.sha2(nul_joined(*parts), 256), 1, 24)


def digest_list(values: Column) -> Column:
    """SHA-256 of an array's values, each followed by NUL."""
    return F.sha2(F.concat_ws("", F.transform(values, lambda x: F.concat(x, F.lit(NUL)))), 256)


def percent_encoded(c: Column) -> Column:
    """RFC 3986: unreserved characters stay, every other byte is %HH."""
    e = F.url_encode(c)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def namespaced(scope: Column, local: Column) -> Column:
    return F.concat(scope, F.lit("::"), percent_encoded(local))


def finding_key(*parts: Column | str) -> Column:
    """Identity of a finding: `|` between its parts; positions and baselines are not among them, so it survives edits."""
    return F.concat_ws("|", *[_text(p) for p in parts])
