"""Cargo manifests: packages, workspace members, dependencies with what they inherit, and the source files of targets.

A manifest is read by itself, in a function over its text; everything between manifests and files is joins.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.paths import ancestors, cleaned
from lodestar.sources.rust import directory, under

DEPENDENCY = "struct<name:string,kind:string,version:string,path:string,registry:string,optional:boolean,workspace:boolean,features:array<string>>"
TARGET = "struct<name:string,kind:string,path:string>"
MANIFEST = f"path string, package string, members array<string>, exclude array<string>, dependencies array<{DEPENDENCY}>, inherited array<{DEPENDENCY}>, targets array<{TARGET}>, problem string"
#: Tables of dependencies with their kind, and folders whose files are targets of a kind.
KINDS = {"dependencies": "normal", "dev-dependencies": "dev", "build-dependencies": "build"}
FOLDERS = {"src/bin": "bin", "tests": "test", "examples": "example", "benches": "bench"}


def text_or_none(value) -> str | None:
    return value if isinstance(value, str) else None


def texts(value) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def dependency(name: str, kind: str, value) -> dict:
    """One entry of a table of dependencies: a version, or a table."""
    v = value if isinstance(value, dict) else {"version": value}
    return {"name": name, "kind": kind, **{k: text_or_none(v.get(k)) for k in ("version", "path", "registry")}, "optional": v.get("optional") is True, "workspace": v.get("workspace") is True, "features": sorted(set(texts(v.get("features"))))}


def dependencies_of(doc: dict) -> list[dict]:
    """Those of a manifest, of its target-specific tables too, in order."""
    tables = [doc, *(t for t in doc.get("target", {}).values() if isinstance(t, dict))] if isinstance(doc.get("target", {}), dict) else [doc]
    return [dependency(n, kind, v) for t in tables for table, kind in KINDS.items() if isinstance(t.get(table), dict) for n, v in t[table].items()]


def manifest_of(content: str | None) -> tuple:
    """(package, members, exclude, dependencies, inherited, targets, problem) of a manifest's text."""
    try:
        doc = tomllib.loads(content or "")
    except tomllib.TOMLDecodeError as e:
        return None, [], [], [], [], [], str(e)
    table = lambda d, k: d.get(k) if isinstance(d.get(k), dict) else {}
    workspace, lib = table(doc, "workspace"), table(doc, "lib")
    targets = [{"name": text_or_none(lib.get("name")), "kind": "lib", "path": text_or_none(lib.get("path"))}] if lib else []
    targets += [{"name": text_or_none(b.get("name")), "kind": "bin", "path": text_or_none(b.get("path"))} for b in doc.get("bin", []) if isinstance(b, dict)] if isinstance(doc.get("bin", []), list) else []
    inherited = [dependency(n, "normal", v) for n, v in table(workspace, "dependencies").items()]
    return text_or_none(table(doc, "package").get("name")), texts(workspace.get("members")), texts(workspace.get("exclude")), dependencies_of(doc), inherited, targets, None


def manifests(files: DataFrame) -> DataFrame:
    """The manifests among files (path, content), with the folder that each is in ('' for the top)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, *manifest_of(t)) for p, t in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "package", "members", "exclude", "dependencies", "inherited", "targets", "problem"])

    own = files.filter(F.element_at(F.split("path", "/"), -1) == "Cargo.toml").select("path", "content")
    return own.mapInPandas(run, MANIFEST).withColumn("folder", directory(F.col("path")))


def like(path: Column, pattern: Column) -> Column:
    """A glob whose `*` and `?` stay within a segment, as a column; a `[` class is taken as it is."""
    escaped = F.regexp_replace(pattern, r"([.+(){}^$|\\])", r"\\$1")
    return F.rlike(path, F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$")))


def workspace_members(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workspace, member, package) of the folders that workspaces list, and (workspace, code, subject) of patterns that lead out
    (`member_escapes`), name no folder with a manifest (`member_missing`) or one without a package (`member_without_package`)."""
    roots = found.filter(F.size("members") > 0).select(F.col("folder").alias("workspace"), "exclude", F.explode("members").alias("given"))
    roots = roots.withColumn("given", F.trim("given")).filter("given <> ''").withColumn("clean", cleaned(F.col("given")))
    out = F.startswith("clean", F.lit("/")) | (F.col("clean") == "..") | F.startswith("clean", F.lit("../"))
    within = roots.filter(~out)
    # every manifest meets the workspaces above it: by equality with its folder's ancestors
    above = found.select("folder", "package", F.explode(F.array_distinct(F.transform(ancestors(under(F.col("folder"), F.lit("x"))), lambda a: F.when(a == ".", "").otherwise(a)))).alias("workspace"))
    relative = F.when(F.col("workspace") == "", F.col("folder")).when(F.col("workspace") == F.col("folder"), ".").otherwise(F.expr("substring(folder, length(workspace) + 2)"))
    met = within.join(above, "workspace").withColumn("relative", F.when(relative == "", ".").otherwise(relative)).filter(like(F.col("relative"), F.col("clean")))
    excluded = F.exists("exclude", lambda e: (F.col("relative") == e) | F.startswith("relative", F.concat(e, F.lit("/"))) | like(F.col("relative"), e))
    inside = met.filter(~excluded)
    members = inside.filter("package is not null").select("workspace", F.col("folder").alias("member"), "package").distinct()
    wild = F.rlike("clean", F.lit(r"[*?\[]"))
    lost = within.filter(~wild).join(met.select("workspace", "given"), ["workspace", "given"], "left_anti").select("workspace", F.lit("member_missing").alias("code"), F.col("given").alias("subject"))
    bare = inside.filter("package is null").select("workspace", F.lit("member_without_package").alias("code"), F.col("folder").alias("subject"))
    return members, roots.filter(out).select("workspace", F.lit("member_escapes").alias("code"), F.col("given").alias("subject")).unionByName(lost).unionByName(bare).distinct()


def dependencies(found: DataFrame, members: DataFrame) -> DataFrame:
    """(folder, name, kind, version, path, registry, optional, features, folder_used) of every package's dependencies.

    One that is marked as the workspace's takes the version, path and registry that it lacks, and further features, from the
    nearest workspace it is a member of; `folder_used` is the folder that a path leads to ('' for the top), null without a path
    or where it leads out of the repository.
    """
    own = found.filter("package is not null").select("folder", F.explode("dependencies").alias("d")).select("folder", "d.*")
    nearest = members.groupBy(F.col("member").alias("folder")).agg(F.max_by("workspace", F.length("workspace")).alias("workspace"))
    given = found.select(F.col("folder").alias("workspace"), F.explode("inherited").alias("i")).select("workspace", F.col("i.name").alias("name"), *[F.col(f"i.{c}").alias(f"w_{c}") for c in ("version", "path", "registry", "features")])
    j = own.withColumnRenamed("workspace", "marked").join(nearest, "folder", "left").join(given, ["workspace", "name"], "left")
    take = lambda c: F.when(F.col("marked") & F.col(c).isNull(), F.col(f"w_{c}")).otherwise(F.col(c))
    features = F.when(F.col("marked"), F.array_sort(F.array_union("features", F.coalesce("w_features", F.expr("cast(array() as array<string>)"))))).otherwise(F.col("features"))
    # a path of the workspace's is relative to the workspace
    base = F.when(F.col("path").isNull() & F.col("marked"), F.col("workspace")).otherwise(F.col("folder"))
    path = take("path")
    led = cleaned(F.when(path.isNotNull(), F.concat_ws("/", F.when(base != "", base), path)))
    to = F.when(led == ".", "").when(~(F.startswith(led, F.lit("/")) | (led == "..") | F.startswith(led, F.lit("../"))), led)
    return j.select("folder", "name", "kind", take("version").alias("version"), path.alias("path"), take("registry").alias("registry"), "optional", features.alias("features"), F.when(~F.startswith(path, F.lit("/")), to).alias("folder_used"))


def targets(found: DataFrame, files: DataFrame, more: bool = False) -> tuple[DataFrame, DataFrame]:
    """(folder, package, name, kind, file) of the targets of packages, and (folder, code, subject) of declared ones without a file
    (`target_missing`) or out of their folder (`target_outside`).

    Declared ones come first: [lib] and [[bin]] with their usual paths where none is given; then src/lib.rs, src/main.rs if no
    [[bin]] is declared, and the files of src/bin; of tests, examples and benches if `more`. A file is one target, of the first.
    """
    p = found.filter("package is not null")
    normal = lambda c: F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    each = p.select("folder", "package", F.posexplode("targets").alias("place", "t")).select("folder", "package", "place", "t.*")
    usual = F.when(F.col("kind") == "lib", "src/lib.rs").when(F.col("name").isNull() | (F.col("name") == "") | (normal(F.col("name")) == normal(F.col("package"))), "src/main.rs").otherwise(F.concat(F.lit("src/bin/"), "name", F.lit(".rs")))
    declared = each.select("folder", "package", "place", F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.col("package")).alias("name"), "kind", cleaned(F.when(F.coalesce("path", F.lit("")) != "", F.col("path")).otherwise(usual)).alias("relative"), F.lit(True).alias("declared"))
    has = F.exists("targets", lambda t: t["kind"] == "bin")
    lib = F.exists("targets", lambda t: (t["kind"] == "lib") & t["path"].isNotNull())
    found_ = p.select("folder", "package", F.explode(F.filter(F.array(F.when(~lib, F.struct(F.lit("lib").alias("kind"), F.lit("src/lib.rs").alias("relative"))), F.when(~has, F.struct(F.lit("bin").alias("kind"), F.lit("src/main.rs").alias("relative")))), lambda x: x.isNotNull())).alias("t"))
    implied = found_.select("folder", "package", F.lit(1 << 20).alias("place"), F.col("package").alias("name"), "t.kind", "t.relative", F.lit(False).alias("declared"))
    kinds = F.create_map(*[F.lit(x) for f, k in FOLDERS.items() if more or k == "bin" for x in (f, k)])
    stem = F.regexp_extract("path", r"([^/]+)\.rs$", 1)
    parts = F.split("path", "/")
    here = files.filter(F.endswith("path", F.lit(".rs"))).select("path", stem.alias("name"), F.explode(F.array(F.lit(1), F.lit(2))).alias("deep"), parts.alias("parts")).filter("size(parts) > deep")
    here = here.select("path", "name", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("deep") - 1), "/").alias("folder"), F.array_join(F.slice("parts", F.size("parts") - F.col("deep"), F.col("deep")), "/").alias("of")).withColumn("kind", kinds[F.col("of")]).filter("kind is not null")
    listed = here.join(p.select("folder", "package"), "folder").select("folder", "package", F.lit((1 << 20) + 1).alias("place"), "name", "kind", F.concat("of", F.lit("/"), "name", F.lit(".rs")).alias("relative"), F.lit(False).alias("declared"))
    all_ = declared.unionByName(implied).unionByName(listed)
    outside = F.startswith("relative", F.lit("/")) | (F.col("relative") == "..") | F.startswith("relative", F.lit("../")) | F.contains("relative", F.lit(":"))
    j = all_.withColumn("outside", outside).withColumn("file", under(F.col("folder"), F.col("relative"))).join(files.select(F.col("path").alias("file"), F.lit(True).alias("exists")).distinct(), "file", "left")
    good = j.filter("exists and not outside").groupBy("folder", "package", "file").agg(F.min_by(F.struct("name", "kind"), F.struct("place", "kind", "name")).alias("t")).select("folder", "package", "t.name", "t.kind", "file")
    bad = j.filter("declared and (outside or exists is null)").select("folder", F.when(F.col("outside"), "target_outside").otherwise("target_missing").alias("code"), F.col("relative").alias("subject")).distinct()
    return good, bad
