"""Rust module trees: `mod` items read from sources, and the files they lead to from a crate's roots, as a fixpoint.

A file's items say where its modules' files must be, and only those files' items matter next. So the tree grows by rounds:
the items of the files found last are joined with the files that exist, until a round finds nothing new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.paths import cleaned
from lodestar.operators.tables import written

ITEMS = "path string, inline array<string>, name string, body boolean, override string, conditions array<string>, test_only boolean, line int"
RAW = re.compile(r'(?:br|cr|r)(#*)"')
WORD = re.compile(r"(?:r#)?[^\W\d]\w*")
ATTRIBUTE = re.compile(r"^\s*([\w:]+)\s*(.*?)\s*$", re.S)


def lexed(text: str) -> Iterator[tuple[str, int]]:
    """(token, offset) without comments, strings and characters: words, attributes `#[...]` whole, and single signs."""
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("//", i):
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            depth, i = 1, i + 2
            while i < n and depth:
                step = 2 if text[i : i + 2] in ("/*", "*/") else 1
                depth += {"/*": 1, "*/": -1}.get(text[i : i + 2], 0)
                i += step
        elif c in "rbc" and (m := RAW.match(text, i)):
            end = text.find('"' + m[1], m.end())
            i = n if end < 0 else end + 1 + len(m[1])
        elif c == '"':
            i = after_string(text, i)
        elif c == "'":
            m = re.compile(r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'])'", re.S).match(text, i)
            i = m.end() if m else i + 1  # else a lifetime
        elif c == "#" and (m := re.compile(r"#(!?)\s*\[").match(text, i)):
            start, depth, i = i, 1, m.end()
            while i < n and depth:
                if text[i] == '"':
                    i = after_string(text, i)
                    continue
                depth += (text[i] == "[") - (text[i] == "]")
                i += 1
            if not m[1]:  # an inner attribute belongs to what is around it
                yield text[start:i], start
        elif m := WORD.match(text, i):
            yield m[0].removeprefix("r#"), i
            i = m.end()
        else:
            if not c.isspace():
                yield c, i
            i += 1


def after_string(text: str, i: int) -> int:
    i += 1
    while i < len(text) and text[i] != '"':
        i += 2 if text[i] == "\\" else 1
    return i + 1


def arguments(text: str) -> list[str]:
    """The parts of a list between commas that stand in no brackets and no string."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        quoted ^= c == '"' and text[i - 1 : i] != "\\"
        if quoted:
            continue
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in (*out, text[start:].strip()) if x]


def test_only(condition: str) -> bool:
    """Whether a cfg condition can hold in tests alone: `test`, all() with such a part, any() of such parts only."""
    condition = condition.strip().lower()
    m = re.fullmatch(r"(all|any)\s*\((.*)\)", condition, re.S)
    if not m:
        return condition == "test"
    parts = [test_only(x) for x in arguments(m[2])]
    return bool(parts) and (any(parts) if m[1] == "all" else all(parts))


def modules_of(text: str) -> list[tuple]:
    """(inline, name, body, override, conditions, test_only, line) of the mod items of a file, in order; inline names the mods
    with a body around an item. What stands in other braces is no item of the file."""
    out: list[tuple] = []
    tokens = list(lexed(text))
    around: list[tuple[str | None, bool]] = []  # of each open brace: the mod it is the body of, and whether it is for tests alone
    attributes: list[str] = []
    i = 0
    while i < len(tokens):
        token, at = tokens[i]
        item = all(name is not None for name, _ in around)
        if token.startswith("#") and len(token) > 1:
            attributes.append(re.sub(r"^#\s*\[|\]$", "", token))
            i += 1
            continue
        if token == "mod" and item and i + 2 < len(tokens) and WORD.fullmatch(tokens[i + 1][0]) and tokens[i + 2][0] in ";{":
            name, body = tokens[i + 1][0], tokens[i + 2][0] == "{"
            named = [(m[1], m[2]) for a in attributes if (m := ATTRIBUTE.match(a))]
            conditions = [v.strip()[1:-1].strip() for k, v in named if k == "cfg" and v.startswith("(")]
            override = next((m[1] for k, v in named if k == "path" and (m := re.match(r'=\s*"((?:\\.|[^"\\])*)"', v))), None)
            only = any(map(test_only, conditions)) or any(t for _, t in around)
            out.append(([x for x, _ in around], name, body, override, conditions, only, text.count("\n", 0, at) + 1))
            if body:
                around.append((name, only))
            i += 3
            attributes = []
            continue
        if token == "{":
            around.append((None, False))
        elif token == "}" and around:
            around.pop()
        if token not in ("pub", "(", ")", "crate", "super", "self", "in", "unsafe"):  # what may stand between attributes and `mod`
            attributes = []
        i += 1
    return out


def mod_items(files: DataFrame) -> DataFrame:
    """The mod items of Rust files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, *x) for p, t in zip(pdf["path"], pdf["content"], strict=True) for x in modules_of(t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS.split(", ")])

    return files.select("path", "content").mapInPandas(run, ITEMS)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def under(base: Column, name: Column) -> Column:
    return F.when(base == "", name).otherwise(F.concat(base, F.lit("/"), name))


def module_dir(path: Column, name: Column) -> Column:
    """Where the modules of a module are looked for: beside a mod.rs, else in a folder of the module's name."""
    return F.when(F.lower(F.element_at(F.split(path, "/"), -1)) == "mod.rs", directory(path)).otherwise(under(directory(path), name))


def module_tree(files: DataFrame, roots: DataFrame, tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(crate, module, kind, file) of all modules that lead from the roots of crates, and (crate, file, line, code, subject) of
    what is wrong with their items.

    `files` (path, content) are those of a repository; `roots` (crate, folder, file) name a crate, the folder that it may not
    leave ('' for the repository) and a root file. `module` holds the names from the root, none for a root itself; kind is
    crate, file_module or inline_module. Items for tests alone are left out unless `tests`. Codes: `path_escapes` for a
    #[path] out of the folder, `source_missing` where no file is found, `circular` for a file that is a module around itself,
    which is not entered again.
    """
    items = written(mod_items(files.filter(F.endswith("path", F.lit(".rs")))).filter(F.lit(tests) | ~F.col("test_only")))
    exists = written(files.select(F.col("path").alias("candidate")).distinct())
    none = F.expr("cast(array() as array<string>)")
    frontier = written(roots.select("crate", "folder", none.alias("module"), "file").distinct().join(exists.withColumnRenamed("candidate", "file"), "file", "left_semi").select("crate", "folder", "module", "file", F.array("file").alias("trail")))
    seen, found, wrong = frontier, [frontier.select("crate", "module", F.lit("crate").alias("kind"), "file")], []
    while not frontier.isEmpty():
        met = written(frontier.join(items, frontier["file"] == items["path"]).drop("path"))
        child = F.concat("module", "inline", F.array("name"))
        found.append(met.filter("body").select("crate", child.alias("module"), F.lit("inline_module").alias("kind"), "file"))
        # a root's modules are looked for beside it, those of an inline module by its name
        own = F.when(F.size("inline") > 0, module_dir(F.col("file"), F.element_at("inline", -1))).when(F.size("module") == 0, directory(F.col("file"))).otherwise(module_dir(F.col("file"), F.element_at("module", -1)))
        wanted = F.when(F.col("override").isNotNull(), F.array(under(own, F.col("override")))).otherwise(F.array(under(own, F.concat("name", F.lit(".rs"))), under(own, F.concat("name", F.lit("/mod.rs")))))
        asked = met.filter("not body").select("crate", "folder", "trail", child.alias("child"), F.col("file").alias("by"), "line", "override", "name", wanted.alias("wanted"))
        asked = written(asked.withColumn("item", F.monotonically_increasing_id()))
        each = asked.select("item", "folder", F.posexplode("wanted").alias("place", "at")).withColumn("candidate", cleaned(F.col("at")))
        inside = (F.col("folder") == "") & ~F.startswith("candidate", F.lit("../")) | F.startswith("candidate", F.concat("folder", F.lit("/")))
        each = each.withColumn("inside", inside)
        best = each.filter("inside").join(exists, "candidate", "left_semi").groupBy("item").agg(F.min_by("candidate", "place").alias("target"))
        told = written(asked.join(best, "item", "left").join(each.groupBy("item").agg(F.bool_or("inside").alias("inside")), "item"))
        told = told.withColumn("again", F.coalesce(F.array_contains("trail", F.col("target")), F.lit(False)))
        code = F.when(F.col("again"), "circular").when(F.col("override").isNotNull() & ~F.col("inside"), "path_escapes").otherwise("source_missing")
        wrong.append(told.filter("target is null or again").select("crate", F.col("by").alias("file"), "line", code.alias("code"), F.coalesce("override", "name").alias("subject")))
        new = told.filter("target is not null and not again").select("crate", "folder", F.col("child").alias("module"), F.col("target").alias("file"), F.concat("trail", F.array("target")).alias("trail"))
        new = new.dropDuplicates(["crate", "module", "file"])  # with one trail: the names and files above a module decide it
        frontier = written(new.join(seen, ["crate", "module", "file"], "left_anti").select("crate", "folder", "module", "file", "trail"))
        seen = seen.unionByName(frontier)
        found.append(frontier.select("crate", "module", F.lit("file_module").alias("kind"), "file"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    bad = wrong[0] if wrong else out.select("crate", "file", F.lit(0).alias("line"), F.lit("").alias("code"), F.lit("").alias("subject")).limit(0)
    for more in wrong[1:]:
        bad = bad.unionByName(more)
    return out.distinct(), bad.distinct()
