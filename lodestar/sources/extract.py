"""Import and symbol facts from source text. Python is parsed; the other languages are read by their import forms."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMPORTS = "path string, ordinal int, target string, name string, level int, kind string, line int"
SYMBOLS = "path string, qualified_name string, kind string, public boolean, first_line int, last_line int, complexity int, nesting int, documented boolean"


def strip_jsonc(text: str) -> str:
    """JSON with `//` and `/* */` comments taken out, strings left alone; trailing commas too."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], out)


def python_imports(text: str) -> list[tuple]:
    """(target, name, level, kind, line) of imports and literal dynamic imports."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name, "", 0, "import", node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(node.module or "", a.name, node.level, "future" if node.module == "__future__" else "from", node.lineno) for a in node.names]
        elif isinstance(node, ast.Call) and ast.unparse(node.func) in ("__import__", "importlib.import_module", "import_module") and node.args:
            literal = isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str)
            out.append((node.args[0].value if literal else "", "", 0, "dynamic", node.lineno))
    return sorted(out, key=lambda x: x[4])


def _by_forms(text: str, forms: list[tuple[str, str]]) -> list[tuple]:
    found = [(m[1], "", 0, kind, text.count("\n", 0, m.start(1)) + 1) for pattern, kind in forms for m in re.finditer(pattern, text, re.M)]
    return sorted(set(found), key=lambda x: (x[4], x[0]))


def go_imports(text: str) -> list[tuple]:
    out = _by_forms(text, [(r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', "import")])
    for block in re.finditer(r"^\s*import\s*\(([^)]*)\)", text, re.M):
        base = text.count("\n", 0, block.start(1)) + 1
        out += [(m[1], "", 0, "import", base + block[1].count("\n", 0, m.start(1))) for m in re.finditer(r'^\s*(?:[\w.]+\s+)?"([^"]+)"', block[1], re.M)]
    return sorted(set(out), key=lambda x: (x[4], x[0]))


def typescript_imports(text: str) -> list[tuple]:
    return _by_forms(text, [(r"""^\s*import\s+(?:type\s+)?(?:[^'"();]*?\sfrom\s+)?['"]([^'"]+)['"]""", "import"), (r"""^\s*export\s+[^'"();]*?\sfrom\s+['"]([^'"]+)['"]""", "export"), (r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", "require"), (r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)""", "dynamic")])


def rust_imports(text: str) -> list[tuple]:
    """Leaves of `use` trees, and `mod` items."""
    out = []
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", text, re.M):
        line = text.count("\n", 0, m.start(1)) + 1
        out += [(leaf, "", 0, "use", line) for leaf in use_leaves(re.sub(r"\s+", " ", m[1]))]
    out += _by_forms(text, [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", "mod")])
    return sorted(out, key=lambda x: (x[4], x[0]))


def use_leaves(source: str) -> list[str]:
    """`a::{b, c::{d, self}}` as its paths, without aliases."""
    source = source.strip()
    if "{" not in source:
        leaf = re.split(r"\s+as\s+", source)[0].strip()
        return [leaf] if leaf else []
    head, rest = source.split("{", 1)
    body, depth, parts, part = rest.rsplit("}", 1)[0], 0, [], ""
    for c in body:
        if c == "," and not depth:
            parts.append(part)
            part = ""
            continue
        depth += (c == "{") - (c == "}")
        part += c
    parts.append(part)
    prefix = head.strip().removesuffix("::")
    leaves = [leaf for p in parts for leaf in use_leaves(p)]
    return [prefix if x == "self" else f"{prefix}::{x}" if prefix else x for x in leaves]


def clojure_imports(text: str) -> list[tuple]:
    """Namespaces in :require and :use, and required directly."""
    out = []
    for clause in re.finditer(r"\(:?(require|use)\s+([^()]*(?:\([^()]*\)[^()]*)*)\)", text):
        line = text.count("\n", 0, clause.start()) + 1
        out += [(m[1], "", 0, clause[1], line) for m in re.finditer(r"\[?'?\[?([A-Za-z][\w.\-]*\.[\w.\-]+|(?<=\[)[A-Za-z][\w.\-]*)", clause[2])]
    return sorted(set(out), key=lambda x: (x[4], x[0]))


EXTRACTORS = {"python": python_imports, "go": go_imports, "typescript": typescript_imports, "javascript": typescript_imports, "rust": rust_imports, "clojure": clojure_imports}


def register(language: str, extractor) -> None:
    """Another language's imports; one that is registered already cannot be replaced."""
    if EXTRACTORS.setdefault(language, extractor) is not extractor:
        raise ValueError(f"{language} has an extractor")


def imports(files: DataFrame) -> DataFrame:
    """Imports of files (path, language, content), in order; languages without an extractor give none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, i, *x) for p, lang, t in zip(pdf["path"], pdf["language"], pdf["content"], strict=True) for i, x in enumerate(EXTRACTORS[lang](t or ""))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in IMPORTS.split(", ")])

    return files.filter(F.col("language").isin(*EXTRACTORS)).select("path", "language", "content").mapInPandas(run, IMPORTS)


def complexity(node: ast.AST) -> tuple[int, int]:
    """(cyclomatic complexity, deepest control nesting) of a callable; nested callables are their own."""
    control = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
    decisions, deepest = 1, 0

    def walk(n: ast.AST, depth: int) -> None:
        nonlocal decisions, deepest
        for child in ast.iter_child_nodes(n):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue
            own = depth + isinstance(child, control)
            deepest = max(deepest, own)
            decisions += isinstance(child, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.comprehension))
            decisions += len(child.values) - 1 if isinstance(child, ast.BoolOp) else 0
            decisions += isinstance(child, ast.match_case) and not (isinstance(child.pattern, ast.MatchAs) and child.pattern.pattern is None)
            walk(child, own)

    walk(node, 0)
    return decisions, deepest


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes and callables of Python files with spans, visibility, documentation, complexity and nesting."""

    def of(path: str, text: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return
        todo = [(n, "") for n in tree.body]
        while todo:
            node, prefix = todo.pop(0)
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{node.name}" if prefix else node.name
                callable_ = not isinstance(node, ast.ClassDef)
                own = complexity(node) if callable_ else (None, None)
                yield (path, name, "callable" if callable_ else "class", not node.name.startswith("_"), node.lineno, node.end_lineno, *own, ast.get_docstring(node) is not None)
                todo += [(n, name) for n in node.body]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SYMBOLS.split(", ")]
        for pdf in parts:
            out = pd.DataFrame([r for p, t in zip(pdf["path"], pdf["content"], strict=True) for r in of(p, t or "")], columns=names)
            yield out.astype({"complexity": "Int32", "nesting": "Int32"})

    return files.filter(F.col("language") == "python").select("path", "content").mapInPandas(run, SYMBOLS)


def python_modules(files: DataFrame) -> DataFrame:
    """(path, module, package) of Python files: the dotted name, and whether it is a package."""
    p = F.regexp_replace("path", r"\.pyi?$", "")
    package = F.rlike("path", F.lit(r"(^|/)__init__\.pyi?$"))
    return files.filter(F.col("language") == "python").select("path", F.translate(F.regexp_replace(p, r"/?__init__$", ""), "/", ".").alias("module"), package.alias("package"))


def resolve_python(found: DataFrame, modules: DataFrame, stdlib: list[str]) -> DataFrame:
    """Imports with from_module, to_module (the longest known prefix of the imported name) and scope: local,
    standard_library, external or unresolved (a relative import that reaches nothing)."""
    own = found.join(modules.select("path", F.col("module").alias("from_module"), "package"), "path")
    parts = F.split("from_module", r"\.")
    up = F.size(parts) - F.col("level") + F.col("package").cast("int")
    base = F.when(F.col("level") == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(up, F.lit(0))), "."))
    joined = lambda *c: F.array_join(F.filter(F.array(*c), lambda x: x != ""), ".")
    full = own.withColumn("full", joined(base, F.col("target"), F.when(F.col("name") == "*", "").otherwise(F.col("name"))))
    pieces = F.split("full", r"\.")
    up_ = full.withColumn("key", F.monotonically_increasing_id()).withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, 1, k), "."))))
    met = up_.join(modules.select(F.col("module").alias("prefix"), F.lit(True).alias("known")), "prefix", "left")
    best = met.groupBy("path", "ordinal").agg(F.max_by(F.when(F.col("known"), F.col("prefix")), F.when(F.col("known"), F.length("prefix"))).alias("to_module"))
    out = full.join(best, ["path", "ordinal"])
    top = F.element_at(F.split(F.col("target"), r"\."), 1)
    scope = F.when(F.col("to_module").isNotNull(), "local").when(F.col("level") > 0, "unresolved").when(F.col("kind") == "dynamic", "dynamic").when(top.isin(*stdlib), "standard_library").otherwise("external")
    return out.select("path", "ordinal", "from_module", "full", "to_module", scope.alias("scope"))


def go_scope(target, module: str):
    """local, conditional for cgo, standard_library (no dot in the first segment) or external."""
    return F.when(target == "C", "conditional").when((target == module) | F.startswith(target, F.lit(f"{module}/")), "local").when(~F.contains(F.split(target, "/")[0], F.lit(".")), "standard_library").otherwise("external")


#: Confidence by scope of a Go or Python import.
CONFIDENCE = {"local": 1.0, "standard_library": 1.0, "external": 1.0, "conditional": 0.5, "dynamic": 0.2, "unresolved": 0.2}


def confidence_of(scope):
    return F.coalesce(F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p])[scope], F.lit(0.2))


def typescript_candidates(base, allow_js: bool = True):
    """Paths that an extensionless import may mean, in the order they are tried."""
    ends = [".ts", ".tsx", ".d.ts", *([".js", ".jsx"] if allow_js else [])]
    return F.array(base, *[F.concat(base, F.lit(e)) for e in ends], *[F.concat(base, F.lit(f"/index{e}")) for e in ends])


def resolve_candidates(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (key, candidates) with the first candidate that is a file, or null."""
    each = wanted.select("key", F.posexplode("candidates").alias("ord", "path"))
    met = each.join(files.select("path"), "path", "left_semi").groupBy("key").agg(F.min_by("path", "ord").alias("resolved"))
    return wanted.join(met, "key", "left")


def alias_target(specifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """specifiers (specifier) through path aliases (pattern with at most one `*`, target): the longest prefix wins."""
    a = aliases.select(F.split("pattern", r"\*")[0].alias("prefix"), F.contains("pattern", F.lit("*")).alias("star"), "target")
    cut = specifiers.select("specifier", F.explode(F.sequence(F.lit(0), F.length("specifier"))).alias("n")).withColumn("prefix", F.substring(F.col("specifier"), F.lit(1), F.col("n")))
    met = cut.join(a, "prefix").filter("star or n = length(specifier)")
    target = F.replace("target", F.lit("*"), F.substring(F.col("specifier"), F.col("n") + 1, F.length("specifier")))
    return specifiers.join(met.groupBy("specifier").agg(F.max_by(target, "n").alias("target")), "specifier", "left")
