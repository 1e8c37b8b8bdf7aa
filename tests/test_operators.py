import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, knowledge, model, planning, quality, search
from lodestar.sources import extract
from lodestar.sources import files as S


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long")


def random_graph(seed, n=30, m=60):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_layers_and_feedback(spark, seed):
    pairs = random_graph(seed)
    v, e = spark.range(30).toDF("id"), edges(spark, pairs)
    small = {r.id: r.component for r in graph.strong_components(v, e).collect()}
    assert {r.id: r.component for r in graph.strong_components(v, e, small=0).collect()} == small
    reach = {(r.start, r.id) for r in graph.reachability(e, v).collect()}
    assert small == {a: min(b for b in range(30) if (a, b) in reach and (b, a) in reach) for a in range(30)}
    fb = graph.feedback_edges(graph.strong_components(v, e), e)
    gone = {r.edge_id for r in fb.collect()}
    layer = {r.id: r.layer for r in graph.dependency_layers(v, e, fb).collect()}
    assert len(layer) == 30 and all(layer[a] > layer[b] for i, (a, b) in enumerate(pairs) if i not in gone and a != b)
    assert all(i in gone for i, (a, b) in enumerate(pairs) if a == b)


def test_forest_without_cycles(spark):
    parents = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (7, 6), (8, 8)], "child long, parent long")
    assert {tuple(r) for r in graph.parents_without_cycles(parents).collect()} == {(4, 1), (5, 4), (7, 6)}
    paths = {r.id: r.path for r in graph.paths_to_roots(graph.parents_without_cycles(parents)).collect()}
    assert paths == {1: [1], 4: [1, 4], 5: [1, 4, 5], 6: [6], 7: [6, 7]}


def test_coupling_with_externals(spark):
    e = edges(spark, [(1, 2), (1, 2), (1, 1), (2, 3)])
    ext = spark.createDataFrame([(3, "x"), (3, "x"), (3, "y")], "src long, reference string")
    got = {r.id: (r.efferent, r.afferent) for r in graph.coupling(spark.range(1, 5).toDF("id"), e, ext).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (2, 1), 4: (0, 0)}


def test_model_merge_and_validation(spark):
    obs = spark.createDataFrame([("a", 2, "late", ["y"], {"k": "2", "z": "9"}), ("a", 1, "first", ["x", "y"], {"k": "1"}), ("b", 3, None, [], {})], "id string, ord int, name string, tags array<string>, meta map<string,string>")
    got = {r.id: (r.name, r.tags) for r in model.merge_observations(obs, "id", "ord", ["name"], ["tags"]).collect()}
    assert got == {"a": ("first", ["x", "y"]), "b": (None, [])}
    assert {r.id: r.meta for r in model.merge_metadata(obs, "id", "ord", "meta").collect()} == {"a": {"k": "1", "z": "9"}}
    assert [r.id for r in model.conflicts(obs, "id", ["name"]).collect()] == ["a"]
    bad = model.violations({"modules": spark.createDataFrame([("a",), ("a",)], "id string"), "relationships": spark.createDataFrame([("e", "a", "q"), ("f", "r", None)], "edge_id string, src string, dst string")})
    assert {tuple(r) for r in bad.collect()} == {("module-id-repeats", "a"), ("source-unknown", "f"), ("target-unknown", "e")}


def test_quality_trichotomy_and_catalog(spark):
    m = spark.createDataFrame([("a", "file_lines", 501), ("b", "file_lines", 500), ("c", "file_lines", None)], "subject string, metric string, value long")
    rule = quality.threshold_rule("source:file.max-lines")
    assert [r.subject for r in quality.threshold_findings(m, rule).collect()] == ["a"]
    assert tuple(quality.rule_coverage(m.select("subject"), m, rule).head())[1:] == (3, 2, "partial")
    assert quality.rule_coverage(m.select("subject"), m.filter("value is null"), rule).head().status == "not_evaluable"
    with pytest.raises(ValueError):
        quality.Threshold("r", "m", -1)
    catalog = quality.default_catalog()
    catalog.provider("files", "1", compute := (lambda _: m))
    catalog.provider("files", "1", compute)
    with pytest.raises(ValueError):
        catalog.provider("files", "1", lambda _: m)
    catalog.provider("broken", "1", lambda c: c["absent"])
    assert [r.subject for r in catalog.evaluate({}).collect()] == ["a"]


def test_status_lattices(spark):
    df = spark.createDataFrame([("a", "observed"), ("a", "observed"), ("b", "observed"), ("b", "unsupported"), ("c", "unknown"), ("c", "not_evaluable"), ("d", "not_evaluable"), ("d", "observed")], "k string, s string")
    got = {r.k: (r.x, r.y) for r in df.groupBy("k").agg(quality.merged_status(F.col("s")).alias("x"), quality.merged_status(F.col("s"), False).alias("y")).collect()}
    assert got == {"a": ("observed", "observed"), "b": ("partial", "partial"), "c": ("unknown", "partial"), "d": ("not_evaluable", "partial")}


def test_selectors_are_disjunctions(spark):
    df = spark.createDataFrame([(1, ["t"], "a/b", 3), (2, [], "a/c/d", None)], "src_id long, src_tags array<string>, src_key string, src_layer int")
    pick = lambda s: [r.src_id for r in df.filter(s.matches("src")).collect()]
    S_ = quality.Selector
    assert pick(S_()) == [] and pick(S_(ids=[2], tags=["t"])) == [1, 2] and pick(S_(globs=["a/*"])) == [1] and pick(S_(layers=[3])) == [1]


def test_cursors_belong_to_a_query():
    d = search.query_digest({"q": 1, "cursor": "x"}, 3)
    assert d == search.query_digest({"q": 1}, 3) != search.query_digest({"q": 1}, 4)
    assert search.decode_cursor(search.encode_cursor(50, d), d) == 50 and search.decode_cursor("", d) == 0
    for bad in (search.encode_cursor(5, "other"), "???"):
        with pytest.raises(ValueError):
            search.decode_cursor(bad, d)


def test_nearest_comment(spark):
    c = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 5, "c")], "path string, line long, text string")
    a = spark.createDataFrame([("p", 3), ("p", 6), ("p", 9)], "path string, anchor long")
    assert {r.anchor: r.comment for r in search.nearest_comment(c, a).collect()} == {3: "a\nb", 6: "c", 9: None}


def test_text_search(spark):
    f = spark.createDataFrame([("p", "éx X\nnone\nxx")], "path string, content string")
    assert {(r.line, r.column) for r in search.find_text(f, "x", case_sensitive=False).collect()} == {(1, 3), (1, 5), (3, 1), (3, 2)}
    assert {(r.line, r.column) for r in search.find_literal(f, "x").collect()} == {(1, 3), (3, 1), (3, 2)}


def test_knowledge(spark):
    ok = "---\ntype: Service\ntitle: 'A'\nparents:\n  - p/q\nowner:\n  team: x\nrank: 1\n---\n[l](b.md) ![i](c.md) [u](https://x.y/z.md) [d](../d.md#s)"
    f = spark.createDataFrame([("s/a.md", ok), ("s/b.md", "no fence"), ("d.md", "---\ntype: T\n---\n")], "path string, content string")
    got = {r.concept_id: r for r in knowledge.concepts(f).collect()}
    assert got["s/a"].valid and got["s/a"].parents == ["p/q"] and got["s/a"].title == "A" and not got["s/b"].valid
    docs = f.withColumn("concept_id", F.regexp_replace("path", r"\.md$", ""))
    known = docs.select("concept_id")
    assert [(r.ordinal, r.to) for r in knowledge.resolve_links(knowledge.links(docs), known).orderBy("ordinal").collect()] == [(0, "s/b"), (1, None), (2, "d")]
    meta = F.lit('{"a": {"b": 1}, "t": ["x", "y"], "s": "Hello"}')
    row = spark.range(1).select(knowledge.metadata_field(meta, "a.b"), knowledge.metadata_contains(meta, "s", "ELL"), knowledge.metadata_contains(meta, "t", "y"), knowledge.metadata_contains(meta, "t", "q"), knowledge.metadata_equals(meta, "a.b", 1.0), knowledge.metadata_equals(meta, "s", "Hello")).head()
    assert tuple(row) == ("1", True, True, False, True, True)


def test_choice_and_priority(spark):
    c = spark.createDataFrame([("r", "go", 0.9, "a"), ("r", "go", 0.5, "b"), ("r", "py", 0.7, "c"), ("r", "py", 0.7, "d")], "root string, language string, conf double, id string")
    assert {r.language: (r.id, r.tied) for r in planning.choose(c, ["root", "language"], "conf", "id").collect()} == {"go": ("a", False), "py": (None, True)}
    s = spark.createDataFrame([("r", "cli", "x"), ("r", "automatic", "y")], "root string, source string, id string")
    assert [r.id for r in planning.consolidate(s, ["root"]).collect()] == ["x"]
    assert planning.layered_options({"a": 1, "b": 1}, {"b": 2}, {"c": 3}) == {"a": (1, "default"), "b": (2, "project"), "c": (3, "cli")}


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("import os\n")
    (tmp_path / "go.mod").write_text("module m\n")
    (tmp_path / "node_modules/x.js").write_text("1")
    t = S.tree(spark, str(tmp_path))
    assert {r.path: r.content for r in t.collect()} == {"src/a.py": "import os\n", "go.mod": "module m\n"}
    assert [(r.root, r.confidence) for r in S.root_candidates(t).collect()] == [(".", 1.0)]
    facts = {r.path: r for r in S.file_facts(t).collect()}
    assert facts["src/a.py"].language == "python" and facts["src/a.py"].lines == 1
    (tmp_path / "f.ndjson").write_text('{"a": 1}\n{"a": 2}\n')
    assert [r.a for r in S.read_ndjson(spark, str(tmp_path / "f.ndjson"), "a int").collect()] == [1, 2]
    S.write_json(str(tmp_path / "o/x.json"), {"b": 1, "a": 2})
    assert (tmp_path / "o/x.json").read_text() == '{"a":2,"b":1}\n'
    with pytest.raises(FileExistsError):
        S.write_json(str(tmp_path / "o/x.json"), {})
    d = spark.createDataFrame([("a", '{"id":"x","version":"1"}'), ("b", '{"id":"x","version":"1"}'), ("c", "{"), ("d", '{"id":"y","version":"1"}')], "path string, content string")
    assert {r.path: r.status for r in S.profiles(d).collect()} == {"a": "duplicate", "b": "duplicate", "c": "invalid", "d": "valid"}


def test_extraction(spark):
    py = "import os.path\nfrom . import b\nfrom ..q import z\nimport importlib\nimportlib.import_module('x.y')\n\ndef f(a):\n    'doc'\n    for i in a:\n        if i and a or 3:\n            pass\nclass C:\n    def _g(self): return 1\n"
    f = spark.createDataFrame([("pkg/a.py", "python", py), ("pkg/b.py", "python", ""), ("pkg/__init__.py", "python", ""), ("m.go", "go", 'import (\n\t"fmt"\n\tx "m.io/y"\n)\nimport "C"\n'), ("t.ts", "typescript", "import a from './a'\nexport {b} from \"b\"\nconst c = require('c'), d = import('d')\n"), ("l.rs", "rust", "use a::{b, c::{self, d as e}};\nmod m;\n"), ("c.clj", "clojure", "(ns x (:require [a.b :as b] [c.d]))")], "path string, language string, content string")
    got = {}
    for r in extract.imports(f).orderBy("path", "ordinal").collect():
        got.setdefault(r.path, []).append((r.target, r.kind))
    assert got["m.go"] == [("fmt", "import"), ("m.io/y", "import"), ("C", "import")]
    assert got["t.ts"] == [("./a", "import"), ("b", "export"), ("c", "require"), ("d", "dynamic")]
    assert got["l.rs"] == [("a::b", "use"), ("a::c", "use"), ("a::c::d", "use"), ("m", "mod")] and {x for x, _ in got["c.clj"]} == {"a.b", "c.d"}
    own = f.filter("language = 'python'")
    res = {r.full: (r.to_module, r.scope) for r in extract.resolve_python(extract.imports(own), extract.python_modules(own), ["os", "importlib"]).collect()}
    assert res["pkg.b"] == ("pkg.b", "local") and res["os.path"] == (None, "standard_library") and res["q.z"][1] == "unresolved" and res["x.y"][1] == "dynamic"
    sym = {r.qualified_name: r for r in extract.python_symbols(own).collect()}
    assert (sym["f"].complexity, sym["f"].nesting, sym["f"].documented, sym["C._g"].public) == (5, 2, True, False)
    assert extract.strip_jsonc('{"a": "//x", /* c */ "b": [1, 2,], // d\n}') .replace(" ", "").strip() == '{"a":"//x","b":[1,2]\n}'
    alias = extract.alias_target(spark.createDataFrame([("@app/x/y",), ("lib",), ("zzz",)], "specifier string"), spark.createDataFrame([("@app/*", "src/*"), ("@app/x/*", "x/*"), ("lib", "l/index")], "pattern string, target string"))
    assert {r.specifier: r.target for r in alias.collect()} == {"@app/x/y": "x/y", "lib": "l/index", "zzz": None}
    c = spark.createDataFrame([("k",)], "key string").select("key", extract.typescript_candidates(F.lit("src/a")).alias("candidates"))
    files = spark.createDataFrame([("src/a/index.ts",), ("src/a.js",)], "path string")
    assert extract.resolve_candidates(c, files).head().resolved == "src/a.js"
