"""Edge cases of the fact operators: unknowns, cycles of aliases, bounds, empty tables, repeated rows."""

from pyspark.sql import functions as F

from lodestar.operators import facts


def test_typed_values(spark):
    texts = ["2", "2.0", "2.5", "1e3", '"2"', "true", "9223372036854775807", "9223372036854775808", "1e400", "NaN", "01", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").select("i", facts.integer_value(F.col("j")).alias("n"), facts.decimal_value(F.col("j")).alias("d"))
    got = [(r.n, r.d) for r in rows.orderBy("i").collect()]
    assert [n for n, _ in got] == [2, 2, None, 1000, None, None, 2**63 - 1, None, None, None, None, None, None]
    assert [d for _, d in got[:4]] == [2.0, 2.0, 2.5, 1000.0] and [d for _, d in got[8:]] == [None] * 5


def test_large_and_quoted_values(spark):
    numbers = {"9007199254740993.0": 9007199254740993, "9.007199254740993e15": 9007199254740993, "-9223372036854775808.00": -(2**63), "2.0000000001": None, "1e-3": None, "-0.0": 0, "9223372036854775808.0": None}
    rows = spark.createDataFrame([(t,) for t in numbers], "j string").select("j", facts.integer_value(F.col("j")).alias("n"))
    assert {r.j: r.n for r in rows.collect()} == numbers
    texts = {'"a"': True, '"a"b"': False, '"a\\"b"': True, '""': True, '"': False, '"a" ,"b"': False, "a": False, "1": False, None: False}
    rows = spark.createDataFrame([(t,) for t in texts], "j string").select("j", facts.valid_metric_value(F.lit("text"), F.col("j")).alias("ok"))
    assert {r.j: r.ok for r in rows.collect()} == texts


def test_conditions(spark):
    chains = {"": True, "if False: -> if os.name:": False, "if os.name: -> if False:": False, "if True: -> if os.name:": None, "if sys.version_info >= (3, 8):": True, "elif sys.version_info==(3,11):": False}
    rows = spark.createDataFrame([(c,) for c in chains], "c string").select("c", facts.python_condition(F.col("c"), F.lit(10)).alias("known"), facts.python_condition(F.col("c"), F.lit(None).cast("int")).alias("unknown"))
    got = {r.c: (r.known, r.unknown) for r in rows.collect()}
    assert {c: k for c, (k, _) in got.items()} == chains
    assert got["if sys.version_info >= (3, 8):"][1] is None


def test_paths(spark):
    rows = [("", "a/./b"), (".", "./"), ("x\\y", "../z"), (" ./r ", "")]
    got = [r.p for r in spark.createDataFrame(rows, "r string, v string").select(facts.aggregate_path(F.col("r"), F.col("v")).alias("p")).collect()]
    assert got == ["a/b", ".", "x/z", "r"]


def test_bounded_diagnostics(spark):
    def bounded(n):
        rows = spark.createDataFrame([(i, "c", f"m{i}") for i in range(n)], "i int, code string, message string")
        return [r.message for r in facts.bounded_diagnostics(rows, ["i"], most=3).collect()]

    assert bounded(0) == [] and bounded(3) == ["m0", "m1", "m2"]
    assert bounded(4) == ["m0", "m1", "Additional diagnostics were omitted."]


def test_attached_diagnostics(spark):
    d = spark.createDataFrame([("c", "w", "m", "s", "./a", "1")] * 2 + [("c", "w", "m", "s", "", "1")], "code string, severity string, message string, subject string, path string, position string")
    s = spark.createDataFrame([("s2", "x/../a"), ("s1", "a"), ("s1", "a")], "source_id string, path string")
    assert sorted((r.path, r.source_ids) for r in facts.attached_diagnostics(d, s).collect()) == [("", []), ("a", ["s1", "s2"])]


def test_reports_without_identities_are_compatible(spark):
    none = spark.createDataFrame([], "rule string")
    one = spark.createDataFrame([(None,)], "rule string")
    assert facts.compatible(none, none, ["rule"]).first()[0] and facts.compatible(one, one, ["rule"]).first()[0]
    assert not facts.compatible(none, one, ["rule"]).first()[0]


def test_sequence_order(spark):
    pairs = [("9", "10", True), ("010", "9", False), ("a", "10", False), ("18446744073709551615", "18446744073709551616", True), ("18446744073709551616", "9", True), ("18446744073709551614", "18446744073709551615", True), ("7", "7", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.want == r.got for r in rows.withColumn("got", facts.sequence_less(F.col("a"), F.col("b"))).collect())


def test_build_constraints(spark):
    texts = ["", "package a\n//go:build x", "\n//go:build b\r\n\t// +build a \n// other\npackage p\n//go:build late", "//go:build only", "//\n" * 100 + "//go:build late"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(facts.build_constraints(F.col("t")).alias("c")).collect()]
    assert got == [[], [], ["a", "b"], ["only"], []]


def test_file_ends(spark):
    rows = [("s", "m", "f1", "a\r\nbé"), ("s", "m", "f2", ""), ("s", "m", "f3", "x\ry\n"), ("s", "", "f4", "x"), ("s", None, "f5", "x")]
    got = facts.module_file_relations(spark.createDataFrame(rows, "scope_id string, module_id string, file_id string, content string"))
    assert {r.file_id: (r.end_byte, r.end_line, r.end_column) for r in got.collect()} == {"f1": (6, 2, 4), "f2": (0, 1, 1), "f3": (4, 3, 1)}


def plain_use(path, here, own, package, modules, crates):
    parts, name = path.split("::"), lambda x: x.strip().lower().replace("_", "-")
    head, tail, outer = parts[0], parts[1:], list(here)
    if head == "crate":
        tries = [(tail, min(1, len(tail)))]
    elif head == "self":
        tries = [(here + tail, len(here) + min(1, len(tail)))]
    elif head == "super":
        while parts and parts[0] == "super":
            outer, parts = outer[:-1], parts[1:]
        tries = [(outer + parts, len(outer) + 1)] if parts else []
    else:
        tries = [(tail, min(1, len(tail))) if name(head) == name(package) else (parts, 1)]
        tries += [(here[:n] + parts, 1) for n in range(len(here), -1, -1)]
    for whole, least in tries:
        for n in range(len(whole), least - 1, -1):
            found = modules.get("::".join(whole[:n]))
            if found is not None and (n or found != own):
                return found, "local"
    if head in ("crate", "self", "super"):
        return None, "unresolved"
    return None, "standard_library" if head in facts.STANDARD_CRATES else "external" if name(head) in crates else "unresolved"


def test_rust_uses(spark):
    modules = {"": 0, "a": 1, "a::b": 2, "a::b::c": 3, "d": 4, "a::d": 5, "std::x": 6}
    paths = ["crate", "crate::a::b::T", "crate::z", "self", "self::c::F", "self::q", "super", "super::d::T", "super::super::d", "super::super::super::super::a", "a", "d::T", "b::c", "my_crate", "my-crate::a::X", "my_crate::zz", "std::fs", "std::x::y", "serde::Ser", "serde_json", "other::X", "superb::x", "selfie", ""]
    rows, want = [], {}
    for here, own in [("", 0), ("a", 1), ("a::b", 2), ("a::b::c", 3), ("d", 4)]:
        for p in paths:
            at = here.split("::") if here else []
            rows.append((len(rows), own, at, p, "my_crate"))
            want[len(rows) - 1] = plain_use(p, at, own, "my_crate", modules, {"serde", "serde-json"}) if p else (None, "unresolved")
    uses = spark.createDataFrame(rows, "use_id int, module_id int, module_path array<string>, path string, package string")
    known = spark.createDataFrame([(m, k) for k, m in modules.items()], "module_id int, key string")
    got = facts.resolved_uses(uses, known, spark.createDataFrame([("serde",), ("Serde_json",)], "name string")).collect()
    bad = {(rows[r.use_id][2:4].__repr__()): ((r.module_id_used, r.scope), want[r.use_id]) for r in got if (r.module_id_used, r.scope) != want[r.use_id]}
    assert len(got) == len(rows) and not bad, bad
