"""Long paths and cycles, Unicode case, byte columns, budgets."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import paths
from lodestar.operators import graph, quality, search
from lodestar.streaming.session import RevisionStore


def test_long_paths_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 81)] + [(100, 101), (101, 100), (102, 100)], "child int, parent int")
    got = {r.id: r.path for r in graph.paths_to_roots(chain).collect()}
    assert all(got[i] == list(range(i + 1)) for i in range(81))
    assert got[100] == [101, 100] and got[102] == [101, 100, 102]


def test_text_search_folds_and_counts_bytes(spark):
    f = spark.createDataFrame([("a", "İ foo\nÉté 12"), ("b", "x ١٢")], "path string, content string")
    assert [(r.line, r.column) for r in search.find_text(f, "FOO", case_sensitive=False).collect()] == [(1, 4)]
    assert [(r.path, r.line) for r in search.find_text(f, "é", case_sensitive=False, regex=True).collect()] == [("a", 2), ("a", 2)]
    assert sorted((r.path, r.match_bytes) for r in search.find_text(f, r"\d+", regex=True).collect()) == [("a", 2), ("b", 4)]


def test_budgets(spark):
    rows = spark.createDataFrame([(1, "x" * 200), (2, "y")], "id int, text string")
    assert [r.id for r in search.budgeted_page(rows, ["id"], max_bytes=5000).collect()] == [1, 2]
    for wrong in ({"max_bytes": 50}, {"max_items": 10**6}, {"max_items": 0}):
        with pytest.raises(ValueError):
            search.budgeted_page(rows, ["id"], **wrong)


def test_excluded_directories(spark):
    f = spark.createDataFrame([("a/.NOX/x",), ("tmp/y",), ("src/__pycache__/z",), ("a/b",)], "path string")
    assert {r.path for r in f.filter(~paths.in_excluded_directory(F.col("path"))).collect()} == {"src/__pycache__/z", "a/b"}


def test_a_failed_provider_takes_only_its_own_metrics(spark):
    metrics = spark.createDataFrame([("s1", "lines", 5), ("s1", "calls", 7)], "subject string, metric string, value long")
    c = quality.Catalog()
    c.provider("lines", "1", lambda ctx: ctx["m"].filter("metric = 'lines'"), ["lines"])
    c.provider("calls", "1", lambda ctx: ctx["nothing"], ["calls", "depth"])
    c.provider("depth", "1", lambda ctx: ctx["m"].select("no_such_column"), ["depth"])
    for name in ("lines", "calls", "depth"):
        c.rule(name, "1", lambda ctx, m, n=name: m.filter(m.metric == n).select("subject", "metric"), [name])
    c.rule("any", "1", lambda ctx, m: m.select("subject", "metric"))
    findings, coverage, diagnostics = c.run({"m": metrics})
    assert sorted(tuple(r) for r in findings.collect()) == [("s1", "lines"), ("s1", "lines")]
    assert {r["rule_id"]: (r["status"], r["reason"]) for r in coverage} == {"lines": ("observed", ""), "calls": ("not_evaluable", "calls"), "depth": ("not_evaluable", "calls, depth"), "any": ("partial", "calls, depth")}
    assert [d["provider"] for d in diagnostics] == ["calls", "depth"]
    broken = quality.Catalog()
    broken.provider("p", "1", lambda ctx: ctx["nothing"])
    broken.rule("r", "1", lambda ctx, m: m)
    assert broken.run({})[0] is None and broken.run({})[1][0]["status"] == "not_evaluable"
    with pytest.raises(ValueError, match="nothing"):
        broken.evaluate({})


def test_revisions_outlive_their_store(spark, tmp_path):
    path = f"file://{tmp_path}/revisions"
    first = RevisionStore(spark, path)
    assert first.publish(spark.range(1), "one") == 1 and first.publish(spark.range(2), "two") == 2
    spark.range(9).write.parquet(f"{path}/revision=3")  # died before its digest was written
    again = RevisionStore(spark, path)
    assert again.revisions == ["one", "two"] and again.publish(spark.range(2), "two") == 2
    assert again.publish(spark.range(3), "three") == 3 and [again.read(n).count() for n in (1, 2, 3)] == [1, 2, 3]
