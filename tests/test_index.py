"""Source index: batches taken whole or not at all, manifests, ids across batches, coverage and digests."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators.index import SHAPES, SourceIndex


def facts(spark, **rows):
    return {k: spark.createDataFrame(v, SHAPES[k]) for k, v in rows.items()}


def states(df):
    return {r.batch: (r.status, dict(r.problems)) for r in df.collect()}


FILES = [("a", "f1", "x/1", 10), ("b", "f2", "x/2", 5), ("c", "f3", "x/3", 7), ("d", "f4", "x/4", 3), ("e", "f1", "x/5", 9), ("g", "f7", "x/7", 4), ("h", "f8", "x/8", 4)]
SYMBOLS = [("a", "s1", "f1", "k1", 1, 10), ("b", "s2", "f2", "k2", 2, 6), ("c", "s3", "f3", "k3", 1, 1), ("c", "s3", "f3", "k3", 2, 2), ("d", "s4", "f9", "k4", 1, 1), ("g", "s7", "f7", "k7", 3, 3), ("h", None, "f8", "k8", 1, 2), ("j", "s9", "f1", "k9", 1, 1)]
RELATIONS = [("a", "r1", "s1", "k7"), ("g", "r2", "s7", "k2"), ("i", "r3", "s99", "k1"), ("g", "r4", "s7", "k1"), ("k", "r5", "s1", "k1")]


def test_batches_are_taken_whole(spark, tmp_path):
    index = SourceIndex(spark, f"file://{tmp_path}/index")
    assert index.manifest().count() == index.facts("files").count() == 0
    got = states(index.append("one", facts(spark, files=FILES, symbols=SYMBOLS, relations=RELATIONS)))
    assert got == {
        "a": ("committed", {}), "b": ("rejected", {"symbols:bad_span": 1}), "c": ("rejected", {"symbols:repeated_id": 1}), "d": ("rejected", {"symbols:no_file": 1}), "e": ("rejected", {"files:repeated_id": 1}),
        "g": ("committed", {}), "h": ("rejected", {"symbols:no_id": 1}), "i": ("rejected", {"relations:no_source": 1}),
        "j": ("rejected", {"symbols:no_file": 1}), "k": ("rejected", {"relations:no_source": 1}),  # both stand on batch a
    }
    assert {r.file_id for r in index.facts("files").collect()} == {"f1", "f7"} and {r.symbol_id for r in index.facts("symbols").collect()} == {"s1", "s7"}
    assert {r.relation_id: (r.to_id, r.status) for r in index.relations().collect()} == {"r1": ("s7", "resolved"), "r2": (None, "missing"), "r4": ("s1", "resolved")}


def test_later_appends_see_earlier_ones(spark, tmp_path):
    index = SourceIndex(spark, f"file://{tmp_path}/index")
    index.append("one", facts(spark, files=FILES[:1], symbols=SYMBOLS[:1], relations=RELATIONS[:1]))
    first = index.digest()
    again = index.append("one", facts(spark, files=[("z", "f0", "x/0", 1)]))  # a name is used once
    assert states(again) == {"a": ("committed", {})} and index.digest() == first
    two = states(index.append("two", facts(spark, files=[("p", "f1", "y", 2), ("q", "f5", "z", 9)], symbols=[("q", "s5", "f1", "k7", 4, 4), ("r", "s6", "f5", "k7", 9, 9)])))
    assert two == {"p": ("rejected", {"files:known_id": 1}), "q": ("committed", {}), "r": ("rejected", {"symbols:no_file": 1})}
    three = states(index.append("three", facts(spark, symbols=[("r", "s6", "f5", "k7", 9, 9), ("t", "s8", "f5", "k9", 9, 10)])))
    assert three == {"r": ("committed", {}), "t": ("rejected", {"symbols:bad_span": 1})}
    assert {r.relation_id: r.status for r in index.relations().collect()} == {"r1": "ambiguous"}
    cover = {r.capability: (r.batches, r.committed, r.status) for r in index.coverage(F.when(F.col("batch").isin("p", "q"), "files").otherwise("symbols")).collect()}
    assert cover["files"] == (2, 1, "partial")
    other = SourceIndex(spark, f"file://{tmp_path}/other")
    other.append("all", facts(spark, files=[("m", "f1", "x/1", 10), ("m", "f5", "z", 9)], symbols=[("m", "s1", "f1", "k1", 1, 10), ("m", "s5", "f1", "k7", 4, 4), ("m", "s6", "f5", "k7", 9, 9)], relations=[("m", "r1", "s1", "k7")]))
    same = {r.symbol_id for r in index.facts("symbols").collect()} == {"s1", "s5", "s6"}
    assert same and other.digest() == index.digest() != first


def test_an_append_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    index = SourceIndex(spark, f"file://{tmp_path}/index")
    monkeypatch.setattr(SourceIndex, "judged", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.append("one", facts(spark, files=FILES[:1]))
    monkeypatch.undo()
    assert index.manifest().count() == 0 and index.facts("files").count() == 0
    assert states(index.append("one", facts(spark, files=FILES[1:2]))) == {"b": ("committed", {})}
    assert [r.file_id for r in index.facts("files").collect()] == ["f2"]
    with pytest.raises(Exception, match="without a batch"):
        index.append("two", facts(spark, files=[(None, "f", "x", 1)]))
    with pytest.raises(ValueError):
        index.append("a/b", {})
