"""Passages between later documents, negative doc_ids, and the part of the index in the result."""

import random

from lodestar.llm import substring

from .test_operators import brute_substrings


def removed(spark, data):
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring.dedup_substrings(frame).collect()}


def test_negative_ids(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    got = removed(spark, [(-3, passage), (-1, f"a {passage}"), (5, f"{passage} b")])
    assert [got[i][1] for i in (-3, -1, 5)] == [0, 20, 20]


def test_anchor_in_a_first_document_without_the_window(spark, monkeypatch):
    """Few words, so that anchors repeat in many contexts: windows shared by later documents only must be found as well."""
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    r = random.Random(5)
    part = [[r.choice("abcd") for _ in range(7)] for _ in range(12)]
    data = [(i * 3 - 40, " ".join(w for _ in range(8) for w in r.choice(part))) for i in range(40)]
    assert removed(spark, data) == brute_substrings(data)


def test_heavy_passage(spark, monkeypatch):
    from lodestar.llm import shared

    monkeypatch.setattr(shared, "HEAVY_ROWS", 5)
    monkeypatch.setattr(shared, "HEAVY_KEYS", 20)
    r = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(30))
    data = [(i, " ".join(str(r.random()) for _ in range(9)) + " " + passage + " " + " ".join(str(r.random()) for _ in range(9))) for i in range(60)] + [(100 + i, passage + " same end of some length") for i in range(30)]
    assert removed(spark, data) == brute_substrings(data)


def test_the_index_decides(spark, monkeypatch):
    """With an index that finds nothing, nothing is removed."""
    import numpy as np

    passage = " ".join(f"w{i}" for i in range(20))
    frame = spark.createDataFrame([(1, passage), (2, passage)], "doc_id long, text string")
    assert sum(r["n_removed"] for r in substring.dedup_substrings(frame).collect()) == 20

    class Blind(substring.FMIndex):
        def owners(self, words, first):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)

    monkeypatch.setattr(substring, "FMIndex", Blind)
    assert sum(r["n_removed"] for r in substring.dedup_substrings(frame).collect()) == 0
