"""Buckets split by second ones, tiles of few members, and components solved by rounds of joins."""

import random

from lodestar.llm import components, neardup

from .test_operators import brute_components, table


def data():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(120)]
    out = [[word() for _ in range(r.randint(2, 30))] + passage + [word() for _ in range(r.randint(0, 5))] for _ in range(60)]
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = word()
        out.append(w)
    out += out[:5]
    return [(i - 20, " ".join(w), None) for i, w in enumerate(out)]


def test_split_buckets_and_tiles(spark, monkeypatch):
    rows = data()
    want = {d: c for d, (_, c, _) in brute_components(rows).items()}
    df = table(spark, rows).cache()
    for k, v in {"FAR_CELL": 3, "SPLIT_FROM": 8, "SPLITS": 1, "AT_ONCE": 4}.items():
        monkeypatch.setattr(neardup, k, v)
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df).collect()} == want
    assert len(set(want.values())) < len(rows) - 40


def test_crowded_tiles(spark, monkeypatch):
    """Families of texts that share three fifths, in buckets around other centres."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(4):
        base = [word() for _ in range(80)]
        out += [base + [word() for _ in range(r.choice([4, 18, 19, 20]))] for _ in range(25)]
    rows = [(i, " ".join(w), None) for i, w in enumerate(out)]
    want = {d: c for d, (_, c, _) in brute_components(rows).items()}
    df = table(spark, rows).cache()
    for k, v in {"CROWD": 0, "ROUNDS": 3}.items():
        monkeypatch.setattr(neardup, k, v)
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df).collect()} == want


def test_components_by_rounds(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    frame = spark.createDataFrame(edges, "a long, b long")
    few = dict(map(tuple, components.components(frame).collect()))
    monkeypatch.setattr(components, "SMALL_EDGES", 0)
    assert dict(map(tuple, components.components(frame).collect())) == few
    assert all(few[a] == few[b] <= min(a, b) for a, b in edges if a != b)
