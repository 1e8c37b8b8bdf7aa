"""Graphs larger than a task takes: same results as the textbook algorithms, in few rounds."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, scene
from lodestar.plans import domain as D
from lodestar.plans.queries import WITHOUT_SQL


def counted(monkeypatch):
    """The number of tables written from now on."""
    seen, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: seen.append(1) or write(df))
    return seen


def frame(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long").repartition(3)


def test_layers_of_long_paths_in_few_rounds(spark, monkeypatch):
    """One round a layer took 24 tables here, and thousands on a dense graph of 6,000 vertices."""
    r = random.Random(3)
    name = r.sample(range(80), 80)
    pairs = sorted({(name[b], name[a]) for a, b in (sorted(r.sample(range(80), 2)) for _ in range(800))})
    layer = {}
    for x in name:
        layer[x] = max((layer[d] + 1 for s, d in pairs if s == x), default=0)
    assert max(layer.values()) > 20
    e, v = frame(spark, [*pairs, (900, name[-1]), (200, 201), (7, 7)]), spark.createDataFrame([(x,) for x in [*name, 200, 201, 300]], "id long")
    none, want = e.select("edge_id").limit(0), layer | {200: 1, 201: 0, 300: 0}
    seen = counted(monkeypatch)
    assert {x.id: x.layer for x in graph.dependency_layers(v, e, none, small=400).collect()} == want
    assert len(seen) < 18
    assert {x.id: x.layer for x in graph.dependency_layers(v, e, none).collect()} == want


def test_layers_tell_a_cycle(spark):
    e, v = frame(spark, [(1, 2), (2, 3), (3, 1), (4, 1)]), spark.range(5).toDF("id")
    for small in (1, 100):
        with pytest.raises(Exception, match="hold a cycle"):
            graph.dependency_layers(v, e, e.select("edge_id").limit(0), small=small).collect()


def cyclic(seed):
    """Two rings with chords, a third that both lead to, and a path of single vertices out of it; edges repeat."""
    r = random.Random(seed)
    pairs = [(x, 20 * k + (x + 1) % 20) for k in range(3) for x in range(20 * k, 20 * k + 20)]
    pairs += [(20 * k + a, 20 * k + b) for k in range(3) for a, b in (r.sample(range(20), 2) for _ in range(90))]
    return pairs + [(3, 45), (25, 50), (55, 100), *((x, x + 1) for x in range(100, 104)), (7, 7), (3, 45)]


def paths(pairs, starts):
    out, got = {}, set()
    for s, d in pairs:
        out.setdefault(s, set()).add(d)
    for a in starts:
        seen, todo = {a}, [a]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        got |= {(a, x) for x in seen}
    return got


@pytest.mark.parametrize("small", [1_000_000, 100, 1])
def test_reachability_joins_components_not_edges(spark, monkeypatch, small):
    """Rounds used to carry every start over every edge; now a ring is one vertex and no round holds pairs of its members."""
    pairs, starts = cyclic(1), [*range(0, 60, 3), 102, 500]
    largest = []
    plain = graph.reached
    monkeypatch.setattr(graph, "reached", lambda e, s: largest.append(e.count()) or plain(e, s))
    got = graph.reachability(frame(spark, pairs), spark.createDataFrame([(x,) for x in [*starts, 3]], "id long"), small=small).collect()
    assert sorted(map(tuple, got)) == sorted(paths(pairs, starts))
    assert max(largest) <= 8 or small == 1  # one round of colouring leaves some rings open


def test_thinned_edges_reach_the_same(spark):
    pairs = cyclic(2)
    every = sorted({x for p in pairs for x in p})
    for chunk in (30, 1000):
        thin = [tuple(x) for x in graph.thinned(frame(spark, pairs).coalesce(1), chunk).collect()]
        assert paths(thin, every) == paths(pairs, every)
        assert len(thin) < len(pairs)
    assert {x.id: x.component for x in graph.strong_components(spark.range(62).toDF("id"), frame(spark, pairs), small=80).collect()} == {x: x // 20 * 20 if x < 60 else x for x in range(62)}


def test_projection_in_chunks(spark):
    """The edges of one pair of nodes are collected by many tasks, none of them more than its chunk; they used to go to one."""
    r = random.Random(4)
    rows = [(r.randrange(10**6), r.randrange(40), r.randrange(50)) for _ in range(600)]
    rows += rows[:50]
    e = spark.createDataFrame(rows, "edge_id long, src long, dst long").repartition(3)
    nodes = spark.createDataFrame([(x, ["a" if x % 2 else "b", str(x)]) for x in range(45)] + [(45, [])], "id long, hierarchy array<string>")
    want = {}
    for k, s, d in rows:
        if d < 45:
            want.setdefault(("ba"[s % 2], "ba"[d % 2]), set()).add(k)
    members, chunks = graph.projected_chunks(nodes, e, [], 30)
    assert {x.node: x.members for x in members.collect()} == {"a": 22, "b": 23}
    got = chunks.collect()
    assert len(got) > 10 and max(len(x.edge_ids) for x in got) < 100
    merged = graph.hierarchy_projection(nodes, e, [])[1].collect()
    assert {(x.src_node, x.dst_node): (x.n, x.edge_ids) for x in merged} == {k: (len(v), sorted(v)) for k, v in want.items()}


def dense(seed, n, m, by_source):
    """Edges of one dense component, in order of their sources or of nothing."""
    r = random.Random(seed)
    pairs = [(x, (x + 1) % n) for x in range(n)] + [tuple(r.sample(range(n), 2)) for _ in range(m)] + [(3, 3)]
    return sorted(pairs) if by_source else r.sample(pairs, len(pairs))


def passed(pairs):
    """(places of the edges that close a cycle, layers over the others)"""
    out, gone = {}, set()
    for i, (s, d) in enumerate(pairs):
        if (d, s) in paths([(a, b) for a, ends in out.items() for b in ends], [d]):
            gone.add(i)
        else:
            out.setdefault(s, set()).add(d)
    layer = {}

    def at(v):
        if v not in layer:
            layer[v] = max((at(d) + 1 for d in out.get(v, ())), default=0)
        return layer[v]

    return gone, {v: at(v) for p in pairs for v in p}


@pytest.mark.parametrize("by_source", [True, False])
def test_layers_need_few_of_the_edges(spark, by_source):
    """Layers used to be found over all kept edges, each of them read in every round."""
    pairs = dense(8, 40, 500, by_source)
    gone, layer = passed(pairs)
    e, v = frame(spark, [*pairs, (50, 1), (50, 51)]), spark.range(53).toDF("id")
    c = graph.strong_components(v, e).cache()
    for more in ({}, {"small": 100, "batch": 300}, {"small": 100, "bit_vertices": 60, "batch": 300}, {"bit_vertices": 20, "batch": 100}):
        got = graph.greedy_pass(c, e, **more)
        assert sorted(x.edge_id for x in got.filter("closes").collect()) == sorted(gone)
        thin = graph.skeleton(c, e, got).cache()
        assert {x.id: x.layer for x in graph.acyclic_layers(v, thin).collect()} == dict.fromkeys(range(53), 0) | layer | {50: layer[1] + 1}
        assert thin.count() < 0.6 * (len(set(pairs)) - len(gone))


def test_giant_components_in_few_rounds(spark, monkeypatch):
    """A component with more vertices than a matrix of bits may have took a round of joins for every few edges."""
    pairs = dense(9, 60, 400, True)
    gone, _ = passed(pairs)
    e = frame(spark, [*pairs, *((a + 100, b + 100) for a, b in pairs)])
    c = graph.strong_components(spark.range(160).toDF("id"), e).cache()
    seen = counted(monkeypatch)
    got = graph.feedback_edges(c, e, small=100, bit_vertices=40, batch=200).collect()
    assert sorted(x.edge_id for x in got) == sorted([*gone, *(len(pairs) + k for k in gone)])
    assert len(seen) < 16


def test_giant_components_are_sorted_out_where_edges_lie(spark, monkeypatch):
    """Every edge of a giant component used to go through rounds in order, however clear it was what becomes of it."""
    pairs = dense(10, 80, 2000, True)
    gone, layer = passed(pairs)
    e, v = frame(spark, [*pairs, *((a + 100, b + 100) for a, b in pairs), (50, 190), (190, 191), (191, 190)]), spark.range(192).toDF("id")
    c = graph.strong_components(v, e).cache()
    monkeypatch.setattr(graph, "_in_rounds", None)
    got = graph.greedy_pass(c, e, small=1000).cache()
    assert sorted(x.edge_id for x in got.filter("closes").collect()) == sorted([*gone, *(len(pairs) + k for k in gone), 2 * len(pairs) + 2])
    at = {x.id: x.layer for x in graph.acyclic_layers(v, graph.skeleton(c, e, got)).collect()}
    assert {x: at[x + 100] for x in layer} == layer and all(at[x] >= layer[x] for x in layer)


def test_what_lies_along_a_path():
    r = random.Random(12)
    for _ in range(60):
        n = r.randrange(2, 30)
        pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randrange(1, 80))})
        got = graph._along_a_path(pd.DataFrame(pairs, columns=["a", "b"]).assign(cs=7))
        rows = {x.rank: x for x in got.itertuples()}
        assert set(rows) == {x for p in pairs for x in p} and all(sorted(x.near) == [b for a, b in pairs if a == x.rank] for x in rows.values())
        told, want = {(x, y) for x in rows for y in rows if not (pd.isna(rows[x].leads) or pd.isna(rows[y].led)) and rows[x].leads <= rows[y].led}, paths(pairs, rows)
        on = [x for x in rows if (x, x) in told]
        assert told <= want and all((x, y) in told for x in on for y in on if x <= y) and len(on) > 1
        assert {x for x, y in want if y in on} == {x for x in rows if not pd.isna(rows[x].leads)}


def test_components_by_colours_are_tarjans():
    r = random.Random(11)
    for _ in range(60):
        n, m = r.randrange(1, 40), r.randrange(80)
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        out = {v: [d for s, d in pairs if s == v] for v in range(n)}
        want = {v: part[0] for part in graph.tarjan(list(out), out) for v in part}
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        for rounds, steps in ((4, 40), (4, 2), (1, 40), (0, 0)):
            assert dict(enumerate(graph.least_members(n, a, b, rounds, steps).tolist())) == want


def test_components_without_a_shuffle_of_all_edges(spark, monkeypatch):
    """All edges used to be made distinct and written before any was left out."""
    e = frame(spark, cyclic(3) * 3)
    sizes, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: sizes.append((out := write(df)).count()) or out)
    got = graph.strong_components(spark.range(62).toDF("id"), e).collect()
    assert {x.id: x.component for x in got} == {x: x // 20 * 20 if x < 60 else x for x in range(62)}
    assert max(sizes) < len(set(cyclic(3)))


def test_visible_edges_of_feedback_edges(spark, sf_dir):
    """The state of each pair of nodes is the same with and without what the greedy pass tells."""
    e, at = D.all_edges(spark, sf_dir).cache(), D.modules(spark, sf_dir).select("id", F.col("hierarchy")[0].alias("node"))
    c = graph.strong_components(D.vertices(spark, sf_dir), e).cache()
    flag = graph.feedback_edges(c, e).withColumn("feedback", F.lit(True))
    full = graph.with_components(c, e).join(flag, "edge_id", "left").select("edge_id", F.lit("x").alias("type"), "src", "dst", (F.col("cs") == F.col("cd")).alias("cyclic"), F.coalesce("feedback", F.lit(False)).alias("feedback"))
    want = sorted(map(tuple, scene.visible_edges(full, at).drop("type").collect()))
    assert full.filter("feedback and not cyclic").isEmpty() and not full.filter("feedback").isEmpty()
    assert sorted(map(tuple, WITHOUT_SQL["visible_edges"](spark, sf_dir).collect())) == want


def last_plan(df):
    """The plan as it was after the query had run, and the lines below each of its broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    sent = []
    for i, x in enumerate(plan):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            sent.append("\n".join(plan[i + 1 : end]))
    return "\n".join(plan), sent


@pytest.mark.parametrize("most", [10**9, 40_000, 2000])
def test_repeated_rows_of_large_groups_are_not_broadcast(spark, most):
    """Members of a component, repeated for each share, went through the driver: 12 million rows at 60,000 vertices. And what
    a component gives went to as few tasks as its members ask for."""
    many = graph.written(spark.range(1200).select("id", (F.col("id") % 2).alias("k")).unionByName(spark.createDataFrame([(5000, 9), (5001, None)], "id long, k long")))
    few = graph.written(spark.range(3000).select(F.col("id").alias("to"), F.when(F.col("id") < 300, 0).when(F.col("id") < 310, 1).otherwise(F.col("id") % 2 + 8).cast("long").alias("k")))
    got = graph.join_large_groups(many, few, "k", "id", "to", most).withColumn("task", F.spark_partition_id())
    counts = got.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("id", "to").alias("pairs"), F.countDistinct("task").alias("tasks"))
    rows = {x.k: (x.n, x.pairs, x.tasks) for x in counts.collect()}
    want = {0: 600 * 300, 1: 600 * 10, 9: sum(x % 2 for x in range(310, 3000))}
    assert {k: x[:2] for k, x in rows.items()} == {k: (n, n) for k, n in want.items()}
    assert rows[0][2] > {40_000: 2, 2000: 20}.get(most, 0)
    plan, sent = last_plan(counts)
    assert "explode" in plan.lower() and not any("explode" in x.lower() for x in sent)
    if most < 10**9:  # groups that are no grid have tasks of their own too
        assert len({x.task for x in got.select("task").distinct().collect()}) > 2


def test_many_pairs_reached_are_not_broadcast(spark, monkeypatch):
    """Some 35 million pairs fit in 10 MB of Parquet, and Spark looks only at these."""
    pairs = [(0, 1), (1, 2), (2, 3), (0, 3), (4, 2)]
    plans, write = [], graph.written

    def kept(df):
        out = write(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "written", kept)
    for most, joins in ((3, 0), (1000, 1)):
        plans.clear()
        monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
        got = graph.reached(frame(spark, pairs), spark.range(5).toDF("id")).collect()
        assert sorted(map(tuple, got)) == sorted(paths(pairs, range(5)))
        assert any("BroadcastHashJoin" in x or "BroadcastExchange" in x for x in plans) == bool(joins)
