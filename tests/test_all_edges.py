"""The graph queries over all edges against brute force; the queries over each supplier's first successor are a part."""

import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestar.operators import graph
from lodestar.plans import domain as D
from lodestar.plans.queries import WITHOUT_SQL

#: Two cycles that share vertex 2, one of two edges, a vertex out of them, and one that follows nothing.
ORDERS = [[1, 2, 3, 1], [2, 4, 2], [3, 5], [1, 2, 2, 3], [5, 6], [1, 5]]


def fixture(spark, folder):
    rows = [(o, i, 10 * s, s) for o, line in enumerate(ORDERS) for i, s in enumerate(line)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, f"S{i}", i % 2, 100.0 * i) for i in range(1, 8)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(0, "N0", 0), (1, "N1", 1)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "ASIA"), (1, "EUROPE")], "r_regionkey long, r_name string").write.parquet(f"{folder}/region.parquet")
    return sorted({(a, b) for line in ORDERS for a, b in zip(line, line[1:], strict=False) if a != b})


def reaches(edges, a):
    seen, todo = {a}, [a]
    while todo:
        for w in [d for s, d in edges if s == todo[-1]] if todo else ():
            if w not in seen:
                seen.add(w)
                todo.insert(0, w)
        todo.pop()
    return seen


def brute(edges):
    """(component of each, feedback edges, layer of each)"""
    reach = {v: reaches(edges, v) for v in range(1, 8)}
    component = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    kept, gone = [], set()
    for s, d in edges:
        if component[s] == component[d] and s in reaches([e for e in kept if component[e[0]] == component[e[1]]], d):
            gone.add((s, d))
        else:
            kept.append((s, d))

    def layer(v):
        return max((layer(d) + 1 for s, d in kept if s == v), default=0)

    return reach, component, gone, {v: layer(v) for v in reach}


def test_all_edges(spark, tmp_path):
    sf = str(tmp_path)
    edges = fixture(spark, sf)
    reach, component, gone, layer = brute(edges)
    assert gone and len(edges) > 7
    q = entry.queries()
    run = lambda name: q[name](spark, sf).collect()
    ids = {1_000_000 * s + d for s, d in edges}
    assert sorted((r.src, r.dst) for r in D.all_edges(spark, sf).collect()) == edges
    assert {(r.start, r.id) for r in run("reachability")} == {(a, b) for a in reach for b in reach[a]}
    assert {r.id: r.component for r in run("scc_components")} == component
    assert {(r.component, r.size) for r in run("cycle_groups")} == {(c, n) for c, n in Counter(component.values()).items() if n > 1}
    assert {r.edge_id for r in run("feedback_edges")} == {1_000_000 * s + d for s, d in gone}
    assert {r.id: r.layer for r in run("dependency_layers")} == layer
    assert {r.layer: r.modules for r in run("layer_labels")} == Counter(layer.values())
    assert {r.id: (r.layer, r.x) for r in run("layered_layout")} == {v: (n, 240 * sorted(set(layer.values())).index(n)) for v, n in layer.items()}
    assert {r.edge_id for r in run("orthogonal_routes")} == ids
    assert sum(r.n for r in run("visible_edges")) == sum(r.n for r in run("hierarchy_projection_d1")) == len(edges)
    assert {n for n in ("feedback_edges", "dependency_layers", "layer_labels", "layered_layout", "visible_edges")} <= set(WITHOUT_SQL)


def test_feedback_and_layers_by_either_path(spark, sf_dir):
    v, e = D.vertices(spark, sf_dir), D.all_edges(spark, sf_dir).cache()
    c = graph.strong_components(v, e)
    bits = graph.feedback_edges(c, e).cache()
    want = {r.edge_id for r in graph.feedback_edges(c, e, bit_vertices=0).collect()}
    assert {r.edge_id for r in bits.collect()} == want
    assert sorted(r.edge_id for r in graph.feedback_edges(c, e, small=5, batch=60).collect()) == sorted(want)
    one, rounds = ({r.id: r.layer for r in graph.dependency_layers(v, e, bits, small=n).collect()} for n in (graph.SMALL_EDGES, 0))
    assert one == rounds
    assert e.filter(F.col("src") == F.col("dst")).isEmpty()


def greedy(edges):
    kept, gone = {}, set()
    for k, s, d in sorted(edges):
        todo, seen = [d], {d}
        while todo:
            for w in kept.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        if s in seen:
            gone.add(k)
        else:
            kept.setdefault(s, []).append(d)
    return gone


def test_giant_components_in_batches(spark):
    """More edges than a task takes: over the matrix of bits, and over joins where there are too many vertices for it."""
    r = random.Random(5)
    edges = [(10**17 + k, *(f"m{x}" for x in r.sample(range(40), 2))) for k in r.sample(range(10**6), 170)]
    edges += [(5, "m1", "m1"), (6, "m2", "m3"), (10**18, "m2", "m3")] + [(7, "x", "y"), (8, "y", "x"), (9, "y", "z")]
    e = spark.createDataFrame(edges, "edge_id long, src string, dst string").repartition(4)
    v = spark.createDataFrame([(x,) for x in sorted({x for _, s, d in edges for x in (s, d)})], "id string")
    c = graph.strong_components(v, e).cache()
    component = {r.id: r.component for r in c.collect()}
    want = sorted(greedy([x for x in edges if component[x[1]] == component[x[2]]]))
    assert len(want) > 40 and 8 in want
    for more in ({}, {"small": 50, "batch": 45}, {"small": 50, "batch": 1000}, {"small": 50, "bit_vertices": 39}):
        assert sorted(r.edge_id for r in graph.feedback_edges(c, e, **more).collect()) == want
    assert graph.feedback_edges(c, e.limit(0)).count() == 0
