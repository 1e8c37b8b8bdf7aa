"""Forests from all claims of two whole tables, cycles and contradictions included, against brute force."""

import __spark_entry__ as entry

#: 2 -> 3 -> 4 -> 2 is a cycle with 5 and 6 below it, 7 is its own parent, 1 has two claims, 11 to 13 have none.
ORDERS = {1: 9, 2: 3, 3: 4, 4: 2, 5: 2, 6: 5, 7: 7, 8: 1, 9: 10}
SUPPLIERS = {1: 0, 9: 10}
PARTS = (11, 12, 13)


def brute():
    claims = {}
    for c, p in [*ORDERS.items(), *SUPPLIERS.items()]:
        claims.setdefault(c, set()).add(p)
    nodes = set(claims) | {p for x in claims.values() for p in x} | set(PARTS)
    parent = {c: min(x) for c, x in claims.items() if len(x) == 1} | {v: v // 2 for v in nodes if v > 0 and v not in claims}

    def cyclic(v):
        at = parent.get(v)
        for _ in parent:
            if at is None or at == v:
                break
            at = parent.get(at)
        return at == v

    forest = {c: p for c, p in parent.items() if not cyclic(c)}
    return nodes, forest, {c for c in parent if cyclic(c)}


def price(v):
    return (100.0, 1e5, 3e5)[v % 3]


def test_all_claims(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(o, c, price(o)) for o, c in ORDERS.items()], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame(list(SUPPLIERS.items()), "s_suppkey long, s_nationkey long").write.parquet(f"{sf}/supplier.parquet")
    spark.createDataFrame([(p,) for p in PARTS], "p_partkey long").write.parquet(f"{sf}/part.parquet")
    nodes, forest, cycle = brute()
    assert cycle == {2, 3, 4, 7} and 1 not in forest and forest[11] == 5
    q = entry.queries()
    assert dict(map(tuple, q["containment_forest"](spark, sf).collect())) == forest

    def depth(v):
        return depth(forest[v]) + 1 if v in forest else 0

    assert {(r.id, r.depth) for r in q["bounded_traversal"](spark, sf).collect()} == {(v, depth(v)) for v in nodes | set(forest.values()) if depth(v) <= 3 and (v in nodes or depth(v))}
    state = {v: ("unknown", "done", "open")[v % 3] if v in ORDERS else "unknown" for v in nodes}
    want = {}
    for c, p in forest.items():
        want.setdefault(p, set()).add(state[c])
    assert {r.parent: r.state for r in q["state_rollup"](spark, sf).collect()} == {p: next(iter(x)) if len(x) == 1 else "unknown" for p, x in want.items()}
