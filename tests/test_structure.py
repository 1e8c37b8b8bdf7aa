"""Inherited options, bounded projections and package exports against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import exports, inheritance, projection

# --- inheritance


def resolve(node, own, bases, trail=()):
    """Options of a node by recursion, as key: (value, origin); a base on the way to it gives only its own."""
    out = {}
    if node not in trail:
        for _, base in sorted(bases.get(node, [])):
            if base in own:
                out |= resolve(base, own, bases, (*trail, node))
    return out | {k: (v, node) for k, v in own[node].items()}


def cyclic(node, own, bases, trail=()):
    if node in trail:
        return True
    return any(base in own and cyclic(base, own, bases, (*trail, node)) for _, base in bases.get(node, []))


@pytest.mark.parametrize("seed", range(2))
def test_inheritance(spark, seed):
    r = random.Random(seed)
    names = [f"p{i}" for i in range(14)]
    own = {n: {k: f"{n}.{k}" for k in "abcdefg" if r.random() < 0.25} for n in names}
    bases = {n: [(i, b) for i, b in enumerate(r.sample([*names[: names.index(n)], *(names if r.random() < 0.15 else []), "ghost"], min(2, names.index(n) + 1)))] for n in names}
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    b = spark.createDataFrame([(n, i, x) for n, xs in bases.items() for i, x in xs], "id string, ord int, base string")
    o = spark.createDataFrame([(n, k, v) for n, kv in own.items() for k, v in kv.items()], "id string, key string, value string")
    options, diagnostics = inheritance.effective_options(nodes, b, o)
    got = {}
    for x in options.collect():
        got.setdefault(x.id, {})[x.key] = (x.value, x.origin)
    assert got == {n: w for n in names if (w := resolve(n, own, bases))}
    said = {(d.id, d.code) for d in diagnostics.collect()}
    assert {i for i, c in said if c == "cycle"} == {n for n in names if cyclic(n, own, bases)}
    below = {n: {n} for n in names}
    for _ in names:
        below = {n: s | {y for x in s for _, b2 in bases.get(x, []) if b2 in own for y in below[b2]} for n, s in below.items()}
    assert {i for i, c in said if c == "not_found"} == {n for n in names if any(b2 == "ghost" for x in below[n] for _, b2 in bases.get(x, []))}
    states = {x.id: x.status for x in inheritance.profile_states(nodes, diagnostics).collect()}
    assert states == {n: "invalid" if any(i == n for i, _ in said) else "valid" for n in names}


def test_a_long_chain_and_null_values(spark):
    nodes = spark.range(30).select("id")
    b = spark.range(1, 30).select("id", F.lit(0).alias("ord"), (F.col("id") - 1).alias("base"))
    o = spark.createDataFrame([(0, "k", "first"), (0, "n", "x"), (12, "n", None)], "id long, key string, value string")
    got = {(x.id, x.key): (x.value, x.origin, x.depth) for x in inheritance.effective_options(nodes, b, o)[0].collect()}
    assert got[29, "k"] == ("first", 0, 29) and got[29, "n"] == (None, 12, 17) and got[11, "n"] == ("x", 0, 11) and len(got) == 60
    assert inheritance.effective_options(nodes, b.limit(0), o.limit(0))[0].count() == 0


# --- projection


def project(concepts, parent, rels, focus, depth, max_nodes, max_rels, containment, semantic):
    children = {}
    for c, p in sorted(parent.items()):
        children.setdefault(p, []).append(c)
    order = []

    def visit(x, d):
        order.append((x, d))
        if depth is None or d < depth:
            for c in children.get(x, []):
                visit(c, d + 1)

    for x in [focus] if focus is not None else [c for c in sorted(concepts) if c not in parent]:
        visit(x, 0)
    shown, cut = [], False
    for x, d in order:
        if len(shown) >= max_nodes:
            cut = True
            break
        if concepts[x] is not False:
            shown.append((x, d))
    seen = {x for x, _ in shown}
    on = sorted(x for x in rels if (containment if x[4] else semantic))
    possible = [x[:4] for x in on if x[2] in seen and x[3] in seen]
    kept = possible[:max_rels]
    return shown, kept, (len(shown), len(concepts) - len(shown), len(kept), len(rels) - len(kept), cut, len(possible) > max_rels)


@pytest.mark.parametrize("focus,depth,nodes,rels,containment", [(None, 1, 1000, 1000, True), (None, None, 15, 4, True), ("c02", 2, 5, 1000, False), ("c02", None, 1000, 3, True), (None, 2, 12, 2, False)])
def test_projection(spark, focus, depth, nodes, rels, containment):
    r = random.Random(3)
    names = [f"c{i:02d}" for i in range(60)]
    concepts = {n: r.choice([True, None, None, False]) for n in names}
    parent = {n: names[r.randrange(i)] for i, n in enumerate(names) if i > 3 and r.random() < 0.9}
    links = [("contains", f"{p}-{c}", p, c, True) for c, p in parent.items()] + [("links", f"l{i}", *r.sample(names, 2), False) for i in range(80)]
    c = spark.createDataFrame(list(concepts.items()), "id string, visible boolean")
    p = spark.createDataFrame(list(parent.items()), "child string, parent string")
    e = spark.createDataFrame(links, "kind string, relationship_id string, src string, dst string, contains boolean")
    got = projection.bounded_projection(c, p, e, focus, depth, nodes, rels, containment)
    shown, kept, counts = project(concepts, parent, links, focus, depth, nodes, rels, containment, True)
    assert [(x.id, x.depth) for x in sorted(got.nodes.collect(), key=lambda x: x.place)] == shown
    assert [(x.kind, x.relationship_id, x.src, x.dst) for x in sorted(got.relationships.collect(), key=lambda x: x.place)] == kept
    one = got.counts.collect()
    assert len(one) == 1 and tuple(one[0])[:-1] == counts and one[0].status == ("truncated" if counts[4] or counts[5] else "ready")


def test_projection_limits(spark):
    assert projection.budget(0, 1000, 3000)[0] == 1000 and projection.budget(9999, 1000, 3000)[0] == 3000 and projection.budget(7, 1000, 3000) == (7, [])
    c = spark.createDataFrame([("a", True)], "id string, visible boolean")
    p, e = spark.createDataFrame([], "child string, parent string"), spark.createDataFrame([], "kind string, relationship_id string, src string, dst string, contains boolean")
    got = projection.bounded_projection(c, p, e, max_nodes=-1)
    assert got.diagnostics and tuple(got.counts.head()) == (1, 0, 0, 0, False, False, "ready")
    assert tuple(projection.bounded_projection(c.limit(0), p, e).counts.head()) == (0, 0, 0, 0, False, False, "ready")
    for bad in ({"focus": "zz"}, {"depth": 0}):
        with pytest.raises(ValueError):
            projection.bounded_projection(c, p, e, **bad)


# --- package exports


def select(value, subpath, runtime):
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return next((t for v in value if (t := select(v, subpath, runtime)) is not None), None)
    if not isinstance(value, dict):
        return None
    if any(k.startswith(".") for k in value):
        for k in sorted(value, key=lambda k: (k != subpath, -len(k), k)):
            if "*" in k:
                a, _, b = k.partition("*")
                if not (subpath.startswith(a) and subpath.endswith(b) and len(subpath) >= len(a) + len(b)):
                    continue
                caught = subpath[len(a) : len(subpath) - len(b)]
            elif k == subpath:
                caught = ""
            else:
                continue
            t = select(value[k], subpath, runtime)
            if t is not None:
                return t.replace("*", caught)
        return None
    for k in exports.CONDITIONS.get(runtime, exports.CONDITIONS["auto"]):
        if k in value and (t := select(value[k], subpath, runtime)) is not None:
            return t
    return None


def test_package_exports(spark):
    r = random.Random(9)

    def made(depth):
        kind = r.random()
        if depth == 0 or kind < 0.25:
            return r.choice(["./a.js", "./lib/*.js", "./t.d.ts", None, 3, True, "./x/*/y*.js"])
        if kind < 0.4:
            return [made(depth - 1) for _ in range(r.randint(0, 3))]
        keys = [".", "./a", "./a/*", "./*", "./a/*.js", "./*/b", "./b"] if kind < 0.7 else ["types", "import", "require", "node", "default", "browser"]
        return {k: made(depth - 1) for k in r.sample(keys, r.randint(0, 4))}

    rows = [(i, json.dumps(made(r.randint(0, 4))), r.choice([".", "./a", "./a/b", "./b", "./a/c.js", "./c/b", "./"]), r.choice(["esm", "cjs", "auto", "odd", None])) for i in range(400)]
    want = {i: select(json.loads(v), s, t) for i, v, s, t in rows}
    rows += [(1000, "{not json", ".", "esm"), (1001, None, ".", "esm"), (1002, '{"": "./never.js"}', ".", "cjs")]
    got = {x.request_id: x.target for x in exports.package_exports(spark.createDataFrame(rows, "request_id long, exports string, subpath string, runtime string")).collect()}
    assert {i: got[i] for i in want} == want and sum(v is not None for v in want.values()) > 80
    assert [got[i] for i in (1000, 1001, 1002)] == [None] * 3 and len(got) == len(rows)
