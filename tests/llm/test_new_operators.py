"""Source divergence, hard negatives and the language model against brute-force versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.test_operators import AZ, rows, spaced, table

from lodestar.llm import divergence, hardneg, suffixtree

# --- 11

SHAPE = "doc_id long, text string, lang string, source string, term string, n int, kind int"


def brute_divergence(data, least_docs, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))) for text, lang, source in data]
    groups = sorted({(a, s) for a, s, _ in docs})
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for a, s, w in docs:
        counts[a, s].update(w)
        df[a].update(set(w))
    kept = {a: sorted(t for t, n in df[a].items() if n >= least_docs) for a, _ in groups}
    out = []

    def share(n, total, v):
        return 1 + 10**9 * (n + 2) // (total + 2 * v)

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for a, s in groups:
        v = kept[a]
        whole = Counter()
        for b, s2 in groups:
            if b == a:
                whole.update(counts[b, s2])
        p = {g: {t: share(counts[g][t], sum(counts[g][x] for x in v), len(v)) for t in v} for g in groups if g[0] == a}
        q = {t: share(whole[t], sum(whole[x] for x in v), len(v)) for t in v}
        pair = [(sum(f(p[a, s][t], p[a, o][t]) for t in v), o) for b, o in groups if b == a and o != s]
        term = [(f(p[a, s][t], q[t]), t) for t in v if counts[a, s][t] and p[a, s][t] > q[t]]
        for part, found in (("pair", pair), ("term", term)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(a, s, part, item, value, i + 1) for i, (value, item) in enumerate(found if part == "pair" else found[:top])]
    return sorted(out)


def divergence_rows():
    r = random.Random(11)
    vocab = ["".join(r.choice("abéß日") for _ in range(r.randint(1, 5))) for _ in range(90)]
    out = []
    for i in range(160):
        lang, source = r.choice(["en", "en", "en", "de", None]), f"s{min(r.randint(0, 30), r.randint(0, 30))}"
        mine = vocab if source < "s2" else vocab[: 20 + int(source[1:])]
        out.append((" ".join(r.choice(mine).title() + r.choice(["", ",", "1"]) for _ in range(r.choice([0, 3, 30, 80]))), lang, source))
    out += [(None, "en", None), ("", "xx", "only"), ("--- 12", "yy", "a"), (None, "yy", "b"), ("word " * 4000, "en", "s1"), ("Tie tie", "en", "s3")] + [("same same row", "de", "s4")] * 12
    return out


def as_table(spark, data):
    return spark.createDataFrame([(i, t, a, s, "x", 1, 2) for i, (t, a, s) in enumerate(data)], SHAPE).repartition(3)


@pytest.mark.parametrize("block", [256, 4])
@pytest.mark.parametrize("share", [1, 4, 100])  # almost all light, some of both, all heavy
def test_divergence(spark, monkeypatch, share, block):
    monkeypatch.setattr(divergence, "HEAVY_SHARE", share)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "LEAST_TERMS", 16)
    monkeypatch.setattr(divergence, "TERMS_A_GROUP", 1)
    data = divergence_rows()
    got = sorted(map(tuple, divergence.divergence(as_table(spark, data), 4).collect()))
    assert got == brute_divergence(data, 4)


def test_divergence_gathers_in_parts_and_joins_large_groups(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 64)
    data = divergence_rows()
    assert sorted(map(tuple, divergence.divergence(as_table(spark, data), 4).collect())) == brute_divergence(data, 4)


def test_divergence_without_kept_terms_or_rows(spark):
    data = [("one two", "en", "a"), ("two", "en", "b"), (None, None, None)]
    got = sorted(map(tuple, divergence.divergence(as_table(spark, data)).collect()))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.divergence(as_table(spark, data).limit(0)).count() == 0


# --- 12


def brute_negatives(data, every, positives=5, negatives=10):
    best = {}
    for i, x, y in data:
        if i is None or y is None or not x or any(e is None or not math.isfinite(e) for e in x):
            continue
        row = ((y + 1) % 10 if i % 7 == 0 else y, [min(max(math.floor(e * 256), -(2**63)), 2**63 - 1) for e in x])
        best[i] = min(best.get(i, row), row)
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        score = {b: min(max(sum(p * q for p, q in zip(v, w, strict=True)), -(2**63)), 2**63 - 1) for b, (_, w) in best.items() if b != a and len(w) == len(v)}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if best[b][0] == label][:positives]:
            found = [b for b in order if best[b][0] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:negatives]
            out += [(a, p, i + 1, b, score[p], score[b]) for i, b in enumerate(found)]
    return sorted(out)


def vectors(spark, data):
    return spark.createDataFrame([(i, x, y, 1, 2.0) for i, x, y in data], "vec_id long, embedding array<double>, label int, block int, score double").repartition(3)


def negative_rows():
    r = np.random.default_rng(12)
    centres = r.normal(size=(6, 8))
    data = [(i, (centres[i % 6] + 0.4 * r.normal(size=8)).round(2).tolist(), int(r.integers(0, 3))) for i in range(400)]
    data += [(400 + i, data[3][1], int(i % 4)) for i in range(60)]  # copies
    data += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (503, [1.0] * 8, None), (504, [], 1), (510, [0.0] * 8, 0), (520, [1.0, 2.0], 1), (521, [1.0, 2.0], 1), (523, [0.5, 1.0], 2), (20, [9.0] * 8, 1), (20, [8.0] * 8, 1)]
    return data


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        for name, n in (("CANDIDATES", 50), ("ANCHORS", 8), ("LEAF", 8), ("ANCHOR_LEAF", 3)):
            monkeypatch.setattr(hardneg, name, n)
    data = negative_rows()
    got = sorted(map(tuple, hardneg.hard_negatives(vectors(spark, data), 10, relabel_every=7).collect()))
    assert got == brute_negatives(data, 10) and len(got) > 200


def test_hard_negatives_beyond_64_bits(spark):
    data = [(100, [1e300, 1.0], 1), (1, [1e300, 1.0], 1), (2, [2.0**50, 0.0], 1), (3, [2.0**49, 3.0], 2), (4, [2.0**40, 3.5], 2), (200, [2.0**28, 1.0], 1), (5, [0.0, 1.0], 2), (6, [2.0**27, 1.0], 2), (8, [2.0**18, 1.0], 1), (9, [2.0**17, 1.0], 2), (10, [2.0**16, -1.0], 3)]
    got = sorted(map(tuple, hardneg.hard_negatives(vectors(spark, data), relabel_every=7).collect()))
    assert got == brute_negatives(data, 100) and got
    assert hardneg.hard_negatives(vectors(spark, data).limit(0)).count() == 0


def test_node_pairs_are_dropped_whole():
    r = np.random.default_rng(1)
    near = lambda c, n: (c + r.integers(-5, 5, (n, 4))).astype(np.int64)
    far = np.array([[1000, 900, 0, 0], [1000, -900, 0, 0], [-1000, 900, 0, 0], [-1000, -900, 0, 0]])
    v = np.concatenate([near(c, 600) for c in far])
    ids = np.arange(len(v))
    pair = hardneg.Pair(hardneg.Tree(ids[::20], np.zeros(120, int), v[::20], 16), hardneg.Tree(ids, np.zeros(2400, int), v, 64))
    best = hardneg.best_positives(pair, 5)
    assert pair.scored < 0.5 * 120 * 2400 and pair.scored + pair.dropped == 120 * 2400
    for i in range(120):
        q = int(pair.a.ids[i])
        score = v @ v[q]
        want = sorted((-int(score[j]), j) for j in range(2400) if j != q)[:5]
        assert list(zip((-best.score[i]).tolist(), best.id[i].tolist(), strict=True)) == want


# --- 13


def brute_model(data, depth, least_context, least_next, share, cost, prior):
    """The suffix tree of the definition, on words themselves: contexts as tuples, nearest word last."""
    texts = {i: [*spaced((t or "").translate(AZ)), None] for i, (_, t) in enumerate(data)}
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for i, (d, _) in enumerate(data)}
    count, follow = Counter(), defaultdict(Counter)
    for i, w in texts.items():
        if held[i]:
            continue
        count.update(w)
        for at in range(len(w)):
            for k in range(1, depth + 1):
                if at >= k:
                    follow[tuple(w[at - k : at])][w[at]] += 1
    n, v = sum(count.values()), len(count)
    p0 = lambda x: (count[x] + 0.5) / (n + 0.5 * (v + 1))
    states = {}

    def chance(history, x):
        for k in range(min(depth, len(history)), 0, -1):
            s = tuple(history[-k:])
            if s in states:
                kept, rest = states[s]
                return kept[x] if x in kept else rest * chance(history[len(history) - k + 1 :] if k > 1 else [], x)
        return p0(x)

    for k in range(1, depth + 1):
        made = {}
        for s, nexts in follow.items():
            total = sum(nexts.values())
            if len(s) != k or total < least_context:
                continue
            strong = {x: c for x, c in nexts.items() if c >= least_next and c * share >= total}
            if not strong:
                continue
            below = {x: chance(list(s[1:]), x) for x in strong}
            gain = sum(c * math.log(c / total / below[x]) for x, c in strong.items())
            unseen, left = total - sum(strong.values()), 1 - sum(below.values())
            gain += unseen * math.log(unseen / total / left) if unseen else 0
            if gain >= cost * (1 + len(strong)):
                kept = {x: (c + prior * below[x]) / (total + prior) for x, c in strong.items()}
                made[s] = (kept, (1 - sum(kept.values())) / left)
        states.update(made)
    out = []
    for i, w in texts.items():
        base = sum(math.log10(p0(x)) for x in w)
        score = sum(math.log10(chance(w[:at], x)) for at, x in enumerate(w))
        out.append((held[i], len(w), sum(count[x] > 0 for x in w), n, base, score))
    return out, states, chance, count


def model_rows():
    r = random.Random(13)
    vocab = [f"w{i}" for i in range(40)]
    data = [(d, t) for d, t, _ in rows()] + [(None, "some words here"), (None, None)]
    for i in range(200, 420):
        text = [r.choice(vocab[: r.randint(2, 40)])]
        for _ in range(r.choice([5, 30, 60])):
            text.append(vocab[(vocab.index(text[-1]) * 7 + 3) % 40] if r.random() < 0.5 else r.choice(vocab))
        data.append((i, " ".join(text).title()))
    return data + [(300, "the same row")] * 2


SMALL = dict(depth=3, least_context=6, least_next=2, share=8, cost=3.0, prior=2.0)


def close(got, want):
    return len(got) == len(want) and all(a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9, atol=1e-7) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("common,heavy,gathered", [(1 << 20, 1024, 1 << 21), (200, 16, 500), (0, 1, 100)])
def test_language_model(spark, monkeypatch, common, heavy, gathered):
    """With all entries broadcast and no context split; with some of both; with most entries joined."""
    monkeypatch.setattr(suffixtree, "COMMON", common)
    monkeypatch.setattr(suffixtree, "HEAVY", heavy)
    monkeypatch.setattr(suffixtree, "GATHERED", gathered)
    data = model_rows()
    want, states, _, _ = brute_model(data, **SMALL)
    assert {len(s) for s in states} >= {1, 2} and len(states) > 30
    docs = table(spark, [(d, t, "en") for d, t in data])
    got = [tuple(x)[1:] for x in suffixtree.language_model(docs, **SMALL).collect()]
    assert close(sorted(got), sorted(want))


def test_next_symbols_add_up_to_one():
    _, states, chance, count = brute_model(model_rows(), **SMALL)
    unknown = 1  # one symbol that training never saw
    for s in list(states)[:40]:
        assert abs(sum(chance(list(s), x) for x in count) + unknown * chance(list(s), "never seen") - 1) < 1e-9


def test_language_model_without_training(spark):
    docs = table(spark, [(d, "a b", "en") for d in range(60) if zlib.crc32(str(d).encode()) % 5 == 1])
    for x in suffixtree.language_model(docs).collect():
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert suffixtree.language_model(docs.limit(0)).count() == 0
