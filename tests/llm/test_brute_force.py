"""Twins by brute force of the language filter, the toxicity votes, wide vectors, the line stage and the whole pipeline."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import regex
from tests.llm.test_operators import AZ, brute_components, brute_contamination, check_packing, items_of, library, rows, table

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402
from lodestar.llm import langid, topk, toxicity  # noqa: E402


# --- 6


def plain_grams(text):
    """n-grams of a text by slicing: letters of ASCII and all other bytes, folded, one separator at either end of a word."""
    folded = bytearray(b" ")
    for c in text:
        low = c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c
        folded += low.encode() if low.isalpha() or not low.isascii() else b" "
    folded += b" "
    out = []
    for n in langid.SIZES:
        for i in range(len(folded) - n + 1):
            g = bytes(folded[i : i + n])
            if b" " not in g[1:-1]:
                out.append(g)
    return out


def test_filter_against_exact_sets(spark):
    words = {"aa": "the house and water of every morning", "bb": "dər Häuser ünd Wässer jeden Mørgen", "cc": "ла вода каждое утро и дом"}
    data = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), k) for k, t in words.items() for i in range(ord(k[0]) * 1000, ord(k[0]) * 1000 + 30)]
    model = langid.learn(table(spark, data))
    counts, total = defaultdict(Counter), Counter()
    for _, t, k in data:
        for g in plain_grams(t):
            counts[k][g] += 1
    for k in counts:
        counts[k] = {g: n for g, n in counts[k].items() if n > 2}
        total[k] = sum(counts[k].values())
    best = defaultdict(float)
    for k in counts:
        for g, n in counts[k].items():
            best[g] = max(best[g], n / total[k])
    exact = {k: {g for g, n in counts[k].items() if n / total[k] >= langid.LEAST_SHARE * best[g]} for k in counts}
    texts = [*words.values(), "the Häuser дом", "zzz qqq", "Ünd, THE!", "x"]
    raw = [t.encode() for t in texts]
    data_, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    n, got = model.counts(*langid.grams(data_, off), len(texts))
    assert model.langs == sorted(words) and n.tolist() == [len(plain_grams(t)) for t in texts]
    for i, t in enumerate(texts):
        want = [sum(g in exact[k] for g in plain_grams(t)) for k in model.langs]
        assert np.allclose(got[i], want, atol=0.05 * n[i] + 1e-9)  # false positives, corrected on average
        assert want == [0, 0, 0] or np.argmax(got[i]) == np.argmax(want)


# --- 10


def plain_score(model, words):
    """A text's probability from the definition: all cosines, the nearest, their votes, the calibration."""
    at = {int(h): i for i, h in enumerate(model.words)}
    ours = Counter(at[h] for h in words if h in at)
    if not ours:
        return model.blank
    examples = np.zeros((len(model.labels), len(model.words)))
    term = np.repeat(np.arange(len(model.words)), np.diff(model.index.start[:: model.index.n_blocks])[: len(model.words)])
    examples[model.index.row, term] = model.index.weight
    q = np.zeros(len(model.words))
    for i, n in ours.items():
        q[i] = (1 + np.log(n)) * model.idf[i]
    cosine = examples @ (q / np.linalg.norm(q))
    near = [i for i in np.lexsort((np.arange(len(cosine)), -np.round(cosine, 12))) if cosine[i] > 1e-12][: toxicity.NEIGHBOURS]
    votes = cosine[near] * model.vote[near]
    mine = 0.1 * model.vote.min()
    raw = ((votes * model.labels[near]).sum() + mine * model.blank) / (votes.sum() + mine)
    return float(np.clip(np.interp(raw, *model.curve), 0, 1)) if near else model.blank


def test_votes_against_all_cosines(spark):
    r = np.random.default_rng(3)
    common, bad = [f"w{i}" for i in range(60)], [f"vile{c}" for c in "abcdef"]
    texts = [" ".join([*r.choice(common, 12), *(r.choice(bad, 3) if i % 3 == 0 else [])]) for i in range(400)]
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)])
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), marks)
    assert len(model.words) > 5 and model.curve is not None
    for x in toxicity.score_texts(docs.filter("doc_id >= 300").select("doc_id", "text"), model).collect():
        raw = np.frombuffer(x.text.encode(), np.uint8)
        hashes, _ = toxicity.terms(raw, np.array([0, len(raw)]))
        assert abs(x.score - plain_score(model, hashes.tolist())) < 1e-6, x.doc_id


# --- 9


def test_wide_vectors(spark):
    data = [(50, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [2.0**45, 3.0]), (4, [2.0**45, 3.5]), (5, [0.0, 1.0]), (100, [2.0**20, 1.0])]
    v = {i: [min(max(int(256 * y), -(2**63)), 2**63 - 1) for y in x] for i, x in data}
    want = []
    for i in (50, 100):
        score = {j: min(max(sum(a * b for a, b in zip(v[i], v[j], strict=True)), -(2**63)), 2**63 - 1) for j in v if j != i}
        want += [(i, n + 1, j, score[j]) for n, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:5])]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())) == sorted(want)


def test_bounds_beyond_exact_sums(monkeypatch):
    monkeypatch.setattr(topk, "RESOLVED", 1)
    r = np.random.default_rng(5)
    v = r.integers(-(1 << 29), 1 << 29, (300, 6)) + (1 << 27)
    v[:150] = v[:1] + r.integers(0, 3, (150, 6))  # scores that differ in the last digits only
    lists = topk.SortedLists(np.arange(300), v)
    for i in range(0, 300, 7):
        score = [(-sum(a * b for a, b in zip(v[i].tolist(), v[j].tolist(), strict=True)), j) for j in range(300) if j != i]
        ids, got = lists.top(i, v[i], 5)
        assert [(-s, j) for s, j in zip(got.tolist(), ids.tolist(), strict=True)] == sorted(score)[:5]


# --- pipeline


def plain_pipeline(data):
    """The first four stages by their definitions."""
    kept = {d: t for d, t, _ in data if t and regex.search(r"\p{L}", t)}
    key = lambda x: x.strip(" \t\n\v\f\r").translate(AZ)
    holders = defaultdict(set)
    for d, t in kept.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    stays = lambda d, x: len(holders.get(key(x), ())) < 3 or d == max(holders[key(x)])
    kept = {d: "\n".join(x for x in t.split("\n") if stays(d, x)) for d, t in kept.items()}
    first = brute_components(list(kept.items()))
    kept = {d: t for d, t in kept.items() if first[d][2]}
    hit = {x[0] for x in brute_contamination(list(kept.items()), [x for x in items_of() if x[0] is not None]) if x[2]}
    return {d: t for d, t in kept.items() if d not in hit}


def test_pipeline_from_end_to_end(spark, tmp_path):
    spark.createDataFrame([x for x in items_of() if x[0] is not None], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    kept = plain_pipeline(rows())
    ids = library("byte_bpe_50k.json", list(kept.values()))
    check_packing(P.run(spark, str(tmp_path)).collect(), {d: [*i, 0] for d, i in zip(kept, ids, strict=True)})


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame(items_of()[:1], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
