"""Each operator against a brute-force version, over a small table with every awkward row."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import decontaminate, langid, linededup, neardup, packing, substring, tokencount, tokenfile, topk, toxicity

AZ = {i: i + 32 for i in range(65, 91)}
RULES = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines int, key string, row int"


def rows():
    """(doc_id, text, lang): copies, near copies, shared lines and passages, and rows with nothing."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdeéñüß") for _ in range(r.randint(1, 9))) for _ in range(300)]
    text = lambda n: "".join(r.choice(vocab).title() + r.choice([" ", " ", " ", ", ", ".\n", "  "]) for _ in range(n))
    out = [(i, text(r.choice([1, 3, 12, 40, 150])), "en") for i in range(0, 60)]
    base = text(120)
    for i in range(60, 80):  # near copies
        w = base.split(" ")
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append((i, " ".join(w), "de"))
    out += [(80 + i, base, "de") for i in range(6)]
    line, passage = "This line is COMMON to many documents", " ".join(r.choice(vocab) for _ in range(30))
    for i in range(90, 110):
        out.append((i, f"{text(20)}\n \t{line}{' ' * (i % 3)}\n{text(5)} {passage} {text(9)}", "fr"))
    out += [(110, line, "fr"), (111, passage, "fr"), (112, "a a a a a a a a a a a a a a a a a a a a", None), (113, "", "en"), (114, " \n\n ", "en"), (115, None, "en"), (116, "123 456", "en")]
    out += [(117, text(9000), "en"), (118, "日本語 テキスト です", None), (119, "\n" * 30, "en"), (120, "don't <|endoftext|> stop", "en"), (121, "x" * 5000, "en")]
    return out


def table(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(d, t, x, "s", 1, 0.5, 3, "k", 9) for d, t, x in data], RULES).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without doc_id and rows that repeat."""
    return table(spark, [(None, "some words here", "en"), (1, "the same row twice", "en"), (1, "the same row twice", "en"), (2, None, None), (None, None, None)])


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def spaced(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- 1


def brute_contamination(data, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for d, t, *_ in data:
        w, hit, found = alnum(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= got
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def items_of():
    data = dict((d, t) for d, t, _ in rows())
    cut = lambda d, a, b: " ".join(alnum(data[d])[a:b])
    return [(0, cut(117, 100, 140)), (1, cut(117, 130, 139)), (10, "A a a A a a a a a a a a!"), (2, cut(111, 3, 25)), (3, cut(117, 100, 140)), (4, None), (5, "..."), (6, "日本語"), (7, cut(90, 0, 10)), (8, cut(91, 0, 9)), (None, cut(92, 0, 12))]


def test_contamination(spark, docs):
    items = items_of()
    found = decontaminate.digest(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    want = brute_contamination(rows(), [x for x in items if x[0] is not None])
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sum(x[5] for x in want) > 20


def test_contamination_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "same row")], "item_id long, text string")
    got = decontaminate.contamination(odd, items).select("doc_id", "n_words", "n_hit").collect()
    assert Counter(map(tuple, got)) == Counter([(None, 3, 0), (1, 4, 2), (1, 4, 2), (2, 0, 0), (None, 0, 0)])
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0


# --- 2, 3, 8


def library(name, texts):
    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts(docs, odd, none):
    got = sorted(map(tuple, tokencount.with_limit(tokencount.token_counts(docs), 2048).collect()))
    texts = [t for _, t, _ in rows()]
    ids = library("word_bpe_49k.json", texts)
    assert got == sorted((d, len((t or "").encode()), len(i), len(i) > 2048) for (d, t, _), i in zip(rows(), ids, strict=True))
    assert any(x[3] for x in got)
    assert tokencount.token_counts(odd).count() == 5 and tokencount.token_counts(none).count() == 0


def check_packing(pieces, want):
    sequences, of = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        of[p["doc_id"]].append((p["start"], list(np.frombuffer(p["ids"], "<u4")), p["doc_tokens"]))
    for d, ids in want.items():
        got = sorted(of[d])
        assert sum((x[1] for x in got), []) == ids and [x[0] for x in got] == [0, *np.cumsum([len(x[1]) for x in got])[:-1].tolist()] and {x[2] for x in got} == {len(ids)}
    used = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        used.append(at)
    assert max(used) <= 1024 and sum(u < 1024 for u in used) <= 1
    return used


def test_packing(docs, odd, none):
    want = {d: [*i, 0] for (d, _, _), i in zip(rows(), library("byte_bpe_50k.json", [t for _, t, _ in rows()]), strict=True)}
    check_packing(packing.pack(docs).collect(), want)
    got = packing.pack(odd).collect()
    assert sum(r["length"] for r in got) == sum(len(i) + 1 for i in library("byte_bpe_50k.json", ["some words here", "the same row twice", "the same row twice", "", ""]))
    assert packing.pack(none).count() == 0


def test_packing_levels(spark):
    data = [(i, "word " * (37 + i * 13 % 400), None) for i in range(400)]
    want = {d: [*i, 0] for (d, _, _), i in zip(data, library("byte_bpe_50k.json", [t for _, t, _ in data]), strict=True)}
    check_packing(packing.pack(table(spark, data).repartition(150)).collect(), want)


def test_best_fill():
    r = random.Random(3)
    for _ in range(200):
        counts = np.zeros(64, np.int64)
        for _ in range(r.randint(0, 5)):
            counts[r.randint(1, 63)] += r.randint(1, 3)
        cap = r.randint(0, 63)
        sums = {0}
        for length in range(64):
            for _ in range(int(counts[length])):
                sums |= {s + length for s in sums}
        used = packing.best_fill(counts, cap)
        assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= cap)
        assert all(v <= counts[k] for k, v in used.items())


def test_token_files(docs, odd, none):
    got = tokenfile.round_trip(docs).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    want, at = [], 0
    for (d, _, _), i in sorted(zip(rows(), library("word_bpe_49k.json", [t for _, t, _ in rows()]), strict=True), key=lambda x: x[0][0]):
        ids = np.array([*i, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == want
    assert tokenfile.round_trip(odd).count() == 5 and tokenfile.round_trip(none).count() == 0


def test_token_file_format():
    out = io.BytesIO()
    writer = tokenfile.TokenFileWriter(out)
    docs_ = [np.arange(5), np.zeros(0, int), np.full(1000, 49000)]
    for i, x in enumerate(docs_):
        writer.add(None if i == 1 else i * 10, x)
    writer.close()
    reader = tokenfile.TokenFileReader(out)
    assert reader.doc_ids == [0, None, 20] and all(reader[i].tolist() == docs_[i].tolist() for i in (2, 0, 1))
    raw = bytearray(out.getvalue())
    raw[int(reader.at[2]) + 9] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        tokenfile.TokenFileReader(io.BytesIO(bytes(raw)))[2]
    with pytest.raises(ValueError):
        tokenfile.TokenFileReader(io.BytesIO(out.getvalue()[:-1] + b"x"))


# --- 4


def test_line_dedup(docs, odd, none):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(AZ)
    holders = defaultdict(set)
    for d, t, _ in rows():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    want = {}
    for d, t, _ in rows():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == d]
        want[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    got = linededup.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == want
    assert sum(x[1] > 0 for x in want.values()) > 20
    assert Counter(r["n_dropped"] for r in linededup.dedup_lines(odd).collect()) == {0: 5}
    assert linededup.dedup_lines(none).count() == 0


# --- 5


def brute_components(data):
    sets = {}
    for d, t, *_ in data:
        w = spaced((t or "").translate(AZ))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                if x != y:
                    for k, v in root.items():
                        if v == max(x, y):
                            root[k] = min(x, y)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in ids}


def test_near_duplicates(docs, odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    want = brute_components(rows())
    assert got == want and sum(not x[2] for x in want.values()) > 15
    got = Counter(map(tuple, neardup.near_duplicates(odd).collect()))
    assert got == Counter([(None, 1, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)])
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_many_kinds(spark, monkeypatch):
    """Groups whose members link only through a hub, chains, and a passage that all share; also with split buckets."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    data, passage = [], [word() for _ in range(60)]
    for g in range(4):
        base = [word() for _ in range(150)]
        data.append(base)
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(1, 5)):
                w[r.randrange(len(w))] = word()
            data.append(w)
        last = base
        for _ in range(6):  # each a near copy of the one before
            last = list(last)
            for _ in range(2):
                last[r.randrange(len(last))] = word()
            data.append(last)
    data += [[word() for _ in range(r.randint(2, 30))] + passage + [word() for _ in range(5)] for _ in range(40)]
    r.shuffle(data)
    data = [(i, " ".join(w), None) for i, w in enumerate(data)]
    want = brute_components(data)
    df = table(spark, data).cache()
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df).collect()} == {d: c for d, (_, c, _) in want.items()}
    monkeypatch.setattr(neardup, "FAR_CELL", 2)
    monkeypatch.setattr(neardup, "CELL", 5)
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df).collect()} == {d: c for d, (_, c, _) in want.items()}


# --- 6


def test_language_id(spark, none):
    r = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi", "the"], "bb": ["schu", "ber", "ung", "é"], "cc": ["ción", "ado", "que", "ña"]}
    say = lambda k, n: " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 3))) for _ in range(n))
    data = [(i, say(k := "abc"[i % 3] * 2, 40), k) for i in range(300)]
    data += [(300, None, "aa"), (301, "123 ½ !!", "aa"), (302, "日本", None), (303, "", "bb"), (None, say("bb", 30), "bb"), (5, say("cc", 30), None)]
    got = langid.identify(table(spark, data)).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(data)
    assert sum(by[i]["lang_pred"] == "abc"[i % 3] * 2 for i in range(300) if i != 5) >= 297
    assert [by[i]["lang_pred"] for i in (300, 301, 303)] == ["und"] * 3 and by[302]["lang_pred"] in parts
    assert all(0 <= x["score"] <= 1 for x in got) and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got if x["doc_id"] is not None)
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(table(spark, [(1, "abc", None)])).collect()
    assert unlabelled[0]["lang_pred"] == "und"


# --- 7


def brute_substrings(data, n=13):
    first = {}
    for d, t, *_ in sorted(data, key=lambda x: x[0]):
        w = spaced(t)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), d)
    out = {}
    for d, t, *_ in data:
        w = spaced(t)
        gone = {p for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for p in range(i, i + n)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substrings(docs, odd, none, monkeypatch):
    want = brute_substrings(rows())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring.dedup_substrings(docs).collect()}
    assert got == want and sum(x[1] > 0 for x in want.values()) > 30
    monkeypatch.setattr(substring, "SHARD_WORDS", 60)
    monkeypatch.setattr(substring, "QUERY_WORDS", 100)
    monkeypatch.setattr(substring, "PART", 7)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring.dedup_substrings(docs).collect()} == want
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.dedup_substrings(odd).collect()) == Counter([(None, 3, 0), (1, 4, 0), (1, 4, 0), (2, 0, 0), (None, 0, 0)])
    assert substring.dedup_substrings(none).count() == 0


def test_fm_index():
    from lodestar.llm.fmindex import FMIndex

    r = np.random.default_rng(2)
    for _ in range(20):
        texts = [r.integers(0, 4, r.integers(1, 60)) for _ in range(6)]
        owners = r.permutation(6)
        depth = int(r.integers(2, 8))
        where = {}
        for t, o in zip(texts, owners, strict=True):
            for i in range(len(t) - depth + 1):
                k = tuple(t[i : i + depth])
                where[k] = min(where.get(k, 99), o)
        fm = FMIndex(np.concatenate(texts).astype(np.uint64), np.cumsum([0, *map(len, texts)]), owners.astype(np.int64), depth)
        queries = [r.integers(0, 5, r.integers(0, 50)) for _ in range(5)]
        got = fm.matches(np.concatenate(queries).astype(np.uint64), np.cumsum([0, *map(len, queries)]))
        assert got.tolist() == [where.get(tuple(q[i : i + depth]), -1) for q in queries for i in range(len(q))]


# --- 9


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 12)).astype(np.float32)
    v[100:160] = v[100]  # many ties
    data = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(400, None), (450, []), (401, [float("nan")] * 12), (402, [None] + [0.0] * 11), (500, [float("inf")] * 12), (None, [0.0] * 12), (550, [0.0] * 12)]
    df = spark.createDataFrame([(i, x, 1, 0) for i, x in data], "vec_id long, embedding array<float>, label int, score int")
    q = {i: np.floor(256 * np.array(x, np.float64)).astype(np.int64) for i, x in data if i is not None and x and not any(y is None or not np.isfinite(y) for y in x)}
    want = []
    for i, x in q.items():
        if i % 50 == 0:
            best = sorted((-int(x @ y), j) for j, y in q.items() if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    monkeypatch.setattr(topk, "CANDIDATES", 90)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "RESOLVED", 2)
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id = 50")).count() == 0


# --- 10


def test_block_max_index():
    r = np.random.default_rng(4)
    w = np.where(r.random((300, 40)) < 0.1, r.random((300, 40)), 0)
    row, term = np.nonzero(w)
    index = toxicity.BlockMaxIndex(300, 40, row, term, w[row, term])
    for i in range(30):
        t = np.sort(r.choice(40, 4, replace=False))
        q = r.random(4)
        score = w[:, t] @ q
        score[i] = 0
        best = [x for x in np.lexsort((np.arange(300), -np.round(score, 12)))[:7] if score[x] > 0]
        rows_, got = index.nearest(t, q, 7, skip=i)
        assert np.allclose(got, score[best]) and np.allclose(score[rows_], score[best])


def test_toxicity(spark, none):
    r = random.Random(9)
    good, bad = [f"w{i}" for i in range(400)], ["vilest", "dreckig", "horrida"]
    data, labels = [], []
    for i in range(600):
        w = [r.choice(good) for _ in range(40)]
        if i % 6 == 0:
            for _ in range(4):
                w[r.randrange(40)] = r.choice(bad) + r.choice(["", "x", "yz"])
        data.append((i, " ".join(w), "en"))
        if i % 4:
            labels.append((i, int(i % 6 == 0), 1))
    data += [(600, None, None), (601, "", None), (None, "vilest vilest dreckig", None)]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(table(spark, data), marks).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(data) and sum(by[i]["predicted"] == (i % 6 == 0) for i in range(600)) > 590
    assert by[600]["predicted"] == by[601]["predicted"] == 0 and by[None]["predicted"] == 1 and by[None]["evidence"]
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    assert toxicity.toxicity(none, marks).count() == 0
    assert {x["score"] for x in toxicity.toxicity(table(spark, data[:5]), marks.limit(0)).collect()} == {0.0}
