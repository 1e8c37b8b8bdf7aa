"""A language model of words as a probabilistic suffix tree, learned and applied without holding it in one place.

A state is a context: the last 1 to DEPTH words. It keeps the next symbols that follow it often, and is retained if the
distribution of these (and of all others together) diverges enough from that of its longest retained suffix. A kept
symbol has the probability (n + PRIOR * p) / (total + PRIOR), p being what the suffix gives it; all other symbols share
the rest in the suffix's proportions. Below all states is the distribution of single tokens. So

    log P(token | longest state) = log P0(token) + for every retained suffix of the history: its `rest` factor
                                   + for those that keep the token: the token's own factor over `rest`

is a sum of entries (key, value): one for each known word, each state and each kept symbol. Scoring looks up the keys of
every position. The entries of the most common keys, COMMON of them at most, are broadcast; all others are joined. Seven kinds
of keys share the training tokens, so a key that is joined holds about 7 / COMMON of them at most: none is hot.

Counting goes level by level. The successors of contexts that pass the filter of frequent contexts are gathered per task
as runs (context, its next symbols), dealt out by context, and summed exactly. Contexts that hold many of all tokens are
split by next symbol. Words are known by 56 bits of a hash, contexts and keys by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel as K
from lodestar.llm.decontaminate import asked, bit_filter
from lodestar.llm.shared import Table, strip_to

#: Words of the longest context; occurrences a context needs; occurrences a kept symbol needs, and one in SHARE of the context's.
DEPTH, LEAST_CONTEXT, LEAST_NEXT, SHARE = 3, 16, 4, 32
#: A state is retained if its divergence times its occurrences is COST nats for itself and for each symbol that it keeps.
COST, PRIOR = 8.0, 2.0
#: Bytes of text for each shard of the counts; positions that a task gathers before it hands runs on.
SHARD_BYTES, GATHERED = 16 << 20, 1 << 21
#: Contexts with one in HEAVY of all tokens are split into PIECES.
HEAVY, PIECES = 1024, 64
#: Entries are broadcast for scoring if their keys have one in COMMON_SHARE of all training tokens, the most common first
#: and COMMON of them at most; all others are joined.
COMMON, COMMON_SHARE = 1 << 20, 1 << 22
#: Bits of the filters: about 16 a key, between these.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
U = np.uint64
BASE = U(K.BASE)
END = U(0x5DEECE66D1234)
STRONG, CONTEXT, REPEATED = range(3)


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, document of each, tokens before it in its document) of a block: words by 56-bit hashes, then END."""
    words = K.Words(data, offsets, K.SPACED, lower=True)
    n = len(offsets) - 1
    out = np.empty(len(words.hash) + n, U)
    last = words.first[1:] + np.arange(n)
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[inside], out[last] = words.hash >> U(8), END
    size = np.diff(words.first) + 1
    doc = np.repeat(np.arange(n), size)
    return out, doc, np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)


def context(tokens: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """The context of `level` words before each position; a longer one continues a shorter one."""
    out = np.zeros(len(at), U)
    for j in range(level, 0, -1):
        out *= BASE
        out += tokens[at - j]
    return out


def word_keys(tokens: np.ndarray) -> np.ndarray:
    return K.mix(tokens + U(0x632BE59BD9B4E019))


def state_keys(contexts: np.ndarray, level: int) -> np.ndarray:
    return K.mix(contexts ^ U(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def pair_keys(states: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return K.mix(states * U(0x9FB21C651E98DF25) + symbol)


def planes(a: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first: what is small or equal compresses in the shuffle."""
    return a.astype(U).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, n).T).view(U).ravel()


def word_counts(docs: DataFrame) -> DataFrame:
    """w (a token), n (its count), key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, held = np.zeros(0, U), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            w, c = np.concatenate([words, *(x for x, _ in held)]), np.concatenate([n, *(x for _, x in held)])
            order = np.argsort(w)
            w, c = w[order], c[order]
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
            return w[first], np.add.reduceat(c, first) if len(w) else c

        def out(w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(K.as_long(w)), pa.array(c), pa.array(K.as_long(word_keys(w)))], ["w", "n", "key"])

        for batch in batches:
            for _, _, data, off in K.blocks(batch.column(0)):
                held.append(np.unique(sequence(data, off)[0], return_counts=True))
            if sum(len(x) for x, _ in held) > GATHERED // 2:
                words, n = merged()
                held = []
                if len(words) > GATHERED // 2:
                    yield out(words, n)
                    words, n = words[:0], n[:0]
        words, n = merged()
        for a in range(0, len(words), 1 << 16):
            yield out(words[a : a + (1 << 16)], n[a : a + (1 << 16)])

    return docs.mapInArrow(count, "w long, n long, key long").groupBy("w").agg(F.sum("n").alias("n"), F.first("key").alias("key"))


def key_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A filter of the column fp, `n` hashes about."""
    return bit_filter(hashes, min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length())))


class Level:
    """What a task needs to gather the successors of contexts of one length, and to sum them up."""

    def __init__(self, level: int, shards: int, frequent: np.ndarray, repeated: np.ndarray | None, heavy: np.ndarray, heavy_n: np.ndarray, least: tuple[int, int, int]) -> None:
        self.level, self.shards, self.frequent, self.repeated, self.least = level, shards, frequent, repeated, least
        order = np.argsort(heavy)
        self.heavy, self.heavy_n = heavy[order], heavy_n[order]

    def is_heavy(self, contexts: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return np.zeros(len(contexts), bool)
        return self.heavy[np.minimum(np.searchsorted(self.heavy, contexts), len(self.heavy) - 1)] == contexts

    def positions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, words of them: nearest first, symbols, whether the symbol may be kept) of a block."""
        tokens, _, before = sequence(data, offsets)
        at = np.flatnonzero(before >= self.level)
        c = context(tokens, at, self.level)
        known = asked(self.frequent, K.mix(c))
        at, c = at[known], c[known]
        x = tokens[at]
        good = np.ones(len(at), bool) if self.repeated is None else asked(self.repeated, K.mix(context(tokens, at, self.level - 1) * BASE + x))
        return c, np.stack([tokens[at - j] for j in range(1, self.level + 1)]), x, good

    def runs(self, c: np.ndarray, words: np.ndarray, x: np.ndarray, good: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        """(shard, runs, pairs, data) of what a task has gathered."""
        spot = K.mix(c)
        split = self.is_heavy(c)
        spot[split] = K.mix(spot[split] + (x[split] % U(PIECES)) * U(0xA0761D6478BD642F))
        x = np.where(good, x, U(0))  # symbols that cannot be kept count for the context only
        order = np.argsort((spot & ~U(0xFFFFFF)) | (x & U(0xFFFFFF)))
        spot, c, words, x = spot[order], c[order], words[:, order], x[order]
        new = np.append(True, (c[1:] != c[:-1]) | (spot[1:] != spot[:-1]))
        run = np.flatnonzero(new)
        pair = np.flatnonzero(new | np.append(True, x[1:] != x[:-1]))
        n = np.diff(np.append(pair, len(c)))
        total = np.diff(np.append(run, len(c)))
        keep = x[pair] != 0
        pair, n = pair[keep], n[keep]
        size = np.diff(np.append(np.searchsorted(pair, run), len(pair)))
        shard = ((spot[run] >> U(32)) * U(self.shards) >> U(32)).astype(np.int64)
        edge = np.searchsorted(shard, np.arange(self.shards + 1))
        upto = K.counts_before(size)
        for k in np.unique(shard).tolist():
            r, p = slice(edge[k], edge[k + 1]), slice(upto[edge[k]], upto[edge[k + 1]])
            parts = [*words[:, run[r]], total[r], size[r], x[pair[p]], n[p]]
            yield k, r.stop - r.start, int(p.stop - p.start), b"".join(planes(a) for a in parts)

    def summed(self, n_runs: list[int], n_pairs: list[int], data: list[bytes]) -> dict[str, np.ndarray]:
        """The columns of `count_level` for a shard."""
        fields: list[list[np.ndarray]] = [[] for _ in range(self.level + 4)]
        for r, p, blob in zip(n_runs, n_pairs, data, strict=True):
            raw, at = np.frombuffer(blob, np.uint8), 0
            for i, f in enumerate(fields):
                n = r if i < self.level + 2 else p
                f.append(from_planes(raw[at : at + 8 * n], n))
                at += 8 * n
        *words, total, size, x, n = (np.concatenate(f) for f in fields)
        c = np.zeros(len(total), U)
        for w in reversed(words):
            c *= BASE
            c += w
        kinds, of = np.unique(c, return_inverse=True)
        first = np.full(len(kinds), len(c))
        np.minimum.at(first, of, np.arange(len(c)))
        occurs = np.bincount(of, total.astype(float), len(kinds)).astype(np.int64)
        heavy = self.is_heavy(kinds)
        if heavy.any():
            occurs[heavy] = self.heavy_n[np.searchsorted(self.heavy, kinds[heavy])]
        owner = np.repeat(of, size.astype(np.int64))
        order = np.lexsort((x, owner))
        owner, x, n = owner[order], x[order], n[order].astype(np.int64)
        start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
        owner, x, n = owner[start], x[start], np.add.reduceat(n, start) if len(start) else n
        least_context, least_next, share = self.least
        enough = occurs[owner] >= least_context
        owner, x, n = owner[enough], x[enough], n[enough]
        longer = K.mix(kinds[owner] * BASE + x)  # the context that ends with this symbol
        strong = (n >= least_next) & (n * share >= occurs[owner])
        often, again = n >= least_context, n >= least_next
        s = owner[strong]
        state, keys = state_keys(kinds[s], self.level), []
        suffix = np.zeros(len(s), U)
        for k in range(1, self.level):
            suffix = suffix + words[k - 1][first[s]] * U(pow(K.BASE, k - 1, 1 << 64))
            below = state_keys(suffix, k)
            keys += [below, pair_keys(below, x[strong])]
        parts = [(STRONG, state, pair_keys(state, x[strong]), x[strong], n[strong], occurs[s])]
        parts += [(kind, longer[m], longer[m], kinds[owner[m]] * BASE + x[m], n[m], n[m]) for kind, m in ((CONTEXT, often), (REPEATED, again & ~often))]
        out = {name: np.concatenate([np.broadcast_to(p[i], len(p[1])) for p in parts]) for i, name in enumerate(("kind", "key", "pair", "x", "n", "total"))}
        out["below"] = np.stack(keys, axis=1) if keys else np.zeros((len(s), 0), U)
        return out


def count_level(docs: DataFrame, own: Level) -> DataFrame:
    """What follows the contexts of a level. STRONG rows: state key, pair key, symbol x, its n, the context's total, and the keys
    of its suffixes (`below`: state and pair, shortest first). CONTEXT and REPEATED rows: contexts of the next level (x their
    number, fp their hash in `key`) that occur often enough for a context, or for a kept symbol."""
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            c, words, x, good = (np.concatenate([h[i] for h in held], axis=-1) for i in range(4))
            held.clear()
            if len(c):
                for k, r, p, data in sent.value.runs(c, words, x, good):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([r], pa.int32()), pa.array([p], pa.int32()), pa.array([data], pa.binary())], ["shard", "runs", "pairs", "data"])

        for batch in batches:
            for _, _, data, off in K.blocks(batch.column(0)):
                held.append(sent.value.positions(data, off))
                size += len(held[-1][0])
                if size > GATHERED:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("pair", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("below", pa.list_(pa.int64()))])

    def add(t: pa.Table) -> pa.Table:
        got = sent.value.summed(t["runs"].to_pylist(), t["pairs"].to_pylist(), t["data"].to_pylist())
        n, (rows, width) = len(got["kind"]), got["below"].shape
        at = np.minimum(np.arange(n + 1), rows) * width
        columns = [pa.array(got["kind"], pa.int32()), *(pa.array(K.as_long(got[c].astype(U)) if got[c].dtype == U else got[c], pa.int64()) for c in ("key", "pair", "x", "n", "total"))]
        return pa.table([*columns, K.list_array(K.as_long(got["below"].ravel()), at, pa.int64())], schema=schema)

    blobs = docs.mapInArrow(gather, "shard int, runs int, pairs int, data binary")
    return blobs.groupBy("shard").applyInArrow(add, "kind int, key long, pair long, x long, n long, total long, below array<long>")


def retained(strong: DataFrame, words: DataFrame, entries: DataFrame | None, denominator: float, cost: float, prior: float) -> DataFrame:
    """key, value, weight: the entries of the states that pass the test of divergence from their longest retained suffix."""
    p0 = (F.col("c") + 0.5) / denominator
    s = strong.join(words.select(F.col("w").alias("x"), F.col("n").alias("c")), "x").select("key", "pair", "n", "total", "below", p0.alias("p"))
    if entries is not None:
        lower = strong.select("pair", F.explode("below").alias("key")).join(entries.select("key", "value"), "key").groupBy("pair").agg(F.sum("value").alias("more"))
        s = s.join(lower, "pair", "left").withColumn("p", F.col("p") * F.pow(F.lit(10.0), F.coalesce("more", F.lit(0.0))))
    by_state = s.groupBy("key", "total").agg(  # SHARE symbols at most
        F.count("*").alias("kept"), F.sum("n").alias("seen"), F.sum("p").alias("expected"), F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("p"))).alias("gain"), F.collect_list(F.struct("pair", "n", "p")).alias("symbols")
    )
    unseen, left = F.col("total") - F.col("seen"), F.greatest(1 - F.col("expected"), F.lit(1e-12))
    rest = F.when(unseen > 0, unseen * F.log(unseen / F.col("total") / left)).otherwise(0.0)
    chance = lambda x: (x["n"] + prior * x["p"]) / (F.col("total") + prior)
    good = by_state.filter(F.col("gain") + rest >= cost * (1 + F.col("kept")))
    # what the kept symbols leave to all others, over what the suffix leaves them
    good = good.withColumn("rest", F.log10((unseen + prior * left) / (F.col("total") + prior) / left))
    one = F.struct(F.col("key").alias("key"), F.col("rest").alias("value"), F.col("total").alias("weight"))
    each = F.transform("symbols", lambda x: F.struct(x["pair"].alias("key"), (F.log10(chance(x) / x["p"]) - F.col("rest")).alias("value"), x["n"].alias("weight")))
    return good.select(F.explode(F.concat(F.array(one), each)).alias("e")).select("e.*")


class SuffixTree:
    """The learned model: tables of entries (key, value, weight, word), and the two sizes of the base distribution."""

    def __init__(self, words: DataFrame, levels: list[Table], tokens: int, symbols: int) -> None:
        self.tokens, self.symbols = tokens, symbols
        self.denominator = tokens + 0.5 * (symbols + 1)
        known = words.select("key", (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5))).alias("value"), F.col("n").alias("weight"), F.lit(1).alias("word"))
        self.states = None
        for t in levels:
            self.states = t.df if self.states is None else self.states.unionByName(t.df)
        self.entries = known if self.states is None else known.unionByName(self.states.withColumn("word", F.lit(0)))


def learn(docs: DataFrame, depth: int = DEPTH, least_context: int = LEAST_CONTEXT, least_next: int = LEAST_NEXT, share: int = SHARE, cost: float = COST, prior: float = PRIOR) -> SuffixTree:
    """From the column text of `docs`, null as empty. What is counted and kept grows with the texts; nothing is capped."""
    spark = docs.sparkSession
    texts = docs.select("text")
    words = Table(word_counts(texts), "words")
    tokens, symbols = words.df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // SHARD_BYTES))
    frequent = words.df.filter(F.col("n") >= least_context).select(F.col("w").alias("x"), "n")
    repeated: DataFrame | None = None
    levels: list[Table] = []
    denominator = tokens + 0.5 * (symbols + 1)
    for level in range(1, depth + 1):
        n = frequent.count()
        if not n:
            break
        fp = with_mix(frequent) if level == 1 else frequent.select(F.col("key").alias("fp"))
        heavy = frequent.filter(F.col("n") * HEAVY >= tokens).select("x", "n").toArrow()  # HEAVY rows at most
        own = Level(level, shards, key_filter(fp, n), None if repeated is None else key_filter(repeated, repeated.count()), heavy["x"].to_numpy().view(U), heavy["n"].to_numpy(), (least_context, least_next, share))
        counts = Table(count_level(texts, own), f"successors-{level}")
        below = None
        for t in levels:
            below = t.df if below is None else below.unionByName(t.df)
        levels.append(Table(retained(counts.df.filter(F.col("kind") == STRONG), words.df, below, denominator, cost, prior), f"states-{level}"))
        frequent = counts.df.filter(F.col("kind") == CONTEXT).select("key", "x", "n")
        repeated = counts.df.filter(F.col("kind") != STRONG).select(F.col("key").alias("fp"))
    return SuffixTree(words.df, levels, int(tokens), int(symbols))


def with_mix(words: DataFrame) -> DataFrame:
    """fp: the hashes by which the contexts of one word are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(K.as_long(K.mix(batch.column(0).to_numpy().view(U))))], ["fp"])

    return words.select("x").mapInArrow(run, "fp long")


class Lookup:
    """Entries of common keys, sorted, and the filter of all keys of states and their symbols."""

    def __init__(self, key: np.ndarray, value: np.ndarray, word: np.ndarray, states: np.ndarray | None, depth: int) -> None:
        order = np.argsort(key)
        self.key, self.value, self.word, self.states, self.depth = key[order], value[order], word[order], states, depth

    def values(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether it is here) of keys."""
        if not len(self.key):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        here = self.key[at] == key
        return np.where(here, self.value[at], 0.0), here

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known, base, more) of each document by the common keys, and (document, key) of all other lookups."""
        tokens, doc, before = sequence(data, offsets)
        n = len(offsets) - 1
        key = word_keys(tokens)
        value, here = self.values(key)
        base, known, more = np.bincount(doc, value, n), np.bincount(doc, here, n).astype(np.int64), np.zeros(n)
        docs, keys = [doc[~here]], [key[~here]]
        for level in range(1, self.depth + 1 if self.states is not None else 1):
            at = np.flatnonzero(before >= level)
            state = state_keys(context(tokens, at, level), level)
            some = asked(self.states, state)
            at, state = at[some], state[some]
            pair = pair_keys(state, tokens[at])
            some = asked(self.states, pair)
            for d, k in ((doc[at], state), (doc[at[some]], pair[some])):
                value, here = self.values(k)
                more += np.bincount(d, value, n)
                docs.append(d[~here])
                keys.append(k[~here])
        return np.bincount(doc, minlength=n), known, base, more, np.concatenate(docs), np.concatenate(keys)


def score(docs: DataFrame, tree: SuffixTree, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs` (doc_id, held_out, text)."""
    spark = docs.sparkSession
    # weights in steps of an eighth of a doubling; the highest steps that hold COMMON entries at most
    step = F.floor(8 * F.log2("weight"))
    limit, held = 1 << 62, 0
    for s, n in sorted(tree.entries.groupBy(step.alias("s")).count().collect(), reverse=True):  # a few hundred rows
        held += n
        if held > COMMON:
            break
        limit = s
    is_common = (step >= limit) & (F.col("weight") * COMMON_SHARE >= tree.tokens)
    common = tree.entries.filter(is_common)
    got = common.select("key", "value", "word").toArrow()
    states = None
    if tree.states is not None and (n := tree.states.count()):
        states = key_filter(tree.states.select(F.col("key").alias("fp")), n)
    sent = spark.sparkContext.broadcast(Lookup(got["key"].to_numpy().view(U), got["value"].to_numpy(), got["word"].to_numpy(), states, depth))
    info = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("more", pa.float64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            parts, rows, keys = [], [], []
            for a, b, data, off in K.blocks(batch.column(3)):
                *own, doc, key = sent.value.block(data, off)
                parts.append(own)
                rows.append(row[a:b][doc])
                keys.append(key)
            if not parts:
                continue
            n, known, base, more = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = pa.StructArray.from_arrays([batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(more)], fields=list(info))
            spread = K.mix(row.view(U) + U(0x1D8E4E27C47D124F))  # a key of its own, which no entry has
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(K.as_long(spread)), pa.array(np.zeros(len(row), np.int32)), own], ["row", "key", "n", "info"])
            r, k = np.concatenate(rows), np.concatenate(keys)
            order = np.lexsort((r, k))
            r, k = r[order], k[order]
            first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))[: len(r)])
            times = np.diff(np.append(first, len(r))).astype(np.int32)
            for a in range(0, len(first), 1 << 16):
                at = first[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(r[at]), pa.array(K.as_long(k[at])), pa.array(times[a : a + (1 << 16)]), pa.nulls(len(at), info)], ["row", "key", "n", "info"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    asking = rows.mapInArrow(ask, "row long, key long, n int, info struct<doc_id:long,held_out:boolean,n:long,known:long,base:double,more:double>")
    rare = tree.entries.filter(~is_common).select("key", "value", "word")
    met = asking.join(rare, "key", "left")
    gained = F.col("n") * F.col("value")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = met.groupBy("row").agg(
        F.max("info").alias("i"), F.coalesce(F.sum(F.col("n") * F.col("word")), F.lit(0)).alias("known"), total(F.when(F.col("word") == 1, gained)).alias("base"), total(F.when(F.col("word") == 0, gained)).alias("more")
    )
    per_token = float(np.log10(0.5) - np.log10(tree.denominator))
    base = F.col("i.base") + F.col("base") + per_token * F.col("i.n")
    return out.select("i.doc_id", "i.held_out", F.col("i.n").alias("n_tokens"), (F.col("i.known") + F.col("known")).alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("i.more") + F.col("more")).alias("score"))


def held_out_column() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def language_model(docs: DataFrame, depth: int = DEPTH, least_context: int = LEAST_CONTEXT, least_next: int = LEAST_NEXT, share: int = SHARE, cost: float = COST, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of `docs` (doc_id, text).

    Tokens are the words between the bytes [\\x20\\x09-\\x0D], A-Z lower-cased, and one end. The model is learned from the
    rows whose crc32 of doc_id (as text) mod 5 is not 1. base_score is the log10 probability of a text under the smoothed
    counts of single tokens, score that under the suffix tree; n_known counts the tokens that occur in training.

    A null text is empty and has the end token only; a row without doc_id trains and is scored; repeated rows count and
    are scored each; an empty table gives no rows, and where all rows are held out no token is known; other columns are
    ignored. A text of any length is read in one block.
    """
    thin = strip_to(docs, doc_id="long", text="string").withColumn("held_out", held_out_column())
    tree = learn(thin.filter("not held_out"), depth, least_context, least_next, share, cost, prior)
    return score(thin, tree, depth)
