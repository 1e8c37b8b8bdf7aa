"""Toxicity by the nearest labelled examples under TF-IDF cosine, searched exactly in a block-max inverted index.

Terms are words and their first bytes; the vocabulary is chosen on the examples by how far a term's documents lean to
the toxic label. The index has a posting list per term, cut into blocks of examples; the largest weight of each block
bounds the cosine of everything in it. Blocks are visited by falling bound until none can reach the k-th best cosine, so
the neighbours are the exact ones. They vote with their cosine and the inverse of their label's sampling rate; a
monotone fit of such votes over the examples, each without itself, turns a vote into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel as K
from lodestar.llm.shared import strip_to

#: Examples of each label (about; chosen by a hash of doc_id), terms kept, evidence a term needs, neighbours asked.
EXAMPLES, TERMS, LEAST_G, NEIGHBOURS = 3000, 2048, 15.0, 15
#: Examples in a block of the index, and blocks that are scored before any bound is looked at.
BLOCK, FIRST_BLOCKS = 64, 4
#: A term of more than one in OFTEN rows is held as a column as well.
OFTEN = 12
#: Texts whose bounds are taken together, and the least product that counts.
AT_ONCE, TINY = 64, 1e-300
PREFIXES = (4, 5, 6, 7, 8, 9)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, document of each) of a block: every word and its longer prefixes."""
    w = K.Words(data, offsets, K.ALNUM, lower=True)
    out, doc = [w.hash], [w.doc]
    at, sums = np.arange(len(w.start)), np.zeros(len(w.start), K.U)
    size = w.end - w.start
    for n in range(1, max(PREFIXES) + 1):  # the hash of a prefix grows by one byte a step
        more = size[at] > n
        at, sums = at[more], sums[more]
        sums += (w.data[w.start[at] + n - 1].astype(K.U) + K.U(1)) * K.powers(K.BASE, n)[n - 1]
        if n in PREFIXES:
            out.append(K.mix(K.span_hash(sums, n) + K.U(n)))
            doc.append(w.doc[at])
    return np.concatenate(out), np.concatenate(doc)


class BlockMaxIndex:
    """Unit vectors as posting lists by term, with the largest weight of each block of rows."""

    def __init__(self, n_rows: int, n_terms: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort((row, term))
        self.row, self.weight = row[order].astype(np.int64), weight[order]
        term = term[order]
        self.n_rows, self.n_blocks = n_rows, max(1, -(-n_rows // BLOCK))
        key = term * self.n_blocks + self.row // BLOCK
        self.start = np.searchsorted(key, np.arange(n_terms * self.n_blocks + 1))
        self.most = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(self.most, key, self.weight)
        self.most = self.most.reshape(n_terms, self.n_blocks)
        self.fill_columns()

    def fill_columns(self) -> None:
        """Terms that many rows have are also kept as a column: adding it is quicker than following its list."""
        n_terms = len(self.most)
        term = np.repeat(np.arange(n_terms), np.diff(self.start[:: self.n_blocks]))
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) * OFTEN > self.n_rows)
        self.column = np.full(n_terms, -1)
        self.column[often] = np.arange(len(often))
        self.columns = np.zeros((len(often), self.n_rows))
        mine = self.column[term]
        self.columns[mine[mine >= 0], self.row[mine >= 0]] = self.weight[mine >= 0]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("column", "columns")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.fill_columns()

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of largest positive product (ties to the smaller row), and the products."""
        if not len(term):
            return np.zeros(0, np.int64), np.zeros(0)
        _, rows, products = self.nearest_many(np.array([0, len(term)]), term, weight, k, np.array([skip]))
        return rows, products

    def nearest_many(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, product) of the k best rows of each query, best first; query i is term[first[i]:first[i + 1]], one term at least."""
        found = []
        for a in range(0, len(first) - 1, AT_ONCE):
            b = min(len(first) - 1, a + AT_ONCE)
            x, y = int(first[a]), int(first[b])
            bounds = np.add.reduceat(weight[x:y, None] * self.most[term[x:y]], first[a:b] - x, axis=0)
            for i, s, e in zip(range(a, b), first[a:b].tolist(), first[a + 1 : b + 1].tolist(), strict=True):
                found.append(self.best(term[s:e], weight[s:e], bounds[i - a], k, -1 if skip is None else int(skip[i])))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.repeat(np.arange(len(found)), [len(r) for r, _ in found]), np.concatenate([r for r, _ in found]), np.concatenate([p for _, p in found])

    def best(self, term: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the blocks with the largest bounds first; then of the range of blocks whose bounds reach the k-th best product."""
        blocks = np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS] if self.n_blocks > FIRST_BLOCKS else np.arange(self.n_blocks)
        place = (term[:, None] * self.n_blocks + blocks).ravel()
        at = self.start[place]
        size = self.start[place + 1] - at
        post = K.ranges(at, size)
        got = np.bincount(self.row[post], self.weight[post] * np.repeat(np.repeat(weight, len(blocks)), size), self.n_rows)
        if skip >= 0:
            got[skip] = 0
        open_ = bound > 0
        if self.n_rows >= k:
            open_ &= bound >= np.partition(got, self.n_rows - k)[self.n_rows - k] - 1e-12
        open_[blocks] = False
        left = np.flatnonzero(open_)
        if len(left):
            lo, hi = int(left[0]), int(left[-1]) + 1
            whole = np.zeros(self.n_rows)
            key = term * self.n_blocks
            span = slice(lo * BLOCK, hi * BLOCK)
            for c, x, y, w in zip(self.column[term].tolist(), self.start[key + lo].tolist(), self.start[key + hi].tolist(), weight.tolist(), strict=True):
                if c >= 0:
                    whole[span] += self.columns[c, span] * w
                else:
                    whole[self.row[x:y]] += self.weight[x:y] * w
            got[span] = whole[span]
            if skip >= 0:
                got[skip] = 0
        rows = np.flatnonzero(got >= max(np.partition(got, self.n_rows - k)[self.n_rows - k], TINY) if self.n_rows >= k else got > 0)
        rows = rows[np.lexsort((rows, -got[rows]))[:k]]
        return rows, got[rows]


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: points of a non-decreasing step curve."""
    order = np.argsort(x, kind="stable")
    merged: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        merged.append([xi, xi, yi, wi])
        while len(merged) > 1 and (merged[-2][2] >= merged[-1][2] or merged[-2][1] == merged[-1][0]):
            b, a = merged.pop(), merged.pop()
            merged.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]])
    return np.array([p for m in merged for p in (m[0], m[1])]), np.array([m[2] for m in merged for _ in (0, 1)])


class NearestLabelled:
    """The learned state: vocabulary, weights, index, labels and calibration. Bounded by EXAMPLES and TERMS."""

    def __init__(self, doc_ids: np.ndarray, labels: np.ndarray, rates: dict[int, float], doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        n = len(labels)
        self.doc_ids, self.labels = doc_ids, labels.astype(float)
        self.vote = np.array([1.0 / rates[int(y)] for y in labels]) if n else np.zeros(0)
        total = np.array([np.sum(labels == y) for y in (0, 1)], float)
        code, words = pd.factorize(term)
        have = np.stack([np.bincount(code[labels[doc] == y], minlength=len(words)) for y in (0, 1)]) if len(words) else np.zeros((2, 0))
        lean = np.zeros(len(words))
        if total.min() > 0 and len(words):
            share = have.sum(axis=0) / total.sum()
            for y in (0, 1):
                for seen, expected in ((have[y], share * total[y]), (total[y] - have[y], (1 - share) * total[y])):
                    lean += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
            lean[have[1] * total[0] <= have[0] * total[1]] = 0
        pick = np.flatnonzero(lean >= LEAST_G)
        pick = pick[np.lexsort((words[pick], -lean[pick]))[:TERMS]]
        pick = pick[np.argsort(words[pick])]
        self.words = words[pick]
        self.gate = np.zeros(1 << 16, bool)  # low bits of the vocabulary's hashes
        self.gate[(self.words & K.U(0xFFFF)).astype(np.int64)] = True
        self.idf = np.log(1 + n / np.maximum(1, have.sum(axis=0)[pick])) if len(pick) else np.zeros(0)
        slot = np.full(len(words), -1)
        slot[pick] = np.arange(len(pick))
        keep = slot[code] >= 0 if len(words) else np.zeros(0, bool)
        doc, t = doc[keep], slot[code[keep]] if len(words) else doc
        weight = (1 + np.log(count[keep])) * self.idf[t]
        norm = np.sqrt(np.bincount(doc, weight**2, n))
        weight = weight / norm[doc]
        self.index = BlockMaxIndex(n, max(1, len(pick)), doc, t, weight)
        blank = norm == 0
        mass = np.bincount((self.labels[blank] > 0).astype(int), self.vote[blank], 2) if n else np.zeros(2)
        self.blank = float((mass[1] + 0.5) / (mass.sum() + 1)) if n else 0.0
        if n and not total.min():
            self.blank = float(total[1] > 0)
        order = np.argsort(doc, kind="stable")
        doc, t, weight = doc[order], t[order], weight[order]
        first = np.searchsorted(doc, np.arange(n + 1))
        self.curve: tuple[np.ndarray, np.ndarray] | None = None
        some = np.flatnonzero(~blank)
        if len(some):
            own = np.append(first[some], len(t))  # documents without terms take no room
            q, rows, cos = self.index.nearest_many(own, t, weight, NEIGHBOURS, some)
            self.curve = monotone(self.raw(len(some), q, rows, cos), self.labels[some], self.vote[some])

    def raw(self, n: int, q: np.ndarray, rows: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """Votes of n queries by cosine and sampling rate; a tenth of a vote is what texts without terms have."""
        w = cos * self.vote[rows]
        unit = self.vote.min()
        return (np.bincount(q, w * self.labels[rows], n) + 0.1 * unit * self.blank) / (np.bincount(q, w, n) + 0.1 * unit)

    def scores(self, first: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of texts, and (text, example row, cosine) of their neighbours. Text i has the terms (places in the
        vocabulary) first[i] to first[i + 1], one at least."""
        n = len(first) - 1
        weight = (1 + np.log(count)) * self.idf[term]
        of = np.repeat(np.arange(n), np.diff(first))
        weight = weight / np.sqrt(np.bincount(of, weight**2, n))[of]
        q, rows, cos = self.index.nearest_many(first, term, weight, NEIGHBOURS)
        score = np.full(n, self.blank)
        if self.curve is not None:
            found = np.bincount(q, minlength=n) > 0
            score[found] = np.clip(np.interp(self.raw(n, q, rows, cos)[found], *self.curve), 0, 1)
        return score, q, rows, cos


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> NearestLabelled:
    """From the texts of labelled documents; `labels` (doc_id, label 0 or 1) holds only those that may be learned from.

    A doc_id labelled more than once has its largest label. At most about EXAMPLES documents of each label are read
    whole, chosen by a hash of doc_id, and only term counts come to the driver.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    rates = {y: min(1.0, EXAMPLES / n) for y, n in sizes.items()}
    if not rates:
        none = np.zeros(0, np.int64)
        return NearestLabelled(none, none, {}, none, none.view(K.U), none)
    rate = F.create_map(*[F.lit(x) for y, r in rates.items() for x in (y, int(1e6 * r) + 1)])
    chosen = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate[F.col("y")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.blocks(batch.column(2)):
                h, doc = terms(data, off)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(h)))
                at = K.counts_before(np.bincount(doc[new], minlength=b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), K.list_array(K.as_long(h[new]), at, pa.int64()), K.list_array(n.astype(np.int64), at, pa.int64())], ["doc_id", "y", "terms", "counts"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    got = texts.mapInArrow(count, "doc_id long, y int, terms array<long>, counts array<long>").toArrow().combine_chunks()
    got = got.take(pa.compute.sort_indices(got, [("doc_id", "ascending")]))
    t, c = got["terms"].combine_chunks(), got["counts"].combine_chunks()
    sizes_ = np.asarray(pa.compute.list_value_length(t))
    return NearestLabelled(got["doc_id"].to_numpy(), got["y"].to_numpy().astype(np.int64), rates, np.repeat(np.arange(len(got)), sizes_), t.flatten().to_numpy().view(K.U), c.flatten().to_numpy())


def score_texts(docs: DataFrame, model: NearestLabelled) -> DataFrame:
    """`docs` (text ...) with score and evidence: doc_ids of the nearest examples and their cosines.

    A null or empty text, or one without a known term, has no evidence and the rate of toxic examples among their like.
    """
    docs = docs.drop("score", "evidence")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: NearestLabelled = sent.value
        for batch in batches:
            score, lists = np.full(len(batch), own.blank), []
            for a, _, data, off in K.blocks(batch.column(at_text)):
                if not len(own.words):
                    break
                h, doc = terms(data, off)
                maybe = np.flatnonzero(own.gate[(h & K.U(0xFFFF)).astype(np.int64)])
                h, doc = h[maybe], doc[maybe]
                slot = np.minimum(np.searchsorted(own.words, h), len(own.words) - 1)
                known = own.words[slot] == h
                key, n = np.unique(doc[known] * len(own.words) + slot[known], return_counts=True)
                of, term = key // len(own.words), key % len(own.words)
                start = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
                found, q, rows, cos = own.scores(np.append(start, len(of)), term, n)
                score[a + of[start]] = found
                lists.append((a + of[start][q], rows, cos))
            of, rows, cos = (np.concatenate(x) for x in zip(*lists, strict=True)) if lists else (np.zeros(0, np.int64),) * 3
            inner = pa.StructArray.from_arrays([pa.array(own.doc_ids[rows], pa.int64()), pa.array(cos, pa.float64())], ["doc_id", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(K.counts_before(np.bincount(of, minlength=len(batch))).astype(np.int32)), inner)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), evidence], [*names, "score", "evidence"])

    schema = docs.withColumns({"score": F.lit(0.0), "evidence": F.expr("cast(null as array<struct<doc_id:long,cosine:double>>)")}).schema
    return docs.mapInArrow(run, schema)


def held_out_column() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and evidence for every row of `docs` (doc_id, text).

    Learns from the labels of doc_ids whose crc32 (as text) mod 5 is not 0. Rows without doc_id are scored and not held
    out; repeated rows are scored each; a null text is empty; empty tables work on either side (no labels: score 0);
    other columns are ignored.
    """
    thin = strip_to(docs, doc_id="long", text="string").withColumn("held_out", held_out_column())
    model = learn(thin.filter("not held_out"), labels.filter(~held_out_column()))
    out = score_texts(thin.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
