"""Language identification by character n-grams in a bit-sliced Bloom filter.

Every position of the filter is a mask with a bit per language. An n-gram's mask is the AND over its positions: all
languages that contain it, found in one lookup. A text's language is the one contained in most of its n-grams, after
taking off what the fill of each language's slice would give by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel as K
from lodestar.llm.shared import strip_to

#: Documents of each language to learn from (about; chosen by a hash of doc_id), and n-grams kept of each.
TRAIN_DOCS, GRAMS = 2000, 1 << 15
#: Bytes of n-grams, over letters with one separator at either end.
SIZES = (3, 4)
#: An n-gram belongs to a language if its share there is at least so much of its largest share.
LEAST_SHARE = 0.25
HASHES = 3
UND = "und"

_LETTER = K.table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_FOLD = np.where(_LETTER, K.LOWER, 0x20).astype(np.uint8)
_ASCII = K.table((0x41, 0x5A), (0x61, 0x7A))
_HAS_LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, document of each) of a block."""
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    text = np.full(len(data) + n_docs + 1, 0x20, np.uint8)
    text[np.arange(len(data)) + doc + 1] = _FOLD[data]
    # capital letters of U+00C0-U+00DE are two bytes, the second 0x20 below the small one's
    second = np.flatnonzero((text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3)) + 1
    text[second] += 0x20
    where = np.zeros(len(text), np.int64)
    where[np.arange(len(data)) + doc + 1] = doc
    letter = text != 0x20
    wide = text.astype(np.uint64)
    codes, docs = [], []
    for n in SIZES:
        m = len(text) - n + 1
        if m <= 0:
            continue
        ok = letter[1 : 1 + m].copy()
        for j in range(2, n - 1):
            ok &= letter[j : j + m]
        at = np.flatnonzero(ok)
        code = np.full(len(at), n, np.uint64)
        for j in range(n):
            code = code << K.U(8) | wide[at + j]
        codes.append(code)
        docs.append(where[at + 1])
    return (np.concatenate(codes), np.concatenate(docs)) if codes else (np.zeros(0, K.U), np.zeros(0, np.int64))


@dataclass
class LanguageFilter:
    langs: list[str]  # the most frequent first
    masks: np.ndarray  # position x (languages in bytes of eight)
    chance: np.ndarray  # false positives of each language's slice

    def positions(self, codes: np.ndarray) -> list[np.ndarray]:
        h, m = K.mix(codes), K.U(len(self.masks) - 1)
        return [(h >> K.U(20 * i) & m).astype(np.int64) for i in range(HASHES)]

    def add(self, lang: int, codes: np.ndarray) -> None:
        for at in self.positions(codes):
            self.masks[at, lang >> 3] |= np.uint8(1 << (lang & 7))

    def counts(self, codes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each document, those contained in each language, corrected)."""
        n = np.bincount(doc, minlength=n_docs)
        places = self.positions(codes)
        per_lang = []
        for byte in range(self.masks.shape[1]):
            column = self.masks[:, byte]
            found = column[places[0]]
            for at in places[1:]:
                found = found & column[at]
            table = np.bincount(doc * 256 + found, minlength=n_docs * 256).reshape(n_docs, 256)
            bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
            per_lang.append(table @ bits)
        hits = np.concatenate(per_lang, axis=1)[:, : len(self.langs)]
        return n, np.maximum(0.0, (hits - n[:, None] * self.chance) / (1 - self.chance))


def learn(docs: DataFrame) -> LanguageFilter:
    """The filter of the languages in `docs` (doc_id, text, lang), all of which may be learned from."""
    docs = docs.filter("lang is not null and text is not null and doc_id is not null")
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return LanguageFilter([], np.zeros((1, 1), np.uint8), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, int(1e6 * min(1.0, TRAIN_DOCS / sizes[k])) + 1)])
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate[F.col("lang")])
    code_of = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([code_of[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, _, data, off in K.blocks(batch.column(0)):
                code, doc = grams(data, off)
                key, n = np.unique(code | (lang[a + doc].astype(K.U) << K.U(44)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(K.as_long(key)), pa.array(n)], ["key", "n"])

    rows = sample.select("text", "lang").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 2").toArrow()
    key, n = rows["key"].to_numpy().view(K.U), rows["n"].to_numpy()
    lang, code = (key >> K.U(44)).astype(np.int64), key & K.U((1 << 44) - 1)
    share = n / np.maximum(1, np.bincount(lang, n, len(langs)))[lang]
    which = np.unique(code, return_inverse=True)[1]
    best = np.zeros(int(which.max(initial=-1)) + 1)
    np.maximum.at(best, which, share)
    own = share >= LEAST_SHARE * best[which]
    bits = 1 << min(20, int(16 * min(GRAMS, max(1, np.bincount(lang[own], minlength=1).max(initial=1)))).bit_length())
    out = LanguageFilter(langs, np.zeros((bits, (len(langs) + 7) // 8), np.uint8), np.zeros(len(langs)))
    for i in range(len(langs)):
        mine = np.flatnonzero(own & (lang == i))
        mine = mine[np.lexsort((code[mine], -n[mine]))[:GRAMS]]
        out.add(i, code[mine])
    fill = np.array([(out.masks[:, i >> 3] >> (i & 7) & 1).mean() for i in range(len(langs))])
    out.chance = np.minimum(fill**HASHES, 0.99)
    return out


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """`docs` (text ...) with lang_pred and score: the best language's share of the corrected counts.

    `und` (score 0) if a text is null or has no letter, or nothing was learned; a text with letters but no n-gram of any
    language gets the most frequent language with score 0. Other columns stay; one named like a result is replaced.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: LanguageFilter = sent.value
        labels = np.array([*own.langs, UND], object)
        for batch in batches:
            text = batch.column(at_text)
            pred, score = np.full(len(batch), len(own.langs)), np.zeros(len(batch))
            for a, b, data, off in K.blocks(text):
                if not own.langs:
                    continue
                some = np.diff(K.counts_before(_ASCII[data])[off]) > 0
                for i in np.flatnonzero(~some).tolist():
                    some[i] = bool(_HAS_LETTER.search(data[off[i] : off[i + 1]].tobytes().decode()))
                code, doc = grams(data, off)
                _, counts = own.counts(code, doc, b - a)
                best, total = counts.argmax(axis=1), counts.sum(axis=1)
                pred[a:b] = np.where(some, best, len(own.langs))
                score[a:b] = np.where(some & (total > 0), counts.max(axis=1) / np.where(total > 0, total, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[pred], pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)


def held_out_column() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang).

    Learns from rows with a doc_id, a text and a lang whose crc32(doc_id as text) mod 4 is not 2. Rows without doc_id
    are judged and not held out; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    thin = strip_to(docs, doc_id="long", text="string", lang="string").withColumn("held_out", held_out_column())
    model = learn(thin.filter("not held_out"))
    return predict(thin.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
