"""Benchmark decontamination by winnowing.

Of every `n - k + 1` consecutive k-gram hashes the least is kept (the rightmost of equal ones), so two equal windows of n
words keep the same k-gram at the same place: a join on kept hashes meets every shared window. The benchmark's kept
hashes form a Bloom filter that the pass over the documents asks first; only what it lets through is shuffled, with the
words around it, and each hit is extended to its window and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel as K
from lodestar.llm.shared import Table, strip_to

#: Bits of the Bloom filter for each window of the benchmark, within these bounds.
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 26
#: Words of a k-gram.
GRAM = 5


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """A row per window of an item: item_id, fp (its kept hash), back (words before the kept k-gram), words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, off in K.blocks(batch.column(1)):
                w = K.Words(data, off, K.ALNUM, lower=True)
                start, size, back, fp = [], [], [], []
                first = w.first
                full = np.flatnonzero(K.crossing(w.doc, window))
                if len(full):
                    g = K.kgram_hash(w.hash, gram)
                    least = K.window_min(g, window - gram + 1)[full]
                    start, size, back, fp = [full], [np.full(len(full), window)], [least - full], [g[least]]
                count = np.diff(first)
                for n in np.unique(count[(count > 0) & (count < window)]).tolist():
                    s = first[:-1][count == n]
                    start, size, back, fp = [*start, s], [*size, np.full(len(s), n)], [*back, np.zeros(len(s), np.int64)], [*fp, short_hash(w.hash, n)[s]]
                if start:
                    start, size, back, fp = (np.concatenate(x) for x in (start, size, back, fp))
                    words = w.texts(start, start + size)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + w.doc[start])), pa.array(K.as_long(fp)), pa.array(back.astype(np.int32)), pa.array(size.astype(np.int32)), words], ["item_id", "fp", "back", "size", "words"])

    return strip_to(items, item_id="string", text="string").mapInArrow(cut, "item_id string, fp long, back int, size int, words binary")


def short_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-word items shorter than a window, apart from those of k-grams."""
    return K.mix(K.kgram_hash(h, n) ^ K.U(0xA0761D6478BD642F + n))


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of `bits` bits from the column fp; two bits per hash. At most bits / 64 rows come to the driver."""
    mask = bits - 1
    both = hashes.select(F.explode(F.array(F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", 32).bitwiseAND(mask))).alias("bit"))
    words = both.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(K.U)


def asked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = K.U(len(bits) * 64 - 1)
    out = np.ones(len(h), bool)
    for at in (h & mask, (h >> K.U(32)) & mask):
        out &= bits[(at >> K.U(6)).astype(np.int64)] >> (at & K.U(63)) & K.U(1) > 0
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = GRAM) -> DataFrame:
    """One row per row of `docs` (doc_id, text) against the texts of `items` (item_id, text).

    Words are [0-9a-z] and non-ASCII after A-Z is lower-cased. A window is `window` consecutive words of an item, or all
    of an item with fewer. Returns doc_id, row (a number of the row), n_words, n_hit (words inside an occurrence of a
    window), n_items, items (item_ids with occurring windows, sorted as strings) and spans (start and end word of each
    occurrence, merged). A null or empty text has no words; repeated rows are judged each; an item_id that repeats
    counts once, a null item_id never; a null doc_id stays null; empty tables work on either side; other columns are
    ignored. Whole texts are read: memory holds a block and its words.
    """
    windows = Table(item_windows(items, window, gram).filter("item_id is not null"), "windows")
    sets = windows.df.groupBy("fp", "back", "size", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    sets = Table(sets.withColumn("set_id", F.sha2(F.to_json("items"), 256)), "window-sets")
    stats = sets.df.agg(F.count("*"), F.collect_set(F.when(F.col("size") < window, F.col("size")))).head()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(BITS_PER_WINDOW * stats[0]).bit_length()))
    shorts = sorted(stats[1])
    filter_ = docs.sparkSession.sparkContext.broadcast(bit_filter(sets.df, bits))
    any_full = stats[0] > 0
    hit_type = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("words", pa.binary())]))

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.blocks(batch.column(1)):
                w = K.Words(data, off, K.ALNUM, lower=True)
                at, fp, lead, size = [], [], [], []
                if any_full and len(w.hash) >= window:
                    g = K.kgram_hash(w.hash, gram)
                    full = K.crossing(w.doc, window)
                    kept = np.unique(K.window_min(g, window - gram + 1)[full])
                    kept = kept[asked(filter_.value, g[kept])]
                    reach = window - gram
                    at, fp, lead, size = [kept], [g[kept]], [np.minimum(reach, kept - w.first[w.doc[kept]])], [np.full(len(kept), gram + reach)]
                for n in shorts:
                    s = np.flatnonzero(K.crossing(w.doc, n))
                    h = short_hash(w.hash, n)
                    s = s[asked(filter_.value, h[s])]
                    at, fp, lead, size = [*at, s], [*fp, h[s]], [*lead, np.zeros(len(s), np.int64)], [*size, np.full(len(s), n)]
                if at:
                    at, fp, lead, size = (np.concatenate(x) for x in (at, fp, lead, size))
                    order = np.argsort(w.doc[at], kind="stable")
                    at, fp, lead, size = at[order], fp[order], lead[order], size[order]
                else:
                    at = fp = lead = size = np.zeros(0, np.int64)
                doc = w.doc[at]
                stop = np.minimum(at + size, w.first[doc + 1]) if len(at) else at
                words = w.texts(at - lead, stop)
                inner = pa.StructArray.from_arrays([pa.array(fp.view(np.int64), pa.int64()), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(lead.astype(np.int32)), words], ["fp", "at", "lead", "words"])
                hits = pa.ListArray.from_arrays(pa.array(K.counts_before(np.bincount(doc, minlength=b - a)).astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(w.first)), hits.cast(hit_type)], ["doc_id", "n_words", "hits"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            good = []
            for i, (near, lead, back, size, words) in enumerate(zip(c["near"], c["lead"], c["back"], c["size"], c["words"], strict=True)):
                s = lead - back
                if s >= 0 and b" ".join(near.split(b" ")[s : s + size]) == words:
                    good.append(i)
            start = [c["at"][i] - c["back"][i] for i in good]
            yield pa.RecordBatch.from_arrays([pa.array([c["row"][i] for i in good], pa.int64()), pa.array(start, pa.int32()), pa.array([s + c["size"][i] for s, i in zip(start, good, strict=True)], pa.int32()), pa.array([c["set_id"][i] for i in good], pa.string())], ["row", "start", "end", "set_id"])

    thin = strip_to(docs, doc_id="long", text="string")
    seen = Table(thin.mapInArrow(winnow, "doc_id long, n_words long, hits array<struct<fp:long,at:int,lead:int,words:binary>>").withColumn("row", F.monotonically_increasing_id()), "winnowed").df
    hits = seen.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.fp", "h.at", "h.lead", F.col("h.words").alias("near"))
    met = hits.join(sets.maybe_broadcast().drop("items"), "fp").select("row", "at", "lead", "near", "back", "size", "words", "set_id")
    true = Table(met.mapInArrow(extend, "row long, start int, end int, set_id string").distinct(), "hits").df
    # intervals by start: a fold joins those that touch
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    spans = true.groupBy("row").agg(merged.alias("spans"))
    by_set = sets.df.select("set_id", "items").distinct()
    found = true.select("row", "set_id").distinct().join(by_set, "set_id").select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per_row = Table(spans.join(found, "row", "left"), "contaminated")
    out = seen.select("row", "doc_id", "n_words").join(per_row.maybe_broadcast(), "row", "left")
    no_spans, no_items = F.expr("cast(array() as array<struct<start:int,end:int>>)"), F.expr("cast(array() as array<string>)")
    out = out.withColumn("spans", F.coalesce("spans", no_spans)).withColumn("items", F.coalesce("items", no_items))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]).cast("long"))
    return out.select("doc_id", "row", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The items of each row as a SHA-256 of their sorted, comma-joined item_ids, and whether any word was hit."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
