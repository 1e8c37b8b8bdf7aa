"""Removal of lines that many documents share: two Bloom filters, then an exact count of what they suspect.

One filter holds the line keys seen at least once, the other those seen at least twice. Each task fills a pair over its
own documents; pairs are merged segment by segment (twice = either twice, or both once). A key in two documents is in the
merged second filter for certain, so only the lines found there are shuffled, as 128-bit digests, to be counted exactly
and to choose the document that keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel as K
from lodestar.llm.shared import Table, numbered, place, strip_to, without_columns

#: A filter has about one bit for so many bytes of text, within these bounds. Beyond the upper one more lines are
#: suspected and counted exactly; results stay the same.
BYTES_PER_BIT, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 29
SEGMENT_BYTES = 1 << 14


class Lines:
    """The lines of a block of documents and the keys of those long enough."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int) -> None:
        low = K.LOWER[data]
        cut = np.flatnonzero(data == 0x0A)
        n = len(offsets) - 1
        start = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
        # a document's lines start at its own offset and after each of its newlines
        self.doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, cut, side="right") - 1]), kind="stable")
        end = np.empty_like(start)
        end[:-1] = np.where(self.doc[1:] == self.doc[:-1], start[1:] - 1, offsets[self.doc[:-1] + 1])
        end[-1:] = offsets[-1]
        self.start, self.end = start, end
        solid = np.flatnonzero(K.SPACED[data])
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
        some = b > a
        solid = np.append(solid, 0)
        self.key_start = np.where(some, solid[a], start)
        self.key_end = np.where(some, solid[b - 1] + 1, start)
        chars = K.counts_before((data & 0xC0) != 0x80)
        self.long = np.flatnonzero(chars[self.key_end] - chars[self.key_start] >= min_chars)
        self.low = low
        self.hash = K.hash_spans(low, self.key_start[self.long], self.key_end[self.long])

    def per_doc(self) -> np.ndarray:
        """Indexes into `long` of the first occurrence of each key in each document."""
        if not len(self.long):
            return self.long
        doc = self.doc[self.long]
        order = np.lexsort((np.arange(len(doc)), self.hash, doc))
        h, d = self.hash[order], doc[order]
        first = np.ones(len(order), bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return order[first]


class RepeatFilter:
    """Bits for hashes seen once and seen twice."""

    def __init__(self, bits: int) -> None:
        self.shift = K.U(64 - int(bits).bit_length() + 1)
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, h: np.ndarray) -> None:
        at, n = np.unique(h >> self.shift, return_counts=True)
        at = at.astype(np.int64)
        byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
        again = (n > 1) | (self.once[byte] & bit > 0)
        for filter_, pick in ((self.twice, again), (self.once, slice(None))):
            y, x = byte[pick], bit[pick]
            if len(y):
                first = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
                filter_[y[first]] |= np.bitwise_or.reduceat(x, first)


def seen(twice: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> K.U(64 - int(len(twice) * 8).bit_length() + 1)).astype(np.int64)
    return twice[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def twice_filter(docs: DataFrame, min_chars: int) -> np.ndarray:
    """The merged filter of keys seen at least twice."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(size // BYTES_PER_BIT).bit_length()))
    schema = "segment int, once binary, twice binary"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = RepeatFilter(bits)
        for batch in batches:
            for _, _, data, off in K.blocks(batch.column(1)):
                lines = Lines(data, off, min_chars)
                own.add(lines.hash[lines.per_doc()])
        for a in range(0, bits // 8, SEGMENT_BYTES):
            o = own.once[a : a + SEGMENT_BYTES]
            if o.any():
                yield pa.RecordBatch.from_pylist([{"segment": a // SEGMENT_BYTES, "once": o.tobytes(), "twice": own.twice[a : a + SEGMENT_BYTES].tobytes()}], pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        out: list[dict] = []
        for batch in batches:
            for k, o, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
                if k != at:
                    if at is not None:
                        out.append({"segment": at, "twice": twice.tobytes()})
                    at, once, twice = k, o, t
                else:
                    once, twice = once | o, twice | t | (once & o)
        if at is not None:
            out.append({"segment": at, "twice": twice.tobytes()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("segment", pa.int32()), ("twice", pa.binary())]))

    slots = max(8, docs.sparkSession.sparkContext.defaultParallelism)
    parts = docs.coalesce(slots).mapInArrow(fill, schema)
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    twice = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        a = row["segment"] * SEGMENT_BYTES
        twice[a : a + len(row["twice"])] = np.frombuffer(row["twice"], np.uint8)
    return twice


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`docs` with repeated lines dropped: all its columns, `text` as kept, n_lines (before) and n_dropped.

    A line's key is the line without the bytes [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Keys of at least
    `min_chars` code points in at least `min_docs` documents lose all their lines except in the largest doc_id that
    holds them. A null or empty text is one empty line and gives ''. Rows with a repeated doc_id are one document in
    this count, and all rows of the largest doc_id keep the line. A row without doc_id counts as a document of its own, and
    keeps its lines. One text and its lines fit into memory. Columns
    named n_lines or n_dropped in the input are replaced, all others kept whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = without_columns(docs, "n_lines", "n_dropped")
    thin = strip_to(docs, doc_id="long", text="string")
    twice = spark.sparkContext.broadcast(twice_filter(thin, min_chars))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0)
            for a, _, data, off in K.blocks(batch.column(1)):
                lines = Lines(data, off, min_chars)
                pick = lines.per_doc()
                pick = pick[seen(twice.value, lines.hash[pick])]
                if not len(pick):
                    continue
                raw, at = lines.low.tobytes(), lines.long[pick]
                digest = b"".join(xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(lines.key_start[at].tolist(), lines.key_end[at].tolist(), strict=True))
                d = np.frombuffer(digest, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(a + lines.doc[at])), pa.array(K.as_long(lines.hash[pick])), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["doc_id", "h", "d1", "d2"])

    found = Table(thin.mapInArrow(suspects, "doc_id long, h long, d1 long, d2 long"), "lines")
    per_doc = found.df.groupBy("d1", "d2", "doc_id").agg(F.count("*").alias("rows"))
    n_docs = F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1))
    shared = Table(per_doc.groupBy("d1", "d2").agg(n_docs.alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs).drop("n"), "shared-lines")
    losers = found.df.join(shared.maybe_broadcast(), ["d1", "d2"]).filter(F.col("doc_id") < F.col("keeper"))
    drops = Table(losers.groupBy("doc_id").agg(F.collect_list("h").alias("h")).select(F.col("doc_id").alias("drop_id"), F.col("h").alias("drop_h")), "line-drops")
    plain, names = numbered(docs)
    at_text, at_id = place(names, "text"), place(names, "doc_id")
    joined = plain.join(drops.maybe_broadcast(), F.col(f"c{at_id}").cast("long") == F.col("drop_id"), "left").select(*plain.columns, "drop_h")
    out_schema = plain.withColumn(f"c{at_text}", F.lit("")).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, dropped = batch.column(at_text), batch.column(len(names))
            n_lines, n_dropped = np.ones(len(batch), np.int64), np.zeros(len(batch), np.int64)
            kept: list[pa.Array] = []
            for a, b, data, off in K.blocks(text):
                n_lines[a:b] = 1 + np.diff(K.counts_before(data == 0x0A)[off])
                new = text.slice(a, b - a).fill_null("")
                hit = [i for i in range(b - a) if dropped[a + i].is_valid]
                if hit:
                    lines = Lines(data, off, min_chars)
                    sets = [np.array(dropped[a + i].as_py(), np.int64).view(K.U) for i in hit]
                    which = np.full(b - a, -1)
                    which[hit] = np.arange(len(hit))
                    pair = pd.MultiIndex.from_arrays([np.repeat(hit, [len(s) for s in sets]), np.concatenate(sets)])
                    mine = which[lines.doc[lines.long]] >= 0
                    at = lines.long[mine]
                    gone = pd.MultiIndex.from_arrays([lines.doc[at], lines.hash[mine]]).isin(pair)
                    lost = np.zeros(len(lines.start), bool)
                    lost[at[gone]] = True
                    n_dropped[a:b] = np.bincount(lines.doc[lost], minlength=b - a)
                    raw, texts = data.tobytes(), new.to_pylist()
                    first = np.searchsorted(lines.doc, np.arange(b - a + 1))
                    for i in hit:
                        ls = [k for k in range(first[i], first[i + 1]) if not lost[k]]
                        texts[i] = b"\n".join(raw[lines.start[k] : lines.end[k]] for k in ls).decode()
                    new = pa.array(texts, pa.string())
                kept.append(new.cast(pa.string()))
            columns = list(batch.columns[: len(names)])
            columns[at_text] = pa.concat_arrays(kept) if kept else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], out_schema.names)

    return joined.mapInArrow(keep, out_schema).toDF(*names, "n_lines", "n_dropped")
