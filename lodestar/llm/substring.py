"""Removal of passages that a document with a smaller doc_id already has, by FM-indexes.

Documents are not streamed through every index: a window (13 words) keeps the least of its 6-word hashes as its anchor,
so equal windows keep equal anchors, and the least doc_id A that keeps an anchor names the shard that its windows are
sent to. An FM-index is built of the passages of such first documents, shard by shard, and the candidate passages of all
others (once for each different text) are streamed through it: backward search over a wavelet matrix gives matching
statistics, cut at the window's length, and for each full match the least document that has it. A window found there is
one that A, or a still smaller document of the shard, has: its words go.

What is not found in A can still be shared by later documents (the anchor stands in A, the window does not). Those
windows alone go through the same steps again with anchors as long as the window, whose first document has the window
itself. So no window is missed, an index holds text of first documents only, and a passage that very many documents
share is only searched more often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel as K
from lodestar.llm.decontaminate import asked, bit_filter
from lodestar.llm.fmindex import FMIndex
from lodestar.llm.shared import Table, heavy_keys, heavy_limit, join_heavy, numbered, place, strip_to, without_columns

#: Words of an anchor; of the anchors of a window the least is kept.
GRAM = 6
#: Words of an index, and of the queries streamed through it in one task.
SHARD_WORDS, QUERY_WORDS = 400_000, 2_000_000
#: Queries are cut into parts of so many windows, so that all are searched in step.
PART = 200
#: First documents fall into so many buckets; shards are made of buckets.
BUCKETS = 1 << 20
MOST_BITS = 1 << 26
#: Stands for the owner of a window that is not indexed: no doc_id is above it.
NOBODY = np.iinfo(np.int64).max


def kept_anchors(w: K.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes, window starts, kept anchor of each window)."""
    full = np.flatnonzero(K.crossing(w.doc, window))
    g = K.kgram_hash(w.hash, gram)
    return g, full, K.window_min(g, window - gram + 1)[full] if len(full) else full


def runs_of(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True; no run goes past a position where `breaks` is True."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = flag & np.append(True, ~flag[:-1] | breaks[1:])
    stop = flag & np.append(~flag[1:] | breaks[1:], True)
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def repeated_anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Anchors kept in two documents at least: fp, a (the least of them), n (how often kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, _, data, off in K.blocks(batch.column(1)):
                w = K.Words(data, off, K.SPACED, lower=False)
                g, _, least = kept_anchors(w, window, gram)
                at = np.unique(least)
                yield pa.RecordBatch.from_arrays([pa.array(K.as_long(g[at])), ids.take(pa.array(a + w.doc[at]))], ["fp", "doc_id"])

    rows = texts.select("doc_id", "text").mapInArrow(run, "fp long, doc_id long")
    return rows.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a < b").drop("b")


def candidate_runs(texts: DataFrame, anchors: DataFrame, heavy: list, window: int, gram: int) -> DataFrame:
    """Runs of windows whose kept anchor repeats: doc_id, th, start (word), words; per stretch of windows with one anchor
    fp (null where the anchor is a heavy one), a (its first document; known for heavy ones), upto (window of the run at
    which the stretch ends)."""
    n = anchors.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << int(16 * n).bit_length()))
    order = np.argsort(np.array([r["fp"] for r in heavy], np.int64))
    heavy_fp, heavy_a = (np.array([r[c] for r in heavy], np.int64)[order] for c in ("fp", "a"))
    filter_ = texts.sparkSession.sparkContext.broadcast((bit_filter(anchors, bits), heavy_fp, heavy_a))
    names = ["doc_id", "th", "start", "words", "fp", "a", "upto"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_, some_fp, some_a = filter_.value
        for batch in batches:
            ids, th, base = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            for i, _, data, off in K.blocks(batch.column(3)):
                w = K.Words(data, off, K.SPACED, lower=False)
                g, full, least = kept_anchors(w, window, gram)
                pick = asked(bits_, g[least]) if len(full) else np.zeros(0, bool)
                if not pick.any():
                    continue
                at, kept = full[pick], least[pick]
                new_run = np.append(True, (np.diff(at) != 1) | (w.doc[at[1:]] != w.doc[at[:-1]]))
                new_part = new_run | np.append(True, np.diff(kept) != 0)
                runs, parts = np.flatnonzero(new_run), np.flatnonzero(new_part)
                start, stop = at[runs], at[np.append(runs[1:], len(at)) - 1] + 1
                own = np.cumsum(new_run)[parts] - 1  # the run of each stretch
                upto = np.append(parts[1:], len(at)) - runs[own]
                fp = K.as_long(g[kept[parts]])
                where = np.minimum(np.searchsorted(some_fp, fp), max(0, len(some_fp) - 1))
                known = some_fp[where] == fp if len(some_fp) else np.zeros(len(fp), bool)
                offsets = pa.array(np.append(np.searchsorted(own, np.arange(len(runs))), len(parts)).astype(np.int32))
                lists = [pa.array(fp, pa.int64(), mask=known), pa.array(some_a[where] if len(some_fp) else fp, pa.int64(), mask=~known), pa.array(upto.astype(np.int32))]
                doc = w.doc[start]
                rows = pa.array(i + doc)
                first = pa.array(base[i + doc] + start - w.first[doc])
                yield pa.RecordBatch.from_arrays([ids.take(rows), th.take(rows), first, w.texts(start, stop + window - 1), *[pa.ListArray.from_arrays(offsets, x) for x in lists]], names)

    return texts.select("doc_id", "th", "base", "text").mapInArrow(run, "doc_id long, th long, start long, words binary, fp array<long>, a array<long>, upto array<int>")


def located(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """`runs` with js and firsts: the first document of each stretch whose anchor truly repeats."""
    keys = runs.select("run", F.posexplode("fp").alias("j", "fp")).filter("fp is not null")
    heavy = runs.select("run", F.posexplode("a").alias("j", "a")).filter("a is not null")
    met = keys.join(anchors.select("fp", "a"), "fp").select("run", "j", "a").unionByName(heavy)
    per_run = met.groupBy("run").agg(F.collect_list(F.struct("j", "a")).alias("w"))
    return runs.join(per_run.select("run", F.col("w.j").alias("js"), F.col("w.a").alias("firsts")), "run").select("doc_id", "th", "start", "words", "upto", "js", "firsts")


def bucket_of(first: np.ndarray) -> np.ndarray:
    return (K.mix(first.astype(np.int64).view(K.U) + K.U(0x51ED270B)) % K.U(BUCKETS)).astype(np.int64)


PIECE = "query boolean, bucket long, doc_id long, th long, start long, n long, d1 long, d2 long, words binary"


def pieces_of(rows: DataFrame, window: int) -> DataFrame:
    """Index pieces (their anchors' first document is their own) and query pieces (windows of one bucket, first document a smaller one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECE.split(", ")]
        for batch in batches:
            if not len(batch):
                continue
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            raw, off = K.string_buffers(c["words"])
            w = K.Words(raw[off[0] : off[-1]], off - off[0], K.SPACED, lower=False)
            size = np.diff(w.first) - window + 1  # windows of each run
            at = K.counts_before(size)
            upto = c["upto"]
            part_off = upto.offsets.to_numpy().astype(np.int64)
            n_parts = np.diff(part_off)
            ends = upto.values.to_numpy()[part_off[0] : part_off[-1]].astype(np.int64)
            before = np.append(0, ends[:-1])
            before[(part_off[:-1] - part_off[0])[n_parts > 0]] = 0
            known, first = np.zeros(len(ends), bool), np.zeros(len(ends), np.int64)
            js, firsts = c["js"], c["firsts"]
            j_off = js.offsets.to_numpy().astype(np.int64)
            place = np.repeat(part_off[:-1] - part_off[0], np.diff(j_off)) + js.values.to_numpy()[j_off[0] : j_off[-1]]
            known[place], first[place] = True, firsts.values.to_numpy()[firsts.offsets[0].as_py() : firsts.offsets[-1].as_py()]
            known, first = np.repeat(known, ends - before), np.repeat(first, ends - before)  # per window, of all runs
            of = np.repeat(np.arange(len(batch)), size)
            doc_id, th, start = (c[x].to_numpy() for x in ("doc_id", "th", "start"))
            bucket = bucket_of(first)
            new = np.append(True, of[1:] != of[:-1])
            change = new | np.append(True, bucket[1:] != bucket[:-1])
            found = []
            for query, flag, breaks in ((False, known & (first == doc_id[of]), new), (True, known & (first < doc_id[of]), change)):
                s, e = runs_of(flag, breaks)
                if query:
                    k = -(-(e - s) // PART)
                    cut = K.ranges(np.zeros(len(k), np.int64), k) * PART
                    s, e = np.repeat(s, k) + cut, np.minimum(np.repeat(e, k), np.repeat(s, k) + cut + PART)
                found.append((np.full(len(s), query), s, e))
            query, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
            r = of[s]
            word = w.first[r] + s - at[r]
            texts = w.texts(word, word + e - s + window - 1)
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in texts.to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(bucket[s]), pa.array(doc_id[r]), pa.array(th[r]), pa.array(start[r] + s - at[r]), pa.array(e - s + window - 1), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), texts.cast(pa.binary())], names)

    return rows.mapInArrow(run, PIECE)


def matched(pieces: DataFrame, queries: DataFrame, window: int) -> DataFrame:
    """bucket, d1, d2 and, per window of a query text, the least document of its shard that has it (NOBODY: none): mins."""
    index = pieces.filter("not query")
    total = index.agg(F.sum("n")).head()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    shard = (F.col("bucket") % F.lit(shards)).alias("shard")
    parts = queries.groupBy(shard).agg(F.ceil(F.sum("n") / QUERY_WORDS).cast("int").alias("parts"))
    texts = index.select(shard, F.col("doc_id").alias("d1"), F.lit(0).cast("long").alias("d2"), F.col("bucket"), "words").join(parts, "shard")
    texts = texts.select("shard", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(False).alias("query"), "bucket", "d1", "d2", "words")
    asked_ = queries.select(shard, "bucket", "d1", "d2", "words").join(parts, "shard").select("shard", F.pmod(F.xxhash64("d1", "d2"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("query"), "bucket", "d1", "d2", "words")
    schema = pa.schema([("bucket", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("mins", pa.list_(pa.int64()))])

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ask = group["query"].to_numpy()
        mine, theirs = group.filter(pa.array(~ask)), group.filter(pa.array(ask))
        if not len(theirs) or not len(mine):
            return schema.empty_table()
        sides = []
        for t in (mine, theirs):
            raw, off = K.string_buffers(t["words"])
            sides.append(K.Words(raw[off[0] : off[-1]], off - off[0], K.SPACED, lower=False))
        fm = FMIndex(sides[0].hash, sides[0].first, mine["d1"].to_numpy(), window)
        q = sides[1]
        known, least = fm.owners(q.hash, q.first)
        least = np.where(known, least, NOBODY)
        size = np.diff(q.first) - window + 1
        mins = K.list_array(least[K.ranges(q.first[:-1], size)], K.counts_before(size), pa.int64())
        return pa.Table.from_arrays([theirs["bucket"], theirs["d1"], theirs["d2"], mins], schema=schema)

    return texts.unionByName(asked_).groupBy("shard", "part").applyInArrow(search, "bucket long, d1 long, d2 long, mins array<long>")


ANSWER = "doc_id long, th long, start long, end long, words binary"


def answers_of(pieces: DataFrame, queries: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Word intervals to remove (words: null), and the windows that were not found, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            doc_id, th, start = (batch.column(i).to_numpy() for i in range(3))
            mins = batch.column(4)
            raw, off = K.string_buffers(batch.column(3))
            w = K.Words(raw[off[0] : off[-1]], off - off[0], K.SPACED, lower=False)
            at = mins.offsets.to_numpy().astype(np.int64)
            least = mins.values.to_numpy()[at[0] : at[-1]]
            at = at - at[0]
            of = np.repeat(np.arange(len(batch)), np.diff(at))
            new = np.append(True, of[1:] != of[:-1])
            hit = least < doc_id[of]
            for flag, gone in ((hit, True), (~hit, False)):
                s, e = runs_of(flag, new)
                r = of[s]
                first = start[r] + s - at[r]
                word = w.first[r] + s - at[r]
                words = pa.nulls(len(s), pa.binary()) if gone else w.texts(word, word + e - s + window - 1).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_id[r]), pa.array(th[r]), pa.array(first), pa.array(first + e - s + window - 1), words], ["doc_id", "th", "start", "end", "words"])

    asked_ = pieces.filter("query").select("bucket", "d1", "d2", "doc_id", "th", "start", "words")
    met = join_heavy(asked_, found, ["bucket", "d1", "d2"], heavy_keys(queries, ["bucket", "d1", "d2"], "copies"), "doc_id")
    return met.select("doc_id", "th", "start", "words", "mins").mapInArrow(run, ANSWER)


def resolve(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """One round, for the windows of `texts` (doc_id, th, base, text): what answers_of() gives, as a written table."""
    anchors = Table(repeated_anchors(texts, window, gram), "anchors")
    heavy = anchors.df.filter(F.col("n") >= heavy_limit(anchors.df.agg(F.sum("n")).head()[0])).select("fp", "a").collect()
    runs = Table(candidate_runs(texts, anchors.df, heavy, window, gram).withColumn("run", F.monotonically_increasing_id()), "runs")
    pieces = Table(pieces_of(located(runs.df, anchors.df), window), "pieces")
    anchors.drop()
    runs.drop()
    queries = Table(pieces.df.filter("query").groupBy("bucket", "d1", "d2").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("words").alias("words")), "query-texts")
    found = Table(matched(pieces.df, queries.df, window), "matches")
    out = Table(answers_of(pieces.df, queries.df, found.df, window), "answers").df
    for t in (pieces, queries, found):
        t.drop()
    return out


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """`docs` (doc_id, text ...) without repeated passages: all columns, `text` as kept words joined by one space, n_words
    (before) and n_removed.

    Words are what [\\x20\\x09-\\x0D] separates, unchanged; words and runs of them are known by 64-bit hashes, query texts by
    128-bit ones, and are not compared byte by byte. A word goes if a window of `window` consecutive words over it also
    starts in a document with a smaller doc_id, negative ones included; all windows are judged on the input. A null or
    empty text has no words and gives ''; texts shorter than a window stay whole. Rows with a repeated doc_id never
    remove from each other; a row without doc_id neither loses words nor takes any. An empty table gives no rows; columns
    named n_words or n_removed in the input are replaced, all others kept whatever their names. One text and its words fit into memory; whatever is more
    follows blocks, shards and parts.
    """
    docs = without_columns(docs, "n_words", "n_removed")
    thin = strip_to(docs, doc_id="long", text="string").filter("doc_id is not null and text is not null").withColumn("th", F.xxhash64("text"))
    first = resolve(thin.withColumn("base", F.lit(0).cast("long")), window, min(GRAM, window))
    again = first.filter("words is not null").select("doc_id", "th", F.col("start").alias("base"), F.col("words").alias("text"))
    second = resolve(again, window, window)
    gone = first.filter("words is null").unionByName(second.filter("words is null")).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("cut"))
    cuts = Table(gone.select(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th"), "cut"), "cuts")
    plain, names = numbered(docs)
    at_text, at_id = place(names, "text"), place(names, "doc_id")
    on = (F.col(f"c{at_id}").cast("long") == F.col("cut_id")) & (F.xxhash64(F.col(f"c{at_text}").cast("string")) == F.col("cut_th"))
    joined = plain.join(cuts.maybe_broadcast(), on, "left").select(*plain.columns, "cut")
    out_schema = plain.withColumn(f"c{at_text}", F.lit("")).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = batch.column(len(names))
            n_words, n_removed, texts = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), []
            for a, b, data, off in K.blocks(batch.column(at_text)):
                w = K.Words(data, off, K.SPACED, lower=False)
                gone = np.zeros(len(w.hash) + 1, np.int64)
                for i in range(b - a):
                    if cut[a + i].is_valid:
                        for x in cut[a + i].as_py():
                            gone[w.first[i] + x["start"]] += 1
                            gone[w.first[i] + x["end"]] -= 1
                left = np.cumsum(gone)[:-1] == 0
                n_words[a:b] = np.diff(w.first)
                n_left = np.diff(K.counts_before(left)[w.first])
                n_removed[a:b] = n_words[a:b] - n_left
                # the kept words, each with the byte after it made a space, then documents without their last space
                s, size = w.start[left], w.end[left] - w.start[left] + 1
                padded = np.append(data, np.uint8(32))
                flat = padded[K.ranges(s, size)]
                if len(size):
                    flat[np.cumsum(size) - 1] = 32
                ends = K.counts_before(size)[K.counts_before(n_left)]
                raw = flat.tobytes()
                texts += [raw[x : max(x, y - 1)].decode() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = list(batch.columns[: len(names)])
            columns[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(n_removed)], out_schema.names)

    return joined.mapInArrow(keep, out_schema).toDF(*names, "n_words", "n_removed")
