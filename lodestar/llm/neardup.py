"""Near-duplicates by word shingles: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

A document's shingle hashes are split by their high bits into bins; the least of each bin is a signature value (optimal
densification: an empty bin copies the first bin that has a value in an order of its own). Runs of values are bucket
keys. Equal sets are one vertex from the start, so copies cost nothing further.

In each bucket the member that meets most others over all its buckets is the centre c, and only (c, member) pairs are
compared on full sets. What else could be linked follows from those comparisons, without comparing all pairs:

* Members linked to c are one component already.
* d = 1 - similarity is a metric, so a member below 0.5 to c (far) is not linked to one that is linked to c.
* Members between (0.5 or more to c, not linked) are compared with those around c by what they add to c and lack of it,
  in cells of a bounded number of members; a cell gives out a spanning forest of its links, never its pairs.

* Far members are compared with each other and with those between by their signatures, in tiles of a bounded number of
  members, and only those that agree well enough, and are not of one component by then, on full sets. Where most of a
  tile agrees, its far members get a centre of their own in another round instead, so that pairs are never given out by
  the square. A bucket with very many far members is first split by a second one, for linked sets share many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel as K
from lodestar.llm.components import components
from lodestar.llm.shared import Table, strip_to

#: Bands of signature values. A pair at similarity 0.75 misses all 50 of 4 values with probability 6e-9.
BANDS, ROWS = 50, 4
BINS = BANDS * ROWS
#: Members on either side of a tile of far members; a bucket with more than SPLIT_FROM is split by a second one, SPLITS times.
FAR_CELL, SPLIT_FROM, SPLITS = 2048, 1 << 16, 2
#: Pairs of signatures that are compared at once.
AT_ONCE = 1 << 15
#: A tile with more agreeing pairs a member than CROWD goes to another round, in the first ROUNDS of them.
CROWD, ROUNDS = 256, 4
#: Signature agreement below which sets are far apart, or not linked; both 5 deviations or more below 0.5 and 0.75. Sets of
#: fewer than SURE shingles are always compared.
FAR_AGREEMENT, LINK_AGREEMENT, SURE = 0.32, 0.55, 8
#: Members on either side of a cell.
CELL = 2048

_rng = np.random.default_rng(20_240)
#: For every bin, the order in which an empty one asks the others.
DONORS = np.stack([_rng.permutation(BINS) for _ in range(BINS)]).astype(np.int64)


class Shingles:
    """The distinct shingle hashes of each document of a block, sorted."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int) -> None:
        w = K.Words(data, offsets, K.SPACED, lower=True)
        full = K.crossing(w.doc, size)
        h, doc = K.kgram_hash(w.hash, size)[full], w.doc[: len(full)][full]
        n_words = np.diff(w.first)
        for n in range(1, size):
            few = np.flatnonzero(n_words == n)
            if len(few):
                h = np.append(h, K.mix(K.kgram_hash(w.hash, n)[w.first[few]] ^ K.U(n)))
                doc = np.append(doc, few)
        order = np.argsort(h)
        order = order[np.argsort(doc[order].astype(np.uint16 if len(offsets) < 65536 else np.int64), kind="stable")]
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = h[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.size = np.diff(self.first)

    def set_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each document's set, whatever its order."""
        out = []
        for seed in (0x632BE59BD9B4E019, 0x1B873593CC9E2D51):
            total = np.zeros(len(self.hash) + 1, K.U)
            np.cumsum(K.mix(self.hash ^ K.U(seed)), out=total[1:])
            out.append(K.as_long(K.mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(K.U))))
        return out[0], out[1]

    def signatures(self) -> np.ndarray:
        """A row of BINS values per document that has shingles."""
        some = np.flatnonzero(self.size)
        row = np.cumsum(self.size > 0) - 1
        where = row[self.doc] * BINS + ((self.hash >> K.U(32)) * K.U(BINS) >> K.U(32)).astype(np.int64)
        least = np.ones(len(where), bool)
        least[1:] = where[1:] != where[:-1]  # hashes are sorted, and so are bins: the first of a run is its least
        sig = np.zeros(len(some) * BINS, K.U)
        filled = np.zeros(len(some) * BINS, bool)
        sig[where[least]], filled[where[least]] = self.hash[least], True
        empty = np.flatnonzero(~filled)
        base, own, t = empty - empty % BINS, empty % BINS, 0
        while len(empty):
            donor = base + DONORS[own, t]
            got = filled[donor]
            sig[empty[got]] = sig[donor[got]]
            empty, base, own, t = empty[~got], base[~got], own[~got], t + 1
        return sig.reshape(-1, BINS)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hashes of the set), bands (bucket keys), sig (a byte per bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in K.blocks(batch.column(1)):
                s = Shingles(data, off, size)
                sig = s.signatures()
                keys = np.zeros((len(sig), BANDS), K.U)
                keys += np.arange(1, BANDS + 1, dtype=K.U) * K.U(0x9FB21C651E98DF25)
                for j in range(ROWS):
                    keys = K.mix(keys + sig[:, j::ROWS])
                some = s.size > 0
                bytes_ = np.ascontiguousarray((K.mix(sig.copy()) & K.U(255)).astype(np.uint8))
                sigs = iter([bytes_[i].tobytes() for i in range(len(bytes_))])
                h1, h2 = s.set_hashes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(s.size), pa.array(h1), pa.array(h2), K.list_array(K.as_long(keys.ravel()), K.counts_before(np.where(some, BANDS, 0)), pa.int64()), pa.array([next(sigs) if x else b"" for x in some], pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(vid, shingles) of the sets in `wanted` (vid, h1, h2), once each. A bounded Bloom filter spares the others; the join is exact."""
    from lodestar.llm.decontaminate import asked, bit_filter

    n = wanted.count()
    bits = min(1 << 26, max(1 << 16, 1 << int(16 * n).bit_length()))
    filter_ = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.col("h1").alias("fp")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in K.blocks(batch.column(1)):
                s = Shingles(data, off, size)
                h1, h2 = s.set_hashes()
                pick = np.flatnonzero((s.size > 0) & asked(filter_.value, h1.view(K.U)))
                _, once = np.unique(np.stack([h1[pick], h2[pick]]), axis=1, return_index=True)
                pick = pick[once]
                raw = s.hash.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(h1[pick]), pa.array(h2[pick]), pa.array([raw[8 * s.first[i] : 8 * s.first[i + 1]] for i in pick.tolist()], pa.binary())], ["h1", "h2", "shingles"])

    return docs.mapInArrow(run, "h1 long, h2 long, shingles binary").groupBy("h1", "h2").agg(F.first("shingles").alias("shingles")).join(wanted, ["h1", "h2"]).select("vid", "shingles")


def agreeing(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs (c, m) whose signatures and sizes do not show that they are far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, BINS) for i in (2, 3))
            share = np.count_nonzero(x == y, axis=1) / BINS
            keep = pa.array((share >= FAR_AGREEMENT) | (batch.column(4).to_numpy() < SURE))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["c", "m"])

    sig = vertices.select("vid", "sig", "n_shingles")
    left, right = (sig.select(F.col("vid").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("n_shingles").alias(f"n_{k}")) for k in "cm")
    near = pairs.join(right, "m").join(left, "c").filter("2 * least(n_c, n_m) >= greatest(n_c, n_m)")
    return near.select("c", "m", "sig_c", "sig_m", F.least("n_c", "n_m").alias("n")).mapInArrow(run, "c long, m long")


def relations(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """c, m, linked, n (size of m) and delta (hashes of what m adds and of what it lacks) for pairs (c, m) of similarity 0.5 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, link, size_, delta = [], [], [], []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, K.U), np.frombuffer(y, K.U)
                new = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] != y
                both = len(y) - int(new.sum())
                united = len(x) + len(y) - both
                if 2 * both < united:
                    continue
                lost = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x
                at.append(i)
                link.append(100 * both >= percent * united)
                size_.append(len(y))
                delta.append(np.concatenate([y[new], ~x[lost]]))
            pick = pa.array(at, pa.int64())
            lists = K.list_array(K.as_long(np.concatenate(delta)) if delta else np.zeros(0, np.int64), K.counts_before(np.array([len(a) for a in delta], np.int64)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(link, pa.bool_()), pa.array(size_, pa.int64()), lists], ["c", "m", "linked", "n", "delta"])

    with_m = pairs.join(sets.select(F.col("vid").alias("m"), F.col("shingles").alias("set_m")), "m")
    with_c = with_m.join(sets.select(F.col("vid").alias("c"), F.col("shingles").alias("set_c")), "c")
    return with_c.select("c", "m", "set_c", "set_m").mapInArrow(run, "c long, m long, linked boolean, n long, delta array<long>")


def cell_links(around: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one centre, of which at least one is not linked to it: a forest of each cell."""
    sizes = around.groupBy("c").agg(F.count("*").alias("n_all"), F.count_if(~F.col("linked")).alias("n_between")).filter("n_all > 1 and n_between > 0")
    parts = sizes.select("c", F.ceil(F.col("n_all") / CELL).cast("int").alias("p_all"), F.ceil(F.col("n_between") / CELL).cast("int").alias("p_between"))
    placed = around.join(Table(parts, "cell-parts").maybe_broadcast(), "c")
    h = F.xxhash64("m")
    rows = placed.filter("not linked").select("c", F.pmod(h, F.col("p_between")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("p_all") - 1)).alias("j"), F.lit(True).alias("asks"), "m", "linked", "n", "delta")
    cols = placed.select("c", F.explode(F.sequence(F.lit(0), F.col("p_between") - 1)).alias("i"), F.pmod(h, F.col("p_all")).cast("int").alias("j"), F.lit(False).alias("asks"), "m", "linked", "n", "delta")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks, vid, n = (group[x].to_numpy() for x in ("asks", "m", "n"))
        values = group["delta"].combine_chunks()
        off = values.offsets.to_numpy().astype(np.int64)
        flat = values.values.to_numpy()
        size_ = np.diff(off)
        ask, own = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(ask) or not len(own):
            return schema.empty_table()
        element = flat[K.ranges(off[:-1][own], size_[own])]
        owner = np.repeat(own, size_[own])
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        # one label for the centre and all that is linked to it; links lower labels
        label = np.arange(1, len(vid) + 1)
        label[group["linked"].to_numpy()] = 0
        same = np.unique(vid, return_inverse=True)[1]
        edges = []
        for a in range(0, len(ask), 32):
            few = ask[a : a + 32]
            mine = flat[K.ranges(off[:-1][few], size_[few])]
            who = np.repeat(np.arange(len(few)), size_[few])
            lo, hi = np.searchsorted(element, mine, "left"), np.searchsorted(element, mine, "right")
            met = owner[K.ranges(lo, hi - lo)]
            overlap = np.bincount(np.repeat(who, hi - lo) * len(vid) + met, minlength=len(few) * len(vid)).reshape(len(few), len(vid))[:, own]
            apart = size_[few][:, None] + size_[own][None, :] - 2 * overlap
            both2 = n[few][:, None] + n[own][None, :] - apart  # twice the intersection
            x, y = np.nonzero(100 * both2 >= percent * (both2 + 2 * apart))
            edges.append(np.stack([few[x], own[y]]))
        i, j = np.concatenate(edges, axis=1)
        least = np.full(int(same.max()) + 1, len(vid) + 1)
        np.minimum.at(least, same, label)
        i, j = same[i], same[j]
        i, j = i[i != j], j[i != j]
        start = least.copy()
        while True:
            before = least.copy()
            low = np.minimum(least[i], least[j])
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
            if np.array_equal(before, least):
                break
        at = np.flatnonzero(least < start)
        first = np.zeros(int(same.max()) + 1, np.int64)
        first[same] = vid
        root = np.where(least[at] == 0, group["c"][0].as_py(), vid[np.maximum(least[at], 1) - 1])
        return pa.Table.from_arrays([pa.array(root), pa.array(first[at])], schema=schema)

    cells = rows.unionByName(cols).repartition("c", "i", "j")  # else the join's partitioning by c keeps a centre's cells together
    return cells.groupBy("c", "i", "j").applyInArrow(search, "a long, b long")


def far_pairs(rest: DataFrame, vertices: DataFrame, percent: int, crowd: int) -> DataFrame:
    """Pairs (c, m) of members of one bucket that sizes and signatures allow to be linked; `rest` has key, vid, comp (its
    component so far), far, n_rest (members of the key).

    One of a pair is far from the bucket's centre: those between have met each other around it. A tile with more than
    `crowd` pairs a member gives, instead of them, one row (c, null, key, degree): the member that agrees with most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in [*batches, None]:
            t = pa.Table.from_batches([batch]) if batch is not None and len(batch) else None
            if t is not None:
                held = t if held is None else pa.concat_tables([held, t])
            if held is None:
                continue
            tile = np.stack([held[c].to_numpy() for c in ("key", "i", "j")])
            cut = np.append(np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(axis=0))), tile.shape[1])
            whole = len(cut) - 1 if batch is None else len(cut) - 2  # the last tile may go on in the next batch
            if whole <= 0:
                continue
            some = held.slice(0, cut[whole])
            vid, comp, n, part, far = (some[c].to_numpy() for c in ("vid", "comp", "n", "part", "far"))
            sig = np.frombuffer(b"".join(some["sig"].to_pylist()), np.uint8).reshape(-1, BINS)
            found, crowded = [np.zeros((2, 0), np.int64)], []
            for a, b in zip(cut[:whole].tolist(), cut[1 : whole + 1].tolist(), strict=True):
                x, y = tile_pairs(a + np.argsort(n[a:b], kind="stable"), n, part, far, comp, sig, tile[1, a] == tile[2, a], percent)
                if len(x) > crowd * (b - a):
                    degree = np.bincount(np.concatenate([x, y]) - a, minlength=b - a)
                    crowded.append((int(vid[a + np.argmax(degree)]), int(tile[0, a]), int(degree.max())))
                else:
                    found.append(np.stack([np.minimum(vid[x], vid[y]), np.maximum(vid[x], vid[y])]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            held = held.slice(cut[whole])
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none, none], names)
            c, key, degree = zip(*crowded, strict=True) if crowded else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.nulls(len(crowded), pa.int64()), pa.array(key, pa.int64()), pa.array(degree, pa.int64())], names)

    names = ["c", "m", "key", "degree"]
    parts = F.ceil(F.col("n_rest") / FAR_CELL).cast("int")
    rows = rest.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
    rows = rows.select("key", "vid", "comp", "far", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "vid", "comp", F.col("far").cast("int").alias("far"))
    rows = rows.join(vertices.select("vid", F.col("n_shingles").alias("n"), "sig"), "vid").select("key", "i", "j", "part", "vid", "comp", "far", "n", "sig")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "c long, m long, key long, degree long")


def tile_pairs(order: np.ndarray, n: np.ndarray, part: np.ndarray, far: np.ndarray, comp: np.ndarray, sig: np.ndarray, own: bool, percent: int) -> np.ndarray:
    """Positions (x, y) of the members of a tile, given by size, that agree well enough, one of them far, of two
    components; across the tile's two parts, or within the one (own)."""
    size = n[order]
    reach = np.searchsorted(size, size * 100 // percent, side="right")  # larger ones have too few in common
    few = np.maximum(0, reach - np.arange(len(order)) - 1)
    at, out = 0, [np.zeros((2, 0), np.int64)]
    before = K.counts_before(few)
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(before, before[at] + AT_ONCE, side="right")) - 1)
        x = np.repeat(np.arange(at, stop), few[at:stop])
        y = K.ranges(np.arange(at + 1, stop + 1), few[at:stop])
        x, y = order[x], order[y]
        meet = ((far[x] | far[y]) > 0) & (comp[x] != comp[y])
        if not own:
            meet &= part[x] != part[y]
        x, y = x[meet], y[meet]
        same = np.count_nonzero(sig[x] == sig[y], axis=1)
        keep = (same >= LINK_AGREEMENT * BINS) | (np.minimum(n[x], n[y]) < SURE)
        out.append(np.stack([x[keep], y[keep]]))
        at = stop
    return np.concatenate(out, axis=1)


def joined(found: Table | None, links: DataFrame) -> Table:
    """The components `found` (v, root), if any, after further links (c, m)."""
    edges = links.select(F.col("c").alias("a"), F.col("m").alias("b"))
    if found is None:
        return Table(components(edges), "components")
    after = Table(components(found.df.select(F.col("root").alias("a"), F.col("v").alias("b")).unionByName(edges)), "components")
    found.drop()
    return after


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are what [\\x20\\x09-\\x0D] separates, A-Z lower-cased; a document's set is its distinct `size`-word shingles, or
    its whole sequence if shorter. Documents with 100 * intersection >= `percent` * union are linked, and component_id is
    the smallest doc_id that links reach; kept is doc_id = component_id. A null or empty text has no shingles and no
    links. Rows with a repeated doc_id are rows of their own with an equal id; a null doc_id takes part, and a component
    of such rows alone has a null component_id and is kept. An empty table gives no rows; other columns are ignored.
    Shingles are known by 64-bit hashes, equal sets by 128 bits of theirs. Links are found but for a probability of about
    6e-9 at the threshold (what two sets share of their buckets is random) and confirmed on full sets. The largest
    bucket decides nothing about memory: tiles and cells hold a bounded number of members. One text, its words and its
    shingles fit into memory. A `percent` below 75 is refused: the bands and the
    limits for far and unlinked sets hold from there on only.
    """
    if percent < 75:
        raise ValueError(f"percent {percent} is below 75")
    thin = strip_to(docs, doc_id="long", text="string")
    rows = Table(sketches(thin, size), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")]
    vertices = Table(rows.df.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), *firsts).withColumn("vid", F.monotonically_increasing_id()), "vertices")
    documents = Table(rows.df.select("doc_id", "n_shingles", "h1", "h2"), "documents")
    rows.drop()
    keys = vertices.df.select(F.explode("bands").alias("key"), "vid")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = Table(keys.join(shared, "key"), "members")
    weight = Table(members.df.groupBy("vid").agg(F.sum("n").alias("weight")), "weights")
    sets = Table(sets_of(thin, vertices.df.select("vid", "h1", "h2").join(weight.df.select("vid"), "vid", "left_semi"), size), "sets")
    found, splits = None, 0
    groups = members.df.select("key", "vid", F.lit(None).cast("long").alias("given"))
    while True:
        live = Table(groups.join(weight.df, "vid").select("key", "vid", "weight", "given"), "live")
        if live.df.isEmpty():
            break
        # the centre of each bucket, and its other members
        centres = live.df.groupBy("key").agg(F.coalesce(F.max("given"), F.max(F.struct("weight", "vid"))["vid"]).alias("c"))
        stars = Table(live.df.join(centres, "key").filter("vid <> c").select("key", "c", F.col("vid").alias("m")), "stars")
        rel = Table(relations(agreeing(stars.df.select("c", "m").distinct(), vertices.df), sets.df, percent), "relations")
        inner = Table(cell_links(rel.df, percent), "cells")
        found = joined(found, rel.df.filter("linked").select("c", "m").unionByName(inner.df.select(F.col("a").alias("c"), F.col("b").alias("m"))))
        # far members, with those in between
        judged = stars.df.join(rel.df.select("c", "m", "linked"), ["c", "m"], "left").filter("not coalesce(linked, false)")
        judged = judged.select("key", F.col("m").alias("vid"), F.col("linked").isNull().alias("far")).join(found.df.withColumnRenamed("v", "vid"), "vid", "left").withColumn("comp", F.coalesce("root", "vid")).drop("root")
        sizes = judged.groupBy("key").agg(F.max("far").alias("any_far"), F.count("*").alias("n_rest"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("any_far and x < y")
        rest = Table(judged.join(sizes.select("key", "n_rest"), "key"), "rest")
        split = F.col("n_rest") > (SPLIT_FROM if splits < SPLITS else 1 << 62)
        near = Table(far_pairs(rest.df.filter(~split), vertices.df, percent, CROWD if splits < ROUNDS else 1 << 40), "far-pairs")
        direct = Table(relations(near.df.filter("m is not null").select("c", "m").distinct(), sets.df, percent).filter("linked").select("c", "m"), "direct")
        if not direct.df.isEmpty():
            found = joined(found, direct.df)
        crowded = near.df.filter("m is null").groupBy("key").agg(F.max(F.struct("degree", "c"))["c"].alias("given"))
        second = members.df.select(F.col("key").alias("second"), "vid")
        many = rest.df.filter(split).select("key", "vid").join(second, "vid").filter("key <> second")
        many = many.select(F.xxhash64(F.least("key", "second"), F.greatest("key", "second")).alias("key"), "vid").distinct()
        after = Table(rest.df.select("key", "vid").join(crowded, "key").unionByName(many.withColumn("given", F.lit(None).cast("long"))), "groups")
        for t in (live, stars, rel, rest, near, direct, inner):
            t.drop()
        if after.df.isEmpty():
            break
        groups, splits = after.df, splits + 1

    if found is None:
        found = Table(components(members.df.select(F.col("vid").alias("a"), F.col("vid").alias("b")).limit(0)), "components")
    named = vertices.df.select("vid", "low").join(found.df.withColumnRenamed("v", "vid"), "vid")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_linked = found.df.join(lows, "root").select(F.col("v").alias("vid"), "component_id")
    of_vertex = Table(vertices.df.select("vid", "h1", "h2", "low").join(of_linked, "vid", "left").select("h1", "h2", F.coalesce("component_id", "low").alias("component_id")), "labels")
    for t in (vertices, members, weight, sets, found):
        t.drop()
    keyed = documents.df.select("doc_id", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(h)).alias(h) for h in ("h1", "h2")])
    out = keyed.join(of_vertex.maybe_broadcast(), ["h1", "h2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
