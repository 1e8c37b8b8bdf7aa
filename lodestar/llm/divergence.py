"""How far the sources of a language differ in their terms, exactly, by a heavy-light split of the terms.

Every group (lang, source) gives each kept term a smoothed share p in billionths; a term the group lacks has the group's
blank share. Two groups differ in a term by f = floor((p - q)^2 / (p + q)), and by the sum of f over all kept terms.

A term that a good part of a language's groups hold is heavy: its shares fill numpy tiles, groups by terms, and tiles are
compared row by row. All other terms are light, and for them the sum is put together from what is sparse:

    sum over light terms of f(a, b) =   sum over a's postings of f(p, blank of b)  + the same with b's
                                      + sum over terms of both of f(p, q) - f(p, blank of b) - f(blank of a, q) + f(blanks)
                                      + (light terms - a's - b's) * f(blanks)

(and heavy terms that no group of a tile holds are counted with the last). The first sums need no terms at all, only how many of a group's light terms have each p. All of it is whole numbers, so
partial sums of shards of terms add up to the same result in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import kernel as K
from lodestar.llm.shared import Table, heavy_keys, join_heavy, strip_to

#: A term is heavy if at least one in HEAVY_SHARE of the groups of its language holds it.
HEAVY_SHARE = 4
#: Groups of a block; a cell compares two blocks. Terms of a shard: at least LEAST_TERMS, and TERMS_A_GROUP for each group of a block.
BLOCK, LEAST_TERMS, TERMS_A_GROUP = 256, 256, 16
#: Rows of counts that a task gathers before it hands them on.
GATHERED = 1 << 19
#: Bytes of terms: letters and non-ASCII, after A-Z is lower-cased.
LETTERS = K.table((0x61, 0x7A), (0x80, 0xFF))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
GROUP, HEAVY, LIGHT, BLANKS = range(4)


def block_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> Iterator[pa.Table]:
    """Counts of a batch: occurrences and documents of every term of every group, and a row with term '' for the group."""
    lang, source = (x.fill_null("").dictionary_encode() for x in (lang, source))
    n_sources = len(source.dictionary)
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_sources + source.indices.to_numpy(zero_copy_only=False)

    def rows(g: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.Table:
        return pa.table([lang.dictionary.take(pa.array(g // n_sources)), source.dictionary.take(pa.array(g % n_sources)), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=COUNTS)

    groups = np.unique(group)
    none = np.zeros(len(groups), np.int64)
    yield rows(groups, pa.array([""] * len(groups), pa.string()), none, none)
    for a, _, data, off in K.blocks(text):
        w = K.Words(data, off, LETTERS, lower=True)
        if not len(w.start):
            continue
        size = w.end - w.start
        terms = K.binary_array(w.data[K.ranges(w.start, size)], K.counts_before(size)).dictionary_encode()
        v = len(terms.dictionary)
        pair, n = np.unique(w.doc * v + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
        key = group[a + pair // v] * v + pair % v
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        yield rows(key[first] // v, terms.dictionary.take(pa.array(key[first] % v)), np.add.reduceat(n, first), np.diff(np.append(first, len(key))))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows of `docs` with it); term '' marks that the group occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return pa.table([t[c] for c in ("lang", "source", "term", "n_sum", "docs_sum")], schema=COUNTS)

        for batch in batches:
            held += block_counts(batch.column(0), batch.column(1), batch.column(2))
            if sum(map(len, held)) > GATHERED:
                held = [merged()]
                if len(held[0]) > GATHERED // 2:
                    yield from held.pop().to_batches(1 << 16)
        if held:
            yield from merged().to_batches(1 << 16)

    found = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)) by long division, which never leaves 64 bits; 1 if nothing is kept."""
    a, b = (count + 2).cast("long"), F.greatest((total + 2 * kept).cast("long"), F.lit(1))
    out = F.lit(1).cast("long")
    for unit in (1_000_000, 1000, 1):
        out = out + F.call_function("div", a * 1000, b) * unit
        a = (a * 1000) % b
    return F.when(kept > 0, out).otherwise(1)


def is_heavy() -> Column:
    return F.col("holders") * HEAVY_SHARE >= F.col("n_groups")


def differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def cell_sums(kind: np.ndarray, source: np.ndarray, own: np.ndarray, term: np.ndarray, p: np.ndarray, weight: np.ndarray, terms: np.ndarray, blocks: tuple[int, int], first_shard: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, value) for the pairs of groups of a cell; `source` numbers the groups in their order, 0 to n - 1.

    A GROUP row has the group's blank share p, `weight` light terms and `terms` terms of the language; HEAVY and
    LIGHT rows are postings; a BLANKS row says that `weight` light terms of the group have the share p.
    """
    n = int(source.max()) + 1
    blank, light, side = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = kind == GROUP
    blank[source[at]], light[source[at]], side[source[at]] = p[at], weight[at], own[at]
    a, b = np.flatnonzero(side == blocks[0]), np.flatnonzero(side == blocks[1])
    total = np.zeros((n, n), np.int64)  # [i, j] and [j, i] are parts of one pair
    at = kind == HEAVY
    tiled = 0
    if at.any():
        names, t = np.unique(term[at], return_inverse=True)
        tile = np.repeat(blank[:, None], len(names), axis=1)
        tile[source[at], t] = p[at]
        tiled = len(names)
        for i in a.tolist():
            others = b[b > i] if blocks[0] == blocks[1] else b
            total[i, others] += f(tile[i][None, :], tile[others]).sum(axis=1)
    at = np.flatnonzero(kind == BLANKS)
    at = at[np.argsort(source[at], kind="stable")]
    edge = np.searchsorted(source[at], np.arange(n + 1))
    for i in np.unique(source[at]).tolist():
        mine = at[edge[i] : edge[i + 1]]
        for s in range(0, len(mine), 4096):
            part = mine[s : s + 4096]
            total[i] += (weight[part][:, None] * f(p[part][:, None], blank[None, :])).sum(axis=0)
    at = np.flatnonzero(kind == LIGHT)
    if len(at):
        t = np.unique(term[at], return_inverse=True)[1]
        order = np.lexsort((source[at], t))
        t, i, x = t[order], source[at][order], p[at][order]
        d = 1
        while d < len(t) and (same := np.flatnonzero(t[d:] == t[:-d])).size:
            s, e = same, same + d
            if blocks[0] != blocks[1]:
                across = side[i[s]] != side[i[e]]
                s, e = s[across], e[across]
            u, v = i[s], i[e]
            np.add.at(total, (u, v), f(x[s], x[e]) - f(x[s], blank[v]) - f(blank[u], x[e]) + f(blank[u], blank[v]))
            d += 1
    i, j = np.meshgrid(a, b, indexing="ij")
    i, j = i.ravel(), j.ravel()
    if blocks[0] == blocks[1]:
        i, j = i[i < j], j[i < j]
    value = total[i, j] + total[j, i]
    # terms that neither group has: all of them once, without those of the tiles and the postings
    blanks = f(blank[i], blank[j])
    if first_shard and len(i):
        value += (int(terms[kind == GROUP][0]) - light[i] - light[j]) * blanks
    value -= tiled * blanks
    return i, j, value


def pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value: the sums of f over all kept terms of every two sources of a language."""
    n_blocks, shards = F.ceil(F.col("n_groups") / BLOCK), F.greatest(F.lit(1), F.ceil(F.col("kept") / F.greatest(F.lit(LEAST_TERMS), TERMS_A_GROUP * F.least(F.col("n_groups"), F.lit(BLOCK)))))
    own = F.pmod(F.xxhash64("source"), n_blocks)
    light = postings.filter("not heavy")
    per_group = light.groupBy("lang", "source").agg(F.count("*").alias("light"))
    g = groups.join(per_group, ["lang", "source"], "left")
    columns = ("lang", "own", "n_blocks", "shard", "kind", "source", "term", "p", "weight", "terms")

    def shaped(df: DataFrame, kind: int, shard: Column, term: Column, p: str, weight: Column, terms: Column) -> DataFrame:
        return df.select("lang", own.alias("own"), n_blocks.alias("n_blocks"), shard.alias("shard"), F.lit(kind).alias("kind"), "source", term.alias("term"), F.col(p).alias("p"), weight.alias("weight"), terms.alias("terms")).select(*columns)

    zero, no_term, by_term = F.lit(0).cast("long"), F.lit(""), F.pmod(F.xxhash64("term"), shards)
    blanks = light.groupBy("lang", "source", "p", "n_groups", "kept").agg(F.count("*").alias("of"))
    rows = shaped(g, GROUP, F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)), no_term, "blank", F.coalesce("light", zero), F.col("kept"))
    rows = rows.unionByName(shaped(postings.filter("heavy"), HEAVY, by_term, F.col("term"), "p", zero, zero))
    rows = rows.unionByName(shaped(light.filter("holders > 1"), LIGHT, by_term, F.col("term"), "p", zero, zero))
    rows = rows.unionByName(shaped(blanks, BLANKS, F.pmod(F.xxhash64("source", "p"), shards), no_term, "p", F.col("of"), zero))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("x"), F.greatest(x, F.col("own")).alias("y")))
    cells = rows.withColumn("cell", F.explode(met)).select("lang", "cell.x", "cell.y", *columns[3:], "own")
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def cell(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lang, x, y, shard = (k.as_py() for k in key)
        t = t.combine_chunks()
        c = {name: t[name].to_numpy() for name in ("kind", "own", "p", "weight", "terms")}
        names = sorted(set(t["source"].to_pylist()))  # code points ascend as UTF-8 does
        source = pa.compute.index_in(t["source"], pa.array(names, pa.string())).to_numpy()
        term = t["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        i, j, value = cell_sums(c["kind"], source.astype(np.int64), c["own"], term, c["p"], c["weight"], c["terms"], (x, y), shard == 0)
        name = pa.array(names, pa.string())
        u, v = np.minimum(i, j), np.maximum(i, j)
        return pa.table([pa.array([lang] * len(i), pa.string()), name.take(pa.array(u)), name.take(pa.array(v)), pa.array(value, pa.int64())], schema=schema)

    sums = cells.groupBy("lang", "x", "y", "shard").applyInArrow(cell, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language of `docs` (text, lang, source) differ.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps the terms of at least
    `least_docs` of its rows. Part `pair` has every other source of the language with the sum of f over all kept terms,
    all ranks; part `term` the `top` kept terms that the source has more of than the language, by f against the language.
    Ranks go by value, then by item in UTF-8 order. Null text, lang and source count as ''; an empty or null text has no
    terms, but its group occurs; repeated rows count each; the only source of a language has no pairs; an empty table
    gives no rows; other columns are ignored. A text of any length is read in one block.
    """
    thin = strip_to(docs, lang="string", source="string", text="string")
    counts = Table(term_counts(thin), "term-counts")
    some = counts.df.filter("term <> ''")
    kept = Table(some.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("holders")).filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    own = Table(some.drop("docs").join(kept.maybe_broadcast(), ["lang", "term"]), "kept-counts")
    per_group = Table(own.df.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms")), "group-totals")
    langs = kept.df.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    occurring = counts.df.filter("term = ''").select("lang", "source")
    sizes = Table(occurring.groupBy("lang").agg(F.count("*").alias("n_groups")).join(langs, "lang", "left"), "languages")
    zero = F.lit(0).cast("long")
    groups = occurring.join(per_group.maybe_broadcast(), ["lang", "source"], "left").join(sizes.maybe_broadcast(), "lang")
    groups = groups.select("lang", "source", "n_groups", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "kept", "lang_total")])
    groups = Table(groups.withColumn("blank", share(zero, F.col("total"), F.col("kept"))), "groups")
    if groups.bytes <= 4 << 20:
        marked = own.df.join(F.broadcast(groups.df), ["lang", "source"])
    else:
        marked = join_heavy(own.df, groups.df, ["lang", "source"], heavy_keys(per_group.df, ["lang", "source"], "terms"), "term")
    marked = marked.select("lang", "source", "term", "holders", "n_groups", "kept", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), is_heavy().alias("heavy"))
    postings = Table(marked, "postings")
    pairs = pair_sums(postings.df, groups.df)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    more = postings.df.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return both.withColumn("rank", F.row_number().over(order)).unionByName(best)
