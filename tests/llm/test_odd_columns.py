"""Every operator and stage on tables with dotted, clashing and upper-case extra columns."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import items_of, rows, table

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402
from lodestar.llm import decontaminate, divergence, hardneg, langid, linededup, neardup, packing, substring, suffixtree, tokencount, tokenfile, topk, toxicity  # noqa: E402

EXTRA = ["a.b", "TEXT2", "__drop_h", "__drop_id", "drop_h", "drop_id", "__cut", "cut", "cut_id", "__gone", "gone", "c0", "c3", "row", "N_LINES", "kept", "Doc.Id", "key", "value", "n", "info", "rank"]


def odd(df):
    names = [*EXTRA, *df.columns]
    return df.select(*[F.lit(f"x{i}").alias(c) for i, c in enumerate(EXTRA)], *[F.col(c) for c in df.columns]).toDF(*names)


@pytest.fixture(scope="module")
def plain(spark):
    return table(spark, [(d, t, x) for d, t, x in rows() if d is None or d < 117]).select("doc_id", "text", "lang", "source", "n_chars").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


DOCS = {
    "op1": lambda spark, d: decontaminate.digest(decontaminate.contamination(d, odd(spark.createDataFrame(items_of(), "item_id long, text string")))),
    "op2": lambda spark, d: tokencount.token_counts(d),
    "op3": lambda spark, d: packing.pack(d, 1024).groupBy("doc_id").agg(F.sum("length").alias("n")),
    "op4": lambda spark, d: linededup.dedup_lines(d).select("doc_id", "text", "n_lines", "n_dropped"),
    "op5": lambda spark, d: neardup.near_duplicates(d),
    "op6": lambda spark, d: langid.identify(d),
    "op7": lambda spark, d: substring.dedup_substrings(d).select("doc_id", "text", "n_words", "n_removed"),
    "op8": lambda spark, d: tokenfile.round_trip(d),
    "op10": lambda spark, d: toxicity.toxicity(d, odd(spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))),
    "op11": lambda spark, d: divergence.divergence(d, 3),
    "op13": lambda spark, d: suffixtree.language_model(d).select("doc_id", "n_tokens", "n_known", F.round("score", 6).alias("score")),
}


@pytest.mark.parametrize("name", sorted(DOCS))
def test_documents(spark, plain, name):
    same(DOCS[name](spark, plain), DOCS[name](spark, odd(plain)))


def test_embeddings(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, -0.5], i % 3) for i in range(200)], "vec_id long, embedding array<double>, label int")
    same(topk.top_k(v), topk.top_k(odd(v)))
    same(hardneg.hard_negatives(v, relabel_every=7), hardneg.hard_negatives(odd(v), relabel_every=7))


def test_all_columns_are_kept(spark, plain):
    d = odd(plain)
    assert linededup.dedup_lines(d).columns == [c for c in d.columns if c != "N_LINES"] + ["n_lines", "n_dropped"]
    assert substring.dedup_substrings(d).columns == [*d.columns, "n_words", "n_removed"]
    two = plain.toDF("doc_id", "text", "lang", "x", "x")
    assert linededup.dedup_lines(two).count() == plain.count()


def test_pipeline_stages(spark, plain, tmp_path):
    spark.createDataFrame([x for x in items_of() if x[0] is not None], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, b = plain, odd(plain)
    for name, stage in P.STAGES[:-1]:
        a, b = stage(spark, a, str(tmp_path)), stage(spark, b, str(tmp_path))
        assert b.columns == [*EXTRA, *plain.columns]
        for x, k in ((a, "a"), (b, "b")):
            x.write.parquet(str(tmp_path / f"{name}-{k}"))
        a, b = (spark.read.parquet(str(tmp_path / f"{name}-{k}")) for k in "ab")
        same(a.select("doc_id", "text", "n_chars"), b.select("doc_id", "text", "n_chars"))
    assert P.pack(spark, b, str(tmp_path)).count() == P.pack(spark, a, str(tmp_path)).count()


def test_clean_rows_of_a_repeated_doc_id_stay(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    data = [(1, f"before {item} after"), (1, "a clean text of few words"), (2, "another clean text"), (None, item), (3, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(map(str, P.decontamination(spark, docs, str(tmp_path)).collect()))
    assert got == sorted(str(r) for r in docs.collect() if r.text is None or item not in r.text)
    far = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, item), (2, item), (2, far), (3, far), (None, item)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in P.near_dedup(spark, docs, str(tmp_path)).collect()) == sorted([(0, item), (1, item), (2, item), (2, far)])
