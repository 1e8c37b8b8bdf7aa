"""The corpus pipeline: language ID, line dedup, near-duplicates, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) on what its predecessor wrote. All but the last return the columns of
`docs`; a text that changes has its n_chars brought up to date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, langid, linededup, neardup, packing
from lodestar.llm.shared import Table, numbered, place, strip_to

#: SQL cannot express the language model, the bucketed links or the packing; the tests hold each stage against brute force.
ORACLE_SQL = None


def keep_rows(docs: DataFrame, gone: DataFrame, name: str, key: Callable[[Column, Column], Column]) -> DataFrame:
    """`docs` without the rows whose key(doc_id, text) is in the column `gone`; rows with a null key stay."""
    plain, names = numbered(docs)
    ids = Table(gone.filter("gone is not null").distinct(), name)
    own = key(F.col(f"c{place(names, 'doc_id')}").cast("long"), F.col(f"c{place(names, 'text')}").cast("string"))
    return plain.join(ids.maybe_broadcast(), own == F.col("gone"), "left_anti").toDF(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null and empty texts among them; whether anything was learned does not matter.

    The model judges the language of the others, which decides nothing here. Each row is judged alone, so repeated
    doc_ids and equal texts change nothing.
    """
    model = langid.learn(strip_to(docs, doc_id="long", text="string", lang="string").filter(~langid.held_out_column()))
    plain, names = numbered(docs)
    at = f"c{place(names, 'text')}"
    judged = langid.predict(plain.withColumnRenamed(at, "text"), model)
    letter = F.col("text").rlike(r"\p{L}") if not model.langs else F.col("lang_pred") != langid.UND  # as predict() tells it
    return judged.filter(letter).withColumnRenamed("text", at).select(*plain.columns).toDF(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of 20 characters or more that three documents share, but for the largest doc_id; documents stay.

    All rows of a repeated doc_id are one document.
    """
    plain, names = numbered(docs)
    at = {c: f"c{place(names, c)}" for c in ("doc_id", "text")}
    out = linededup.dedup_lines(plain.withColumnsRenamed({v: k for k, v in at.items()})).withColumnsRenamed(at)
    if "n_chars" in names:
        n_chars = f"c{place(names, 'n_chars')}"
        out = out.withColumn(n_chars, F.char_length(at["text"]).cast(plain.schema[n_chars].dataType))
    return out.select(*plain.columns).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the smallest doc_id.

    A repeated doc_id stays with all its rows if any of them stays; rows without doc_id stay.
    """
    judged = neardup.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return keep_rows(docs, judged.filter("not kept").select(F.col("doc_id").alias("gone")), "near-duplicates", lambda doc_id, text: doc_id)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item. Rows are judged by their texts, known by 64-bit
    hashes, so a repeated doc_id keeps its clean rows."""
    by_text = strip_to(docs, text="string").select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontaminate.contamination(by_text, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keep_rows(docs, found.filter("n_hit > 0").select(F.col("doc_id").alias("gone")), "contaminated-texts", lambda doc_id, text: F.xxhash64(text))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return docs
