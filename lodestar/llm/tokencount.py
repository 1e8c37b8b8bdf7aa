"""Token counts of whole texts by a public tokenizer: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel as K
from lodestar.llm.shared import strip_to
from lodestar.llm.tokens import encoder


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens.

    `tokenizer` is the path of a tokenizer file. No begin, end or added special tokens; a special token's string inside
    a text counts as the library's default has it. A null text is empty: 0 bytes, 0 tokens. Repeated rows each give a
    row, a null doc_id stays null, an empty table gives no rows, other columns are ignored. Texts are taken in batches
    of about kernel.BLOCK_BYTES and long ones are cut at safe boundaries, so memory follows the block, not the corpus;
    nothing is shuffled.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            _, off = K.string_buffers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(own.counts(b.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

    return strip_to(docs, doc_id="long", text="string").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def with_limit(counts: DataFrame, limit: int = 2048) -> DataFrame:
    """Adds over_limit: more than `limit` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
