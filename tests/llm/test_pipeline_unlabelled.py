"""The language stage of the pipeline on a table without any lang."""

import pytest

import corpus_pipeline as P

TEXTS = {1: "Plain words.", 2: "123 !", 3: "", 4: None, 5: "中文", 6: "7 é", 7: "12\n\nx"}


@pytest.mark.parametrize("lang", [None, "en"])
def test_unlabelled_corpus_keeps_texts_with_letters(spark, lang):
    docs = spark.createDataFrame([(d, t, lang) for d, t in TEXTS.items()], "doc_id long, text string, lang string")
    got = P.language_id(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == {d: TEXTS[d] for d in (1, 5, 6, 7)}
