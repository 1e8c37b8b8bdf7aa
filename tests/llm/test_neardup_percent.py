"""op5_near_duplicates refuses thresholds that its bands and limits do not hold for."""

import pytest

from lodestar.llm import neardup


def test_percent_below_75_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, percent=60)
    assert neardup.near_duplicates(docs, percent=80).filter("kept").count() == 1
