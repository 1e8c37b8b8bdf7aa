"""A line in two documents, one of which has two rows, is not in three documents."""

from lodestar.llm import linededup

LINE = "this line is long enough to count"


def dropped(spark, data):
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_dropped"]) for r in linededup.dedup_lines(frame).collect())


def test_documents_not_rows(spark):
    assert dropped(spark, [(1, LINE), (1, LINE), (2, LINE)]) == [(1, 0), (1, 0), (2, 0)]
    assert dropped(spark, [(1, LINE), (1, LINE), (2, LINE), (3, LINE)]) == [(1, 1), (1, 1), (2, 1), (3, 0)]
    assert dropped(spark, [(None, LINE), (1, LINE), (2, LINE)]) == [(-1, 0), (1, 1), (2, 0)]
