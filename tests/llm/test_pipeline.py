"""Each stage of the pipeline against a brute-force version on its own input."""

import sys
from collections import Counter
from pathlib import Path

import regex
from tests.llm.test_operators import alnum, brute_components, brute_contamination, check_packing, items_of, library, rows, table

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402


def test_stages(spark, tmp_path):
    spark.createDataFrame([x for x in items_of() if x[0] is not None], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark)
    names = docs.columns
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = {d: t for d, t, _ in rows()}
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == names
            now = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert now == {d: t for d, t in kept.items() if t and regex.search(r"\p{L}", t)}
        elif name == "line_dedup":
            assert now.keys() == kept.keys() and sum(now[d] != kept[d] for d in now) > 10
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_dedup":
            want = brute_components(list(kept.items()))
            assert now == {d: t for d, t in kept.items() if want[d][2]}
        elif name == "decontamination":
            hit = {x[0] for x in brute_contamination(list(kept.items()), [x for x in items_of() if x[0] is not None]) if x[2]}
            assert hit and now == {d: t for d, t in kept.items() if d not in hit}
        else:
            ids = library("byte_bpe_50k.json", list(kept.values()))
            check_packing(docs.collect(), {d: [*i, 0] for d, i in zip(kept, ids, strict=True)})
        kept = now


def test_run(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"} == set(got.columns)
    per = Counter(r.sequence_id for r in got.collect())
    assert per and alnum("A b") == ["a", "b"]
