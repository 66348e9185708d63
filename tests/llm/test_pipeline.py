"""The corpus pipeline against its stages done by hand."""

from collections import defaultdict

import corpus_pipeline
from causalspark.llm import quality
from tests.llm.test_dedup import brute_components, slow_fingerprint
from tests.llm.test_text import brute_hits, slow_pieces

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    by_text = defaultdict(list)
    for d, t in rows:
        by_text[t or ""].append(d)
    rows = [(d, t) for d, t in rows if d == max(by_text[t or ""])]
    fps = [(d, slow_fingerprint(t or "")) for d, t in rows]
    rows = [(d, t) for (d, t), c in zip(rows, brute_components(fps), strict=True) if d == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, *_, bad in brute_hits(rows, items) if not bad}
    want = {d: slow_pieces(t or "") for d, t in rows if d in clean}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert want and got == want
