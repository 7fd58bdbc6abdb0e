"""The pipeline over the smallest tables: stages keep columns, decide as their operators do, and pack all."""

import os

import corpus_pipeline
from piiloom.llm import neardup

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_filter_and_last_packs_the_rest(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= set(before), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "exact dedup":
            best = {}
            for i, t in before.items():
                best[t.lower() if t.isascii() else t] = max(i, best.get(t.lower() if t.isascii() else t, i))
            assert after <= set(best.values())
        if name == "MinHash near-dedup":
            sets = neardup.shingle_sets([t.encode() for t in before.values()], 5)
            hashed = dict(zip(before, ({*s.tolist()} for s in sets), strict=True))
            alike = [(a, b) for a in after for b in after if a < b
                     and 100 * len(hashed[a] & hashed[b]) >= 80 * len(hashed[a] | hashed[b])]
            assert not alike
        kept = after if name != corpus_pipeline.STAGES[-1][0] else kept
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == kept
