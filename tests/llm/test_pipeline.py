"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline
from tidemark.llm.common import spill, table

from . import brute


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = spill(stage(spark, before, sf_dir), f"test-{name}")
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "tokens":
            assert after.count() == before.count() and after.where("not exact").count() == 0
            break
        assert after.columns == columns
        kept = {r.doc_id for r in after.collect()}
        if name == "quality":
            labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
            good = [d for d, _ in rows if labels.get(d) == 1]
            assert sum(d in kept for d in good) >= 0.9 * len(good)
        elif name == "exact_duplicates":
            assert kept == {r[0] for r in brute.exact(rows) if r[3]}
        elif name == "near_duplicates":
            assert kept == {r[2] for r in brute.components(rows, 5, 80)}
        elif name == "benchmark_leaks":
            items = [" ".join(r.text.split()) for r in table(spark, sf_dir, "benchmark").collect()]
            for d, t in rows:
                if any(i in " ".join(t.split()) for i in items):
                    assert d not in kept
        before = after


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "text_sha256", "exact"]
    assert 0 < out.count() < table(spark, sf_dir, "documents").count()
