"""The pipeline's stages, each on its predecessor's rows."""

import corpus_pipeline
from lodestar.llm.shared import written


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "repeated passages", "benchmark leaks", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    done = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in done.collect()} == ids


def test_odd_rows(spark, small, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            done = written(stage(spark, docs, small), "test")
            assert done.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()
