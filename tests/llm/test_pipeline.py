from __future__ import annotations


def test_stages_keep_columns_and_clean_documents(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for _, stage in p.STAGES[:-1]:
        kept = p.table(spark, small, "documents") if kept is None else stage(spark, kept, small)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    pieces = p.STAGES[-1][1](spark, kept, small)
    assert pieces.agg({"length": "sum"}).first()[0] > 0


def test_run_reruns_agree(spark, small):
    import corpus_pipeline as p

    a, b = (p.run(spark, small).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect() for _ in range(2))
    assert sorted(a) == sorted(b)
