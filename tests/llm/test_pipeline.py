import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_in_order_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mixture", "tokens"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        before = corpus_pipeline.save(after, f"test-{name}")
        assert before.count() > 0
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count() and "doc_id" in out.columns
