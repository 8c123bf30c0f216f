"""The pipeline's stages, one after the other, on a small table."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_filter_and_pack(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert before * 0.5 < docs.count() <= before, name
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
