"""The pipeline's stages hand on documents, and its end is a packing of what they kept."""


def test_run(spark):
    import corpus_pipeline as c

    names = [n for n, _ in c.STAGES]
    assert names == ["quality_rules", "language_id", "line_dedup", "near_duplicates", "packing"]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now = d
    for _, stage in c.STAGES[:-1]:
        new = stage(spark, now, "/root/testdata/sf0.001").cache()
        assert new.columns == d.columns and 0 < new.count() <= now.count()
        now = new
    assert c.packed(spark, now, "").select("doc_id").distinct().count() == now.count()
