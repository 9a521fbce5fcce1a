"""Columns of callers that are named as operators name theirs, through each stage of the pipeline."""

from pyspark.sql import functions as F

NAMES = ["__id", "__hot", "_mark", "size", "copy", "copies", "score", "predicted", "n_lines", "id", "hot", "row", "again", "target", "mark"]


def test_stages_keep_columns_of_callers(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 14)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"a text of number {i}\ncommon line", "en", f"s{i % 3}", 9, *[f"{n} {i}" for n in NAMES]) for i in range(14)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in NAMES] == [f"{n} {r.doc_id}" for n in NAMES]
    once = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert once.groupBy("doc_id").count().filter(F.col("count") > 1).count() == 0
