"""The stages on the small tables: each keeps the columns, does its part, and leaves clean documents."""

import corpus_pipeline
from moodspark.llm import decontamination, line_dedup, ngram_join
from moodspark.plans.session import cut_lineage


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, cut_lineage(stage(spark, rows, small))
        assert rows.columns == columns
        assert rows.count() <= before.count()
        assert rows.join(before, "doc_id", "left_anti").count() == 0
    assert decontamination.find_contaminated(rows, spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0
    assert ngram_join.near_duplicates(rows).where("doc_id <> class_id").count() == 0
    assert line_dedup.repeated_lines(rows).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, small)
    assert packed.select("doc_id").distinct().count() == rows.count()


def test_good_documents_stay(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.good_documents(spark, docs, small).join(labels, "doc_id").toPandas()
    assert (kept["quality"] == 1).mean() > 0.97
    assert kept["quality"].sum() > 0.97 * labels.join(docs, "doc_id").toPandas()["quality"].sum()
