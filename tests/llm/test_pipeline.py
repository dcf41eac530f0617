"""The pipeline stage by stage, and what its query promises."""

import corpus_pipeline
from plumbline.llm import jaccard_groups
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in after.select("doc_id").collect()}
            break
        assert after.columns == columns and 0 < after.count() <= count
        if name == "ngram_jaccard_join":
            again = jaccard_groups.near_duplicates(after, 5, 80)
            assert again.where("component_id <> doc_id").count() == 0
        docs, count = after, after.count()


def test_stages_take_empty_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0, name
