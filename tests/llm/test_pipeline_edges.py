"""The stages of the pipeline on odd tables."""

import pytest

import corpus_pipeline as pipeline

COLUMNS = "doc_id long, text string, source string, lang string, n_chars long, kept boolean, component_id int, rate double"
LONG = "the quick brown fox jumps over the lazy dog and runs far away from here today"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, "what is the name of the river that flows through the old town")], "item_id long, text string").write.parquet(f"{made}/benchmark.parquet")
    return str(made)


def test_empty_table(spark, folder):
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], COLUMNS), folder).count() == 0


def test_odd_rows(spark, folder):
    texts = [(1, LONG), (1, LONG), (1, "another text of more than five words stands here instead"), (None, LONG), (None, LONG), (2, LONG + " again"), (3, None), (4, ""), (5, "some words that nobody else has written down before now")]
    docs = spark.createDataFrame([(i, t, None, None, 0, False, 1, 2.0) for i, t in texts], COLUMNS)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.count()
    kept = pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert sorted(str(r["text"])[:7] for r in kept) == sorted(["the qui", "another", "None", "", "some wo"])
    assert pipeline.STAGES[-1][1](spark, docs, folder).count() == len(texts)
    plain = docs.where("doc_id in (2, 5)")
    assert sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, plain, folder).collect()) == [2, 5]
