"""The bounded sample of labelled documents."""

from annotlake.llm import quality

DOCS = "doc_id long, text string, lang string"


def test_repeated_ids_are_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k % 50}", "en") for k in range(400)] + [(k, "other", "en") for k in range(2, 40)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    sample = quality.training_rows(docs, labels, "quality", quality.FOLD, 100)
    got = [tuple(r) for r in sample.collect()]
    assert len(got) == len({r[0] for r in got}) and any(r[0] == 1 for r in got)
    again = quality.training_rows(docs.repartition(7), labels, "quality", quality.FOLD, 100).collect()
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in again)


def test_filter_without_a_classifier_keeps_all(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en") for k in range(9)], DOCS)
    for labels in ([], [(k, 1) for k in range(9)], [(k, 0) for k in range(9)]):
        kept = quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert kept.columns == docs.columns and kept.count() == 9
