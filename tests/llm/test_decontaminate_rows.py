"""Decontamination judges rows, not ids."""

from annotlake.llm import decontamination


def test_rows_without_or_with_repeated_ids(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(None, f"so {item} it"), (None, "clean text"), (1, item), (1, "other clean text"), (2, None), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    want = [r for r in rows if not (r[1] and item in r[1])]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
