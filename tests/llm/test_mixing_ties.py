"""Rows that share a doc_id, or have none, are taken one by one."""

import pytest
from pyspark.sql import functions as F

from annotlake.llm import mixing


@pytest.mark.parametrize("bucket", [4, 4096])
def test_rest_of_rows_without_ids(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "DOCS_PER_BUCKET", bucket)
    rows = [(None, f"a{k} b", "a") for k in range(200)] + [(None, "same text", "b")] * 200 + [(7, "one two", "c")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.planned(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("repeats")).alias("taken"), F.count("*").alias("n")).collect()
    mixed = {r["source"]: r["words"] for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum(F.lit(2)).alias("words")).collect()}
    assert {r["source"]: r["n"] for r in got} == {"a": 200, "b": 200, "c": 100}
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 1 and mixed[r["source"]] == r["taken"]
