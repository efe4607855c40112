"""The registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest
from brute import contaminated, near_duplicates

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", ["op4_source_mixing", "op5_near_duplicates", "op6_chat_perspectives"])
def test_against_sql(spark, name):
    from check import compare

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    why, _ = compare(spark, SF, con, name, entry.queries()[name], entry.oracle_sql()[name])
    assert why is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, labels = dict(texts(spark)), {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, SF)
        kept.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    good, single, clean, private, mixed = kept
    assert all(good[i] == rows[i] for i in good)
    known = [i for i in labels if i in rows]
    assert sum((i in good) == bool(labels[i]) for i in known) >= 0.97 * len(known)
    found = near_duplicates(sorted(good.items()), 80)
    assert set(single) == {i for i, (_, c) in found.items() if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == set(single) - {i for i, _ in contaminated(sorted(single.items()), items)}
    assert set(private) == set(clean) and sum(private[i] != clean[i] for i in clean) > 0
    assert set(mixed) <= set(private) and all(mixed[i] == private[i] for i in mixed)
    run = corpus_pipeline.run(spark, SF)
    assert run.count() == docs.count() and run.columns == [*corpus_pipeline.COLUMNS, "epoch"]
