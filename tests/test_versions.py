"""Tables in parts: what a change rewrites, what a reader meets, and what repeated batches leave."""

import random

import pytest
from pyspark.sql import functions as F

from annotlake.operators.merge import upsert_latest
from annotlake.plans.durable import shared_names
from annotlake.sinks import versions as V
from annotlake.streaming import edits as S

KIND = "seq long, modified_at long, frame_id long, field string, value double"


def edits(spark, seqs, keys=40):
    rng = random.Random(seqs[0])
    return spark.createDataFrame([(s, s // 3, rng.randrange(keys), rng.choice("ab"), s / 2) for s in seqs], KIND).coalesce(1)


def rows(df):
    return sorted(tuple(r) for r in df.select("frame_id", "field", "modified_at", "seq", "value").collect())


def test_batches_are_compacted_and_repeat_safely(spark, tmp_path):
    folder, write = f"file://{tmp_path}", None
    write = S.delta_writer(folder, S.EDIT_KEYS, ("modified_at", "seq"))
    batches = [edits(spark, range(k * 30, k * 30 + 30)) for k in range(9)]
    whole = None
    for k, batch in enumerate(batches):
        write(batch, k)
        if k in (0, 4, 5):
            write(batch, k)  # an attempt that failed after it had written
        whole = batch if whole is None else whole.unionByName(batch)
    assert rows(S.latest_edits(spark, folder)) == rows(upsert_latest(whole, S.EDIT_KEYS))
    parts = V.live_parts(spark, folder)
    keys = len(rows(upsert_latest(whole, S.EDIT_KEYS)))
    assert sum(p.n for p in parts) <= 2 * keys and len(parts) <= 7
    assert all(a.n > 2 * sum(p.n for p in parts[i + 1 :]) for i, a in enumerate(parts[:-1]))
    assert len(shared_names(spark, f"{folder}/manifest/version=*")) == 2
    write(batches[0].where("false"), 9)
    assert V.live_parts(spark, folder) == parts


def test_a_small_change_rewrites_few_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}"
    base = spark.range(5000).selectExpr("id as seq", "1L as modified_at", "id as frame_id", "'a' as field", "0.0D as value")
    V.write_snapshot(base, folder, S.EDIT_KEYS, 64)
    before = {p.slot: p.path for p in V.live_parts(spark, folder)}
    changes = spark.createDataFrame([(9000 + k, 2, 37 * k, "a", 1.0) for k in range(9)] + [(1, 0, 4, "a", 5.0)], KIND)
    touched = V.apply_changes(changes, folder, S.EDIT_KEYS)
    after = {p.slot: p.path for p in V.live_parts(spark, folder)}
    assert touched <= 10 and sum(before[s] != after[s] for s in before) == touched
    assert rows(V.read_snapshot(spark, folder)) == rows(upsert_latest(base.unionByName(changes), S.EDIT_KEYS))
    new = spark.createDataFrame([(1, 1, 10**6, "b", 1.0)], KIND)
    assert V.apply_changes(new, folder, S.EDIT_KEYS) == 1 and V.read_snapshot(spark, folder).count() == 5001
    assert V.apply_changes(new.where(F.lit(False)), folder, S.EDIT_KEYS) == 0


def test_nothing_written(spark, tmp_path):
    with pytest.raises(ValueError):
        V.read_snapshot(spark, f"file://{tmp_path}")
