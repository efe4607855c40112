"""Streams of edits and of frames, kept current as few reduced parts.

A micro-batch is reduced to its last write per key and added to the parts under its batch id;
parts of like size are reduced into one, so that a reader meets at most a few rows a key after
any number of batches. A repeated batch replaces what an earlier attempt of it left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annotlake.operators.merge import upsert_latest
from annotlake.sinks.versions import append_reduced, read_parts

EDIT_KEYS = ("frame_id", "field")


def delta_writer(folder: str, keys: Sequence[str], order: Sequence[str]):
    """foreachBatch function writing the last write per key of a batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_reduced(upsert_latest(batch, keys, order), folder, batch_id, lambda rows: upsert_latest(rows, keys, order))

    return write


def stream_latest_edits(
    edits: DataFrame, folder: str, keys: Sequence[str] = EDIT_KEYS, available_now: bool = False
) -> StreamingQuery:
    """Start keeping the latest edit per key; ``edits`` is a streaming DataFrame with modified_at and seq."""
    writer = edits.writeStream.foreachBatch(delta_writer(folder, keys, ("modified_at", "seq"))).option(
        "checkpointLocation", f"{folder}/checkpoint"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_edits(spark: SparkSession, folder: str, keys: Sequence[str] = EDIT_KEYS) -> DataFrame:
    """Current state of a stream started by ``stream_latest_edits``."""
    return upsert_latest(read_parts(spark, folder), keys)


def review_counts(frames: DataFrame) -> DataFrame:
    """Reviewed and total frames per sequence; works on a stream and on a table."""
    return frames.groupBy("sequence_id").agg(
        F.count_if("reviewed").alias("reviewed"), F.count(F.lit(1)).alias("total")
    )


def stream_review_progress(frames: DataFrame, folder: str, available_now: bool = False) -> StreamingQuery:
    """Start keeping review counts per sequence in update mode.

    State is one pair of counters per sequence. There is no event time in the semantics, so
    no watermark: a late frame counts like any other.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("batch_no", F.lit(batch_id).cast("long"))
        append_reduced(stamped, folder, batch_id, _last_counts)

    writer = (
        review_counts(frames)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def review_progress_now(spark: SparkSession, folder: str) -> DataFrame:
    """Last counts written per sequence."""
    return _last_counts(read_parts(spark, folder)).drop("batch_no")


def _last_counts(updates: DataFrame) -> DataFrame:
    return upsert_latest(updates, ["sequence_id"], ["batch_no"])
