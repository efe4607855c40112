"""Consecutive positions over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotlake.plans.durable import cut


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """Add ``name`` = position of the row in the total order ``order`` (end it with a unique key).

    Range-partition and sort, cut there so that partition contents are fixed, then add
    each partition's offset. The offsets are one row per partition, so their window and
    broadcast are bounded by the partition count, never by the data.
    """
    row_bits = 33
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    tagged = parts.withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftright("_mid", row_bits)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << row_bits) - 1).cast("long"))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_row") + F.col("_offset") + F.lit(start)).cast("long"))
        .drop("_mid", "_part", "_row", "_offset")
    )


def number_with_neighbours(df: DataFrame, order: Sequence[str | Column], of: str, name: str, start: int = 1) -> DataFrame:
    """Add ``name`` as ``number_rows`` does, and ``previous`` and ``next``: the value of ``of`` (a long) in the rows around.

    After the one range shuffle neighbours stand side by side; only the first and last value of
    each partition are exchanged, a row a partition.
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    near = parts.mapInArrow(_beside(of), f"{kinds}, _part bigint, _row bigint, _before bigint, _after bigint")
    by_part = Window.orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    ends = near.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min_by(of, "_row").alias("_first"), F.max_by(of, "_row").alias("_last"))
    ends = ends.select(
        "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.lag("_last").over(by_part).alias("_left"), F.lead("_first").over(by_part).alias("_right")
    )
    met = near.join(F.broadcast(ends), "_part")
    return met.select(
        *df.columns,
        (F.col("_row") + F.col("_offset") + F.lit(start)).cast("long").alias(name),
        F.when(F.col("_row") == 0, F.col("_left")).otherwise(F.col("_before")).alias("previous"),
        F.when(F.col("_row") == F.col("_n") - 1, F.col("_right")).otherwise(F.col("_after")).alias("next"),
    )


def _beside(of: str):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, task = pa.int64(), TaskContext.get().partitionId()
        row, last, held = 0, pa.array([None], kind), None

        def done(part: pa.RecordBatch, first: pa.Array) -> pa.RecordBatch:
            values, n = part.column(of).cast(kind), part.num_rows
            extra = [
                pa.array(np.full(n, task), kind),
                pa.array(np.arange(row, row + n), kind),
                pa.concat_arrays([last, values.slice(0, n - 1)]),
                pa.concat_arrays([values.slice(1), first]),
            ]
            return pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "_part", "_row", "_before", "_after"])

        for part in parts:
            if not part.num_rows:
                continue
            if held is not None:
                yield done(held, part.column(of).cast(kind).slice(0, 1))
                row, last = row + held.num_rows, held.column(of).cast(kind).slice(held.num_rows - 1)
            held = part
        if held is not None:
            yield done(held, pa.array([None], kind))

    return batches


def number_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str, start: int = 0
) -> DataFrame:
    """Position inside each group, safe for groups of any size.

    Global positions are taken first; a group's rows are consecutive there, so its
    smallest position (a map-side-combined minimum) is all that must be joined back.
    """
    numbered = number_rows(df, [*[F.col(g) for g in groups], *order], "_pos", 0)
    firsts = numbered.groupBy(*groups).agg(F.min("_pos").alias("_first"))
    return (
        numbered.join(firsts, list(groups))
        .withColumn(name, F.col("_pos") - F.col("_first") + F.lit(start))
        .drop("_pos", "_first")
    )
