"""Row sweep: every set operation on runs as one running sum over run ends.

A run adds its measures at ``x0`` and takes them away at ``x1``. Ends are dealt by their row
once, to partitions whose number follows the input; there ends at the same pixel are summed, so
one row group never holds more than ``width + 1`` rows however many runs were laid over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotlake.plans.spread import spread


def run_ends(runs: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """``keys, y, x`` and the signed measures, two rows per run."""
    carried = [F.col(k) for k in keys] + [F.col("y")]
    values = [c.cast("long").alias(m) for m, c in measures.items()]
    ends = F.explode(
        F.array(
            F.struct(F.col("x0").cast("long").alias("x"), F.lit(1).alias("sign")),
            F.struct(F.col("x1").cast("long").alias("x"), F.lit(-1).alias("sign")),
        )
    ).alias("end")
    split = runs.where(F.col("x1") > F.col("x0")).select(*carried, *values, ends)
    return split.select(
        *[F.col(k) for k in keys],
        F.col("y").cast("long").alias("y"),
        F.col("end.x").alias("x"),
        *[(F.col(m) * F.col("end.sign")).alias(m) for m in measures],
    )


def sweep(
    ends: DataFrame, keys: Sequence[str], measures: Sequence[str], state: Column, out: str = "value"
) -> DataFrame:
    """Maximal runs of equal non-null ``state``, an expression over the running measures."""
    points = spread(ends, *keys, "y").groupBy(*keys, "y", "x").agg(*[F.sum(m).alias(m) for m in measures])
    row = Window.partitionBy(*keys, "y").orderBy("x")
    upto = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = points.select(*keys, "y", "x", *[F.sum(m).over(upto).alias(m) for m in measures])
    stated = running.select(*keys, "y", "x", state.alias("_state"))
    turns = stated.withColumn("_before", F.lag("_state").over(row)).where(
        ~F.col("_state").eqNullSafe(F.col("_before"))
    )
    return (
        turns.withColumn("x1", F.lead("x").over(row))
        .where(F.col("_state").isNotNull())
        .select(*keys, F.col("_state").alias(out), "y", F.col("x").alias("x0"), "x1")
    )
