"""Interval joins with an equality key: cut the x axis into cells, meet in one cell only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 64


def cell_of(x: Column, size: int = CELL) -> Column:
    return F.floor(x / F.lit(size))


def with_cells(df: DataFrame, low: Column, high: Column, size: int = CELL, name: str = "cell") -> DataFrame:
    """One row per cell the inclusive range ``low..high`` touches."""
    return df.withColumn(name, F.explode(F.sequence(cell_of(low, size), cell_of(high, size))))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    size: int = CELL,
    how: str = "inner",
) -> DataFrame:
    """Pairs whose inclusive integer ranges meet, each pair once.

    A pair meets in every cell both touch; it is kept only in the cell holding the larger
    of the two lower ends. Inside one cell disjoint runs are at most ``size`` per side, so
    the number of candidate pairs stays proportional to the number of cells.
    """
    ll, lh = left_range
    rl, rh = right_range
    a = with_cells(left, F.col(ll), F.col(lh), size)
    b = with_cells(right, F.col(rl), F.col(rh), size)
    joined = a.join(b, [*on, "cell"], how)
    meets = (
        (F.col(ll) <= F.col(rh))
        & (F.col(rl) <= F.col(lh))
        & (F.col("cell") == cell_of(F.greatest(F.col(ll), F.col(rl)), size))
    )
    return joined.where(meets).drop("cell")
