"""Connected components of an edge table by alternating star contraction.

Each round hangs every neighbourhood on its smallest member, first upwards (large star),
then downwards (small star); Kiveris et al., "Connected Components in MapReduce and Beyond",
2014. The number of rounds grows with the logarithm of the component size, and a vertex with
very many neighbours is handled by a combined minimum and a join that may be split by skew,
never by collecting its neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from annotlake.plans.durable import cut


def star_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, u, root`` for every vertex that is not its component's smallest.

    ``edges``: keys, u, v with vertices that order; keys keep separate graphs apart.
    """
    on = [*keys, "u"]
    cols = [*keys, "u", "v"]
    stars, seen = _written(
        edges.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while seen[0]:
        both = stars.unionByName(stars.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*on).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = (
            both.join(least, on).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy(*on).agg(F.min("v").alias("m"))
        inner = large.join(least, on).where("v > m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select(*keys, "u", F.col("m").alias("v"))
        before = seen
        stars, seen = _written(inner.unionByName(own).select(*cols).distinct())
        if seen == before:
            break
    return stars.withColumnRenamed("v", "root")


def _written(df: DataFrame) -> tuple[DataFrame, tuple]:
    """The rows, cut, with their count and a fingerprint that were taken while they were written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")))
    return out, (seen.get["n"], seen.get["x"])
