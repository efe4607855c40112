"""Partitioning by row count where rows are about to be multiplied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Set for a session's larger tables; the session's own number of shuffle partitions is the least.
WANTED = "annotlake.shuffle.partitions"
# What Spark's own shuffles (joins, groups, range sorts) begin with before adaptive execution joins small partitions.
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions for tables of the size that ``size_for`` was told last."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(WANTED, "1")))


def size_for(spark: SparkSession, folder: str, each: int = 4 << 20) -> None:
    """Let ``spread`` use, and other shuffles begin with, a partition for every ``each`` bytes of the files of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    spark.conf.set(WANTED, str(-(-size // each)))
    spark.conf.set(INITIAL, str(partitions(spark)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all shuffle partitions and keep it so.

    Adaptive coalescing sizes partitions by their bytes, which says little when each small
    row (a shape, a curve) becomes thousands, or when sorted runs shrink to a few bytes each in
    the shuffle; a fixed number of partitions is left alone.
    """
    return df.repartition(partitions(df.sparkSession), *keys)


def join_shares(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with a short lookup table whose keys may each name a large share of the rows, as labels do.

    A key's rows are dealt by the hash of their plain columns over as many shares as there are
    shuffle partitions, and the lookup holds its rows once for each, so no task reads all rows of one key.
    """
    shares = partitions(rows.sparkSession)
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct"))]
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(*plain), F.lit(shares)).cast("int"))
    repeated = lookup.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.join(repeated, [key, "_share"], how).drop("_share")
