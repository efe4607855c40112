"""Tables that change: parts written once, and a manifest that names the live ones.

A change writes new parts under names of its own and then publishes a manifest, one small
file that appears whole; until then readers see the version before. Everything goes through
Spark's own file systems. Parts that neither the newest manifest nor the one before names are removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annotlake.operators.merge import upsert_latest
from annotlake.plans.durable import remove_folder, shared_names

MANIFEST = "slot long, path string, n long, buckets int"
BUCKET = "_bucket"


class Part(NamedTuple):
    slot: int
    path: str
    n: int
    buckets: int = 0


def _versions(spark: SparkSession, folder: str) -> list[int]:
    found = shared_names(spark, f"{folder}/manifest/version=*/part-*")
    return sorted({int(m[1]) for m in (re.search(r"/version=(\d+)/part-", f) for f in found) if m})


def _manifest(spark: SparkSession, folder: str, version: int) -> list[Part]:
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/version={version}").orderBy("slot").collect()
    return [Part(*r) for r in rows]


def live_parts(spark: SparkSession, folder: str, before: int | None = None) -> list[Part]:
    """Parts of the newest version (older than ``before``); none of a table that was never written."""
    known = [v for v in _versions(spark, folder) if before is None or v < before]
    return _manifest(spark, folder, known[-1]) if known else []


def publish(spark: SparkSession, folder: str, version: int, parts: Sequence[Part]) -> None:
    """Make ``parts`` the table's version and remove what the last two versions don't name."""
    spark.createDataFrame([tuple(p) for p in parts], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    old = [v for v in _versions(spark, folder) if v < version]
    named = {p.path.split("/")[0] for p in [*parts, *(_manifest(spark, folder, old[-1]) if old else [])]}
    for path in shared_names(spark, f"{folder}/parts/*"):
        if path.rsplit("/", 1)[1] not in named:
            remove_folder(spark, path)
    for v in old[:-1]:
        remove_folder(spark, f"{folder}/manifest/version={v}")


def read_parts(spark: SparkSession, folder: str, parts: Sequence[Part] | None = None) -> DataFrame:
    parts = live_parts(spark, folder) if parts is None else parts
    if not parts:
        raise ValueError(f"nothing was written to {folder}")
    return spark.read.parquet(*[f"{folder}/parts/{p.path}" for p in parts])


def _write_part(rows: DataFrame, folder: str, version: int, slot: int) -> Part:
    path = f"{version}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/parts/{path}")
    return Part(slot, path, rows.sparkSession.read.parquet(f"{folder}/parts/{path}").count())


def append_reduced(rows: DataFrame, folder: str, version: int, reduce: Callable[[DataFrame], DataFrame]) -> None:
    """Add ``rows`` as ``version``; parts that are not twice as large as all that follow are reduced into one.

    So parts shrink by half at least, and all of them hold at most twice the rows of the
    largest, which has one row a key. A row is rewritten a logarithmic number of times. A
    version that is written again replaces itself: it starts from the version before.
    """
    spark = rows.sparkSession
    parts = live_parts(spark, folder, version)
    new = _write_part(rows, folder, version, parts[-1].slot + 1 if parts else 0)
    if new.n or not parts:
        parts.append(new)
        total, first = new.n, len(parts) - 1
        while first and total * 2 >= parts[first - 1].n:
            first -= 1
            total += parts[first].n
        if first < len(parts) - 1:
            merged = _write_part(reduce(read_parts(spark, folder, parts[first:])), folder, version, parts[first].slot)
            parts[first:] = [merged]
    publish(spark, folder, version, parts)


# ── snapshots in key buckets ────────────────────────────────────────────────


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, folder: str, version: int, keys: Sequence[str], buckets: int) -> list[Part]:
    path = f"{version}-{uuid.uuid4().hex}"
    placed = rows.withColumn(BUCKET, _bucket(keys, buckets))
    placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{folder}/parts/{path}")
    sizes = rows.sparkSession.read.parquet(f"{folder}/parts/{path}").groupBy(BUCKET).count().collect()
    return [Part(r[BUCKET], f"{path}/{BUCKET}={r[BUCKET]}", r["count"], buckets) for r in sizes]


def write_snapshot(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Write a table of one row a key (its keys not null) in ``buckets`` buckets of the keys' hash."""
    spark = rows.sparkSession
    version = max(_versions(spark, folder), default=-1) + 1
    publish(spark, folder, version, _write_buckets(rows, folder, version, keys, buckets))


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return read_parts(spark, folder)


def apply_changes(changes: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str] = ("modified_at", "seq")) -> int:
    """Last write per key of the snapshot and ``changes``; only buckets that a changed key falls into are read and rewritten.

    Returns the number of buckets rewritten. Changed keys reach the driver as bucket numbers, never more than there are buckets.
    """
    spark = changes.sparkSession
    parts = live_parts(spark, folder)
    if not parts:
        raise ValueError(f"nothing was written to {folder}")
    buckets = parts[0].buckets
    fresh = upsert_latest(changes, keys, order)
    touched = {r["b"] for r in fresh.select(_bucket(keys, buckets).alias("b")).distinct().collect()}
    met = [p for p in parts if p.slot in touched]
    rows = fresh if not met else upsert_latest(read_parts(spark, folder, met).unionByName(fresh), keys, order)
    version = _versions(spark, folder)[-1] + 1
    if touched:
        new = _write_buckets(rows, folder, version, keys, buckets)
        publish(spark, folder, version, [*[p for p in parts if p.slot not in touched], *new])
    return len(touched)
