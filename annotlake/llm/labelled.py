"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.llm.common import body


def remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo ``divisor``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)).cast("int")


def known_labels(labels: DataFrame, target: str, fold: tuple[int, int]) -> DataFrame:
    """``doc_id, y`` outside the held-out fold, one row a document; where labels disagree the smaller one."""
    known = labels.where(F.col(target).isin(0, 1) & (remainder(fold[0]) != fold[1]))
    return known.groupBy("doc_id").agg(F.min(target).cast("int").alias("y"))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, fold: tuple[int, int], per_class: int) -> DataFrame:
    """``doc_id, y, body, lang`` of at most ``per_class`` documents of each label, outside the held-out fold.

    ``fold`` is (divisor, held-out remainder). Rows are taken in the order of a hash of the
    doc_id, so reruns agree. A document whose labels disagree takes the smaller one; of rows
    that share a doc_id the one with the smallest hash of its text is taken.
    """
    known = known_labels(labels, target, fold)
    present = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    known = known.join(present, F.col("doc_id") == F.col("_id"), "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(known.where("y = 1").orderBy(*order).limit(per_class))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select("doc_id", body(), lang.alias("lang")).join(F.broadcast(picked), "doc_id")
    one = F.min_by(F.struct("y", "body", "lang"), F.struct(F.xxhash64("body"), F.col("lang")))
    return found.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.y", "r.body", "r.lang")
