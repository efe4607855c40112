"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotlake.llm.common import packed, sized_broadcast, words_in
from annotlake.plans.durable import cut
from annotlake.plans.numbering import number_rows

DOCS_PER_BUCKET = 4096


def source_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Add ``target`` to a table of ``source, source_size, weight`` (one row a source, weights above 0).

    The targets share the sum of all sizes by weight. A source whose share exceeds
    ``max_epochs`` times its size is clamped there and the excess goes to the others by
    weight, until no share is above its clamp. Each round is one aggregate over the sources
    and clamps at least one of them; only its two sums reach the driver.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    exact = lambda c: c.cast("decimal(38,0)")
    level = None
    clamped = F.lit(False)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        row = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)).alias("held"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("weights"),
        ).first()
        left, weights = total - row["held"], row["weights"]
        if weights is None or (left, weights) == level:
            break
        level = (left, weights)
        clamped = exact(cap) * F.lit(weights).cast("decimal(18,0)") < exact(F.col("weight")).cast("decimal(18,0)") * F.lit(left).cast("decimal(20,0)")
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    share = (F.col("weight") * F.lit(level[0])).cast("double") / F.lit(level[1]).cast("double")
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Add ``weight`` 1, 2, .. ``cycle``, repeating over the sources by code point with null last."""
    placed = number_rows(sources, [F.col("source").asc_nulls_last()], "_place", 0)
    return placed.withColumn("weight", F.col("_place") % F.lit(cycle) + F.lit(1)).drop("_place")


def seeded_order(seed: str) -> Column:
    """The place of a document in its source's seeded order, as text; documents with one doc_id, or none, follow a hash of the text."""
    ids = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return F.concat(ids, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _ends(placed: DataFrame, skipped: int) -> DataFrame:
    """``_source, end, before``: the bucket in which each source's ``rest`` ends, and the size in front of it.

    ``placed`` has source, size, place, rest, start (size in front of its rows) and docs (their
    number); buckets are named by the ``skipped`` first digits of the place and as many more
    as make about ``DOCS_PER_BUCKET`` rows each.
    """
    digits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("docs") / F.lit(DOCS_PER_BUCKET))) / F.lit(4)).cast("int")
    buckets = placed.groupBy("source", "rest", "start", F.substr("place", F.lit(1), digits + F.lit(skipped)).alias("bucket")).agg(
        F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")
    )
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return cut(
        buckets.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).select(
            F.col("source").alias("_source"), F.col("bucket").alias("end"), "before", F.col("docs").alias("_docs")
        )
    )


def source_plan(sized: DataFrame, max_epochs: int = 3, cycle: int = 3) -> DataFrame:
    """``source, source_size, target, whole, last, some`` from a written table of ``source, size, place``.

    A source with target t and size s gives every document ``whole = floor(t / s)`` passes.
    The rest of the target is met by one more pass over documents in the order of ``place``
    before ``last`` and ``some`` of those at it, which brings the source nearest to its target. Documents in that order
    are split into buckets by leading digits of the place, and the bucket in which
    the rest ends by digits of the text's hash; only the places of the last one are ordered, with
    rows of one place counted, so no source and no repeated id is held in one task.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    targets = source_targets(cyclic_weights(sources, cycle), max_epochs)
    passes = F.when(F.col("target") >= F.col("source_size") * F.lit(max_epochs), F.lit(max_epochs)).otherwise(
        F.floor(F.col("target") / F.col("source_size"))
    )
    targets = targets.withColumn("whole", F.coalesce(passes, F.lit(0)).cast("int"))
    targets = cut(
        targets.select(
            F.col("source").alias("_source"),
            "source_size",
            "target",
            "whole",
            F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
            "_docs",
        )
    )
    same = F.col("source").eqNullSafe(F.col("_source"))
    lines = targets.select("_source", "rest", F.lit(0).cast("long").alias("start"), F.col("_docs").alias("docs"))
    placed = sized.join(sized_broadcast(lines), same).drop("_source")
    for skipped in (0, 32):
        ends = _ends(placed, skipped)
        inside = ends.select("_source", "end", "before", F.col("_docs").alias("_in"))
        placed = placed.join(sized_broadcast(inside), same & F.col("place").startswith(F.col("end")))
        placed = placed.select("source", "size", "place", "rest", F.col("before").alias("start"), F.col("_in").alias("docs"))
    running = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    one, left = F.col("size"), F.col("rest") - F.col("sum")
    fit = F.when(one > 0, F.least(F.col("m"), F.floor((left * F.lit(2) + one) / (one * F.lit(2))))).otherwise(F.col("m"))
    last = (
        placed.groupBy("source", "place", "size", "rest", "start")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("sum", F.coalesce(F.sum(one * F.col("m")).over(running), F.lit(0)) + F.col("start"))
        .where("sum < rest")
        .groupBy(F.col("source").alias("_of"))
        .agg(F.max(F.struct("place", fit.cast("long").alias("some"), "m")).alias("last"))
    )
    return cut(
        targets.join(last, F.col("_source").eqNullSafe(F.col("_of")), "left").select(
            F.col("_source").alias("source"), "source_size", "target", "whole", "last.place", "last.some", F.col("last.m").alias("tied")
        ).withColumnRenamed("place", "last")
    )


def _numbered(tied: DataFrame) -> DataFrame:
    """Add ``_number`` from 1 to the rows of each source; a task orders no more than one input partition."""
    rows = cut(tied.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = cut(parts.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")))
    met = rows.join(sized_broadcast(parts), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    number = F.row_number().over(Window.partitionBy("source", "_part").orderBy("_row")) + F.col("_offset")
    return met.withColumn("_number", number).drop("_part", "_row", "_s", "_p", "_offset")


def _with_repeats(rows: DataFrame, plan: DataFrame, place: Column) -> DataFrame:
    """Add ``_plan`` (a line of the plan) and ``_repeats``. Rows that tie where the rest ends are counted off, so they alone are written again."""
    line = plan.select(F.struct(*plan.columns).alias("_plan"))
    met = rows.join(sized_broadcast(line), F.col("source").eqNullSafe(F.col("_plan.source")))
    at = F.coalesce(place == F.col("_plan.last"), F.lit(False))
    early = F.coalesce((place < F.col("_plan.last")).cast("int"), F.lit(0))
    split = F.coalesce((F.col("_plan.some") > 0) & (F.col("_plan.some") < F.col("_plan.tied")), F.lit(False))
    taken = F.when(at, (F.col("_plan.some") > 0).cast("int")).otherwise(early)
    if plan.where("some > 0 and some < tied").isEmpty():
        return met.withColumn("_repeats", (F.col("_plan.whole") + taken).cast("int"))
    tied = _numbered(met.where(at & split)).withColumn("_repeats", (F.col("_plan.whole") + (F.col("_number") <= F.col("_plan.some")).cast("int")).cast("int"))
    return met.where(~(at & split)).withColumn("_repeats", (F.col("_plan.whole") + taken).cast("int")).unionByName(tied.drop("_number"))


def planned(docs: DataFrame, seed: str = "mix", max_epochs: int = 3, cycle: int = 3) -> DataFrame:
    """``doc_id, source, size, source_size, target, repeats``: how often each document is taken.

    A null text has size 0 and repeats like any other; a null source is a source of its own;
    rows with one doc_id or none are taken one by one in the order of a hash of the text, as many of equal
    rows as the rest needs; an empty table gives an empty plan. Reruns agree.
    """
    sized = cut(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), seeded_order(seed).alias("place")))
    met = _with_repeats(sized, source_plan(sized, max_epochs, cycle), F.col("place"))
    return met.select("doc_id", "source", "size", "_plan.source_size", "_plan.target", F.col("_repeats").alias("repeats"))


def mix_sources(docs: DataFrame, seed: str = "mix", max_epochs: int = 3, cycle: int = 3) -> DataFrame:
    """The mixture: every column of ``docs`` plus ``epoch`` (from 1), one row for each time a document is taken.

    Texts stay where they are: each row meets only its source's line of the plan. Which of
    several rows of equal source, doc_id and text is taken once more is open.
    """
    sized = cut(docs.select("source", words_in(F.col("text")).alias("size"), seeded_order(seed).alias("place")))
    plan = source_plan(sized, max_epochs, cycle)
    met = _with_repeats(packed(docs, F.col("source"), seeded_order(seed).alias("place")), plan, F.col("place"))
    epochs = F.when(F.col("_repeats") > 0, F.sequence(F.lit(1), F.col("_repeats")))
    return met.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "epoch"], F.explode(epochs).alias("epoch"))
