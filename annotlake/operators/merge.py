"""Mutations as set-based merges: current snapshot and change set in, next snapshot out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.operators.catalog import match_frames, next_order
from annotlake.operators.geometry import points_to_shape
from annotlake.plans.numbering import number_rows, number_within


def upsert_latest(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("modified_at", "seq")
) -> DataFrame:
    """Last write per key wins.

    A maximum over (order, rest) combines on the map side, so a key holding a large share of
    all writes reaches the shuffle as one row per map task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")


def replace_by_key(current: DataFrame, changes: DataFrame, keys: Sequence[str], delete_when: Column) -> DataFrame:
    """Changed keys give way to the change; changes matching ``delete_when`` only delete.

    ``changes`` hold one row per key; run them through ``upsert_latest`` first.
    """
    kept = current.join(changes.select(*keys), list(keys), "left_anti")
    added = changes.where(~F.coalesce(delete_when, F.lit(False)))
    return kept.unionByName(added.select(*current.columns))


def sync_labels(
    current: DataFrame, config: DataFrame, raster: DataFrame, shapes: DataFrame | None = None
) -> DataFrame:
    """Labels after a configuration change.

    Configured labels are inserted or updated; others go unless a raster annotation uses
    them. ``shapes`` given, labels only shapes use are kept too (the default lets them go).
    ``config`` holds name, color, is_instance, sort_order; new labels get ids after the
    largest; an empty configuration deletes nothing.
    """
    configured = config.select("name", "color", "is_instance", "sort_order")
    known = current.select("id", "name")
    joined = configured.join(known, "name", "left")
    updated = joined.where(F.col("id").isNotNull())
    fresh = joined.where(F.col("id").isNull()).drop("id")
    last_id = current.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    inserted = number_rows(fresh, [F.col("sort_order"), F.col("name")], "id", 1).withColumn("id", F.col("id") + last_id)
    used = raster.select(F.col("label_id").alias("id")).distinct()
    if shapes is not None:
        used = used.unionByName(shapes.select(F.col("label_id").alias("id"))).distinct()
    others = current.join(configured.select("name"), "name", "left_anti")
    nothing = configured.agg(F.count(F.lit(1)) == 0).scalar()
    others = others.join(used.withColumn("_used", F.lit(True)), "id", "left").where(F.col("_used") | nothing)
    cols = ["id", "name", "color", "is_instance", "sort_order"]
    return others.select(*cols).unionByName(updated.select(*cols)).unionByName(inserted.select(*cols))


def cascade_labels(labels: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with a label_id (shapes, annotations) without the rows of labels that are gone."""
    left = labels.select(F.col("id").alias("label_id"))
    return {name: df.join(left, "label_id", "left_semi").select(*df.columns) for name, df in tables.items()}


def sync_labels_everywhere(
    current: DataFrame, config: DataFrame, annotations: DataFrame, shapes: DataFrame
) -> dict[str, DataFrame]:
    """``sync_labels`` with its cascade: the next snapshot of labels, annotations and shapes.

    A label no raster annotation uses goes with its shapes.
    """
    labels = sync_labels(current, config, annotations)
    return {"labels": labels, **cascade_labels(labels, {"annotations": annotations, "shapes": shapes})}


def upsert_shapes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Shape lists per frame and label; an empty list deletes."""
    return replace_by_key(current, changes, ["frame_id", "label_id"], F.size("shapes") == 0)


def upsert_classification(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Selected classes per frame and task; an empty selection deletes."""
    return replace_by_key(current, changes, ["frame_id", "task_name"], F.size("selected_classes") == 0)


def batch_classify(
    current: DataFrame, frames: DataFrame, choices: dict[str, str | None], multilabel: tuple[str, list[str]] | None = None
) -> DataFrame:
    """Set the chosen class of each task on every frame of ``frames(frame_id)``; null choices are skipped."""
    rows = [
        F.struct(
            F.lit(task).alias("task_name"), F.array(F.lit(c)).alias("selected_classes"), F.lit(False).alias("is_multilabel")
        )
        for task, c in choices.items()
        if c is not None
    ]
    if multilabel is not None:
        task, values = multilabel
        rows.append(
            F.struct(
                F.lit(task).alias("task_name"),
                F.array(*[F.lit(v) for v in values]).alias("selected_classes"),
                F.lit(True).alias("is_multilabel"),
            )
        )
    if not rows:
        return current
    payload = frames.select("frame_id").distinct().select("frame_id", F.inline(F.array(*rows)))
    return replace_by_key(current, payload, ["frame_id", "task_name"], F.lit(False))


def upsert_text(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Text per frame and field; empty content deletes."""
    return replace_by_key(current, changes, ["frame_id", "label_name"], F.col("content") == "")


def delete_text(current: DataFrame, keys: DataFrame) -> DataFrame:
    return current.join(keys.select("frame_id", "label_name"), ["frame_id", "label_name"], "left_anti")


def set_reviewed(frames: DataFrame, ids: DataFrame, reviewed: bool = True) -> DataFrame:
    """Set the flag on the frames listed in ``ids(id)``."""
    chosen = ids.select("id").distinct().withColumn("_chosen", F.lit(True))
    flag = F.when(F.col("_chosen"), F.lit(reviewed)).otherwise(F.col("reviewed"))
    return frames.join(chosen, "id", "left").withColumn("reviewed", flag).drop("_chosen")


# ── sequences ───────────────────────────────────────────────────────────────


def create_sequence(sequences: DataFrame, name: str) -> DataFrame:
    """Append a sequence after the last one."""
    made = sequences.agg(
        (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"),
        F.lit(name).alias("name"),
        (F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("sort_order"),
    )
    return sequences.unionByName(made.select(*sequences.columns))


def rename_sequence(sequences: DataFrame, sequence_id, name: str) -> DataFrame:
    return sequences.withColumn("name", F.when(F.col("id") == sequence_id, F.lit(name)).otherwise(F.col("name")))


def delete_sequence(tables: dict[str, DataFrame], sequence_id) -> dict[str, DataFrame]:
    """Drop a sequence and everything below it; returns the next snapshot of each table given.

    Tables: sequences, frames and any of annotations, shapes, classifications, texts
    (by frame_id), registrations, keypoint_pairs.
    """
    gone = tables["frames"].where(F.col("sequence_id") == sequence_id).select(F.col("id").alias("frame_id"))
    out = {
        "sequences": tables["sequences"].where(F.col("id") != sequence_id),
        "frames": tables["frames"].where(F.col("sequence_id") != sequence_id),
    }
    for name in ("annotations", "shapes", "classifications", "texts"):
        if name in tables:
            out[name] = tables[name].join(gone, "frame_id", "left_anti")
    if "registrations" in tables:
        kept = tables["registrations"].where(F.col("sequence_id") != sequence_id)
        for side in ("reference_frame_id", "moving_frame_id"):
            kept = kept.join(gone.withColumnRenamed("frame_id", side), side, "left_anti")
        out["registrations"] = kept
        if "keypoint_pairs" in tables:
            lost = tables["registrations"].join(kept.select("id"), "id", "left_anti")
            out["keypoint_pairs"] = tables["keypoint_pairs"].join(
                lost.select(F.col("id").alias("registration_id")), "registration_id", "left_anti"
            )
    return out


def reorder_sequences(sequences: DataFrame, ordered: DataFrame) -> DataFrame:
    """sort_order = position in ``ordered(id, position)``; unlisted sequences keep theirs."""
    return (
        sequences.join(ordered.select("id", "position"), "id", "left")
        .withColumn("sort_order", F.coalesce("position", "sort_order"))
        .drop("position")
    )


def move_frames(frames: DataFrame, moved: DataFrame, target) -> DataFrame:
    """Reassign ``moved(id, place)`` to a sequence, after its last frame, in the given order."""
    after = next_order(frames.where(F.col("sequence_id") == target), "frame_index").scalar()
    placed = number_rows(moved.select("id", "place"), [F.col("place"), F.col("id")], "_step", 0)
    joined = frames.join(placed.select("id", "_step"), "id", "left")
    return joined.select(
        *[
            F.when(F.col("_step").isNotNull(), F.lit(target)).otherwise(F.col(c)).alias(c)
            if c == "sequence_id"
            else F.coalesce(after + F.col("_step"), F.col(c)).alias(c)
            if c == "frame_index"
            else F.col(c)
            for c in frames.columns
        ]
    )


# ── registrations ───────────────────────────────────────────────────────────

PAIR = ("reference_frame_id", "moving_frame_id")


def replace_pairs(
    registrations: DataFrame, pairs: DataFrame, saved: DataFrame, saved_pairs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Upsert registrations by frame pair, then swap all their keypoints for the saved ones.

    ``saved`` has the columns of ``registrations`` without id; ``saved_pairs`` carry the
    frame pair, coordinates and ``place``, the order they were given in.
    """
    last_id = registrations.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    known = registrations.select("id", *PAIR)
    joined = saved.join(known, list(PAIR), "left")
    old = joined.where(F.col("id").isNotNull())
    new = number_rows(joined.where(F.col("id").isNull()).drop("id"), [F.col(c) for c in PAIR], "id", 1)
    new = new.withColumn("id", F.col("id") + last_id)
    current = old.select(*registrations.columns).unionByName(new.select(*registrations.columns))
    next_registrations = registrations.join(saved.select(*PAIR), list(PAIR), "left_anti").unionByName(current)
    fresh = saved_pairs.join(current.select(F.col("id").alias("registration_id"), *PAIR), list(PAIR))
    placed = number_within(fresh.drop("sort_order"), ["registration_id"], [F.col("place")], "sort_order")
    kept = pairs.join(current.select(F.col("id").alias("registration_id")), "registration_id", "left_anti")
    return next_registrations, kept.unionByName(placed.select(*pairs.columns))


def delete_registration(
    registrations: DataFrame, pairs: DataFrame, removed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop the registrations of the frame pairs in ``removed`` and their keypoints."""
    gone = registrations.join(removed.select(*PAIR), list(PAIR), "left_semi").select("id")
    return (
        registrations.join(gone, "id", "left_anti"),
        pairs.join(gone.withColumnRenamed("id", "registration_id"), "registration_id", "left_anti"),
    )


# ── imports ─────────────────────────────────────────────────────────────────


def merge_dataset(
    labels: DataFrame,
    frames: DataFrame,
    shapes: DataFrame,
    annotations: DataFrame,
    classifications: DataFrame,
    imported: dict[str, DataFrame],
) -> dict[str, DataFrame]:
    """Lay imported documents over the project.

    ``imported``: labels(label_index, name, color, is_instance), frames(relative_path) and
    any of shapes(relative_path, label_index, ...), masks(relative_path, label_index, ...),
    classifications(relative_path, task_name, selected_classes). Each may carry ``doc_id``, the
    document a row stems from, to which paths and label indexes belong; without it all rows
    are of one document. Frames may carry ``pos``, their place in it.

    Missing labels are made by name, frames matched by path then file name. Shapes are
    appended; those given as ``points`` are made into shapes with ids first. Masks and
    classifications replace what is stored; where several imported frames match one frame,
    the last by document and place counts. ``counts`` reports what was done.
    """
    given = {k: df if "doc_id" in df.columns else df.withColumn("doc_id", F.lit("")) for k, df in imported.items()}
    got = given["labels"]
    top_id = labels.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    top_order = labels.agg(F.coalesce(F.max("sort_order"), F.lit(-1)).cast("long")).scalar()
    unseen = got.join(labels.select("name"), "name", "left_anti")
    # Names repeated in an import make one label, the first.
    first = unseen.groupBy("name").agg(F.min(F.struct("doc_id", "label_index", "color", "is_instance")).alias("f"))
    created = number_rows(first.select("name", "f.*"), [F.col("doc_id"), F.col("label_index")], "_n", 1).select(
        (F.col("_n") + top_id).alias("id"), "name", "color", "is_instance", (F.col("_n") + top_order).alias("sort_order")
    )
    next_labels = labels.select("id", "name", "color", "is_instance", "sort_order").unionByName(created)
    label_of = got.select("doc_id", "label_index", "name").join(next_labels.select(F.col("id").alias("label_id"), "name"), "name")
    label_of = label_of.groupBy("doc_id", "label_index").agg(F.max("label_id").alias("label_id"))
    listed = given["frames"] if "pos" in given["frames"].columns else given["frames"].withColumn("pos", F.lit(0))
    matched = match_frames(listed.select("doc_id", "relative_path", "pos"), frames)
    target = matched.where(F.col("frame_id").isNotNull()).groupBy("doc_id", "relative_path", "frame_id").agg(F.max("pos").alias("pos"))

    def placed(table: DataFrame) -> DataFrame:
        return table.join(target, ["doc_id", "relative_path"]).join(label_of, ["doc_id", "label_index"])

    out = {"labels": next_labels, "shapes": shapes, "annotations": annotations, "classifications": classifications}
    done = []
    order = ["doc_id", "pos", "relative_path"]
    if "shapes" in given:
        new = placed(given["shapes"])
        if "shape_id" not in new.columns:
            new = points_to_shape(new, shapes.agg(F.count(F.lit(1))).scalar())
        out["shapes"] = shapes.unionByName(new.select(*shapes.columns))
        done.append(new.select(F.lit(1).alias("n")))
    if "masks" in given:
        every = placed(given["masks"])
        last = every.groupBy("frame_id", "label_id").agg(F.max(F.struct(*order)).alias("_last"))
        chosen = last.select("frame_id", "label_id", *[F.col(f"_last.{c}").alias(c) for c in order])
        new = every.join(chosen, ["frame_id", "label_id", *order], "left_semi")
        out["annotations"] = replace_masks(annotations, new)
        done.append(every.select("label_id", *order).distinct().select(F.lit(1).alias("n")))
    if "classifications" in given:
        new = given["classifications"].join(target, ["doc_id", "relative_path"])
        new = upsert_latest(new, ["frame_id", "task_name"], order).drop(*order)
        # An update leaves is_multilabel as it was; a new row starts as single choice.
        before = classifications.select("frame_id", "task_name", F.col("is_multilabel").alias("_was"))
        new = new.drop("is_multilabel").join(before, ["frame_id", "task_name"], "left").withColumn(
            "is_multilabel", F.coalesce("_was", F.lit(False))
        )
        out["classifications"] = replace_by_key(
            classifications, new.drop("_was"), ["frame_id", "task_name"], F.lit(False)
        )
    # One row per source of counts, summed into one row: no join of single rows.
    names = ("frames_matched", "frames_unmatched", "annotations_imported", "labels_created")
    zero = F.lit(0).cast("long")

    def row(df: DataFrame, **known: Column) -> DataFrame:
        return df.agg(*[known.get(n, zero).cast("long").alias(n) for n in names])

    rows = row(
        matched,
        frames_matched=F.count("frame_id"),
        frames_unmatched=F.count_if(F.col("frame_id").isNull()),
    ).unionByName(row(created, labels_created=F.count(F.lit(1))))
    for part in done:
        rows = rows.unionByName(row(part, annotations_imported=F.count(F.lit(1))))
    out["counts"] = rows.agg(*[F.sum(n).alias(n) for n in names])
    return out


def replace_masks(current: DataFrame, new: DataFrame) -> DataFrame:
    """Masks given as runs or blobs: every (frame, label) in ``new`` replaces the stored one."""
    keys = ["frame_id", "label_id"]
    kept = current.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new.select(*current.columns))


# ── constraints ─────────────────────────────────────────────────────────────


def unique_violations(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    named = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return repeated.select(
        F.lit(f"unique {table}({', '.join(keys)})").alias("violation"), named.alias("key"), F.col("n").alias("rows")
    )


def reference_violations(df: DataFrame, table: str, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Values of a reference that its target lacks, with how many rows hold them."""
    held = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    missing = held.join(target.select(F.col(target_column).alias("_v")), "_v", "left_anti")
    return missing.select(
        F.lit(f"reference {table}.{column}").alias("violation"), F.col("_v").cast("string").alias("key"), F.col("n").alias("rows")
    )


def check_violations(df: DataFrame, table: str, name: str, holds: Column, key: str) -> DataFrame:
    return df.where(~holds).select(
        F.lit(f"check {table}: {name}").alias("violation"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("rows")
    )


def constraint_report(t: dict[str, DataFrame]) -> DataFrame:
    """Rows that break a key, a reference or a check of the catalog.

    ``shapes`` (stored lists per frame and label), ``project`` and keypoints' ``client_uuid``
    are checked where they are given.
    """
    parts = [
        unique_violations(t["sequences"], "sequences", ["name"]),
        unique_violations(t["labels"], "labels", ["name"]),
        unique_violations(t["frames"], "frames", ["sequence_id", "frame_index"]),
        unique_violations(t["annotations"], "annotations", ["frame_id", "label_id"]),
        unique_violations(t["classifications"], "classifications", ["frame_id", "task_name"]),
        unique_violations(t["texts"], "texts", ["frame_id", "label_name"]),
        unique_violations(t["registrations"], "registrations", list(PAIR)),
        reference_violations(t["frames"], "frames", "sequence_id", t["sequences"], "id"),
        reference_violations(t["annotations"], "annotations", "frame_id", t["frames"], "id"),
        reference_violations(t["annotations"], "annotations", "label_id", t["labels"], "id"),
        reference_violations(t["classifications"], "classifications", "frame_id", t["frames"], "id"),
        reference_violations(t["texts"], "texts", "frame_id", t["frames"], "id"),
        reference_violations(t["keypoint_pairs"], "keypoint_pairs", "registration_id", t["registrations"], "id"),
        check_violations(
            t["registrations"], "registrations", "two frames", F.col(PAIR[0]) != F.col(PAIR[1]), "id"
        ),
    ]
    for column, target in (("sequence_id", "sequences"), (PAIR[0], "frames"), (PAIR[1], "frames")):
        parts.append(reference_violations(t["registrations"], "registrations", column, t[target], "id"))
    if "shapes" in t:
        parts.append(unique_violations(t["shapes"], "shapes", ["frame_id", "label_id"]))
        parts.append(reference_violations(t["shapes"], "shapes", "frame_id", t["frames"], "id"))
        parts.append(reference_violations(t["shapes"], "shapes", "label_id", t["labels"], "id"))
    if "client_uuid" in t["keypoint_pairs"].columns:
        parts.append(unique_violations(t["keypoint_pairs"], "keypoint_pairs", ["registration_id", "client_uuid"]))
    if "project" in t:
        rows = t["project"].agg(F.count(F.lit(1)).alias("rows")).where("rows <> 1")
        parts.append(rows.select(F.lit("single row project").alias("violation"), F.lit("").alias("key"), "rows"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
