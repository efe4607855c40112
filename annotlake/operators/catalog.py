"""Listings, roll-ups and filters over sequences, frames, labels and what hangs on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.functions.paths import file_name
from annotlake.plans.numbering import number_rows, number_with_neighbours, number_within

PAGE = 64


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def review_progress(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count_if("reviewed").alias("reviewed"), F.count(F.lit(1)).alias("total"))


# ── sequences ───────────────────────────────────────────────────────────────


def list_sequences(sequences: DataFrame, frames: DataFrame) -> DataFrame:
    """Every sequence with its frame count; empty ones stay."""
    counts = frames.groupBy(F.col("sequence_id").alias("id")).agg(F.count(F.lit(1)).alias("frame_count"))
    return sequences.join(counts, "id", "left").select(
        "id", "name", "sort_order", F.coalesce("frame_count", F.lit(0)).alias("frame_count")
    )


def get_sequence(sequences: DataFrame, frames: DataFrame, sequence_id) -> DataFrame:
    return list_sequences(
        sequences.where(F.col("id") == sequence_id), frames.where(F.col("sequence_id") == sequence_id)
    )


def find_sequence_by_name(sequences: DataFrame, frames: DataFrame, name: str) -> DataFrame:
    return list_sequences(sequences.where(F.col("name") == name), frames)


def sequence_frames(frames: DataFrame, blobs: DataFrame, sequence_id) -> DataFrame:
    """Frames of one sequence in order; ``blobs`` lists the frames whose bytes are embedded."""
    stored = blobs.where(F.col("embedded_data").isNotNull()).select(
        F.col("frame_id").alias("id"), F.lit(True).alias("is_embedded")
    )
    return (
        frames.where(F.col("sequence_id") == sequence_id)
        .join(stored, "id", "left")
        .withColumn("is_embedded", F.coalesce("is_embedded", F.lit(False)))
        .orderBy("frame_index")
    )


def frame_ids_by_sequence(frames: DataFrame) -> DataFrame:
    """Ordered frame ids per sequence, one row per frame so that no sequence must fit in a row."""
    slim = frames.select("sequence_id", "frame_index", F.col("id").alias("frame_id"))
    return number_within(slim, ["sequence_id"], [F.col("frame_index"), F.col("frame_id")], "position").drop(
        "frame_index"
    )


def gallery_rollup(
    sequences: DataFrame,
    frames: DataFrame,
    raster_frames: DataFrame,
    vector_frames: DataFrame,
    registrations: DataFrame,
    pairs: DataFrame,
) -> DataFrame:
    """Frames, reviewed, annotated, first frame and keypoint flag per sequence.

    Annotated frame ids are made distinct first (combined on the map side), so the join adds
    a flag and never repeats a frame.
    """
    annotated = (
        raster_frames.select("frame_id").unionByName(vector_frames.select("frame_id")).distinct()
    ).select(F.col("frame_id").alias("id"), F.lit(True).alias("annotated"))
    per_sequence = (
        frames.select("id", "sequence_id", "reviewed")
        .join(annotated, "id", "left")
        .groupBy("sequence_id")
        .agg(
            F.count(F.lit(1)).alias("frame_count"),
            F.count_if("reviewed").alias("reviewed_count"),
            F.count("annotated").alias("annotated_count"),
            F.min("id").alias("first_frame_id"),
        )
    )
    paired = (
        registrations.select("id", "sequence_id")
        .join(pairs.select(F.col("registration_id").alias("id")), "id", "left_semi")
        .select("sequence_id", F.lit(True).alias("has_keypoints"))
        .distinct()
    )
    zero = F.lit(0)
    return (
        sequences.withColumnRenamed("id", "sequence_id")
        .join(per_sequence, "sequence_id", "left")
        .join(paired, "sequence_id", "left")
        .select(
            F.col("sequence_id").alias("id"),
            "name",
            "sort_order",
            F.coalesce("frame_count", zero).alias("frame_count"),
            F.coalesce("reviewed_count", zero).alias("reviewed_count"),
            F.coalesce("annotated_count", zero).alias("annotated_count"),
            "first_frame_id",
            F.coalesce("has_keypoints", F.lit(False)).alias("has_keypoints"),
        )
    )


def sequence_status(rollup: DataFrame) -> DataFrame:
    status = (
        F.when((F.col("frame_count") > 0) & (F.col("reviewed_count") >= F.col("frame_count")), "reviewed")
        .when((F.col("reviewed_count") > 0) | (F.col("annotated_count") > 0), "annotated")
        .otherwise("empty")
    )
    return rollup.withColumn("status", status)


def sequence_progress(rollup: DataFrame) -> DataFrame:
    """Share of reviewed frames; sequences without frames are not listed."""
    return rollup.where(F.col("frame_count") > 0).withColumn(
        "progress", F.col("reviewed_count") / F.col("frame_count")
    )


def gallery_filter(
    items: DataFrame,
    title: str = "",
    statuses: Sequence[str] = (),
    keypoints: str = "all",
    frame_range: tuple[int, int] | None = None,
) -> DataFrame:
    wanted = title.strip().lower()
    if wanted:
        items = items.where(F.lower("name").contains(wanted))
    if statuses:
        items = items.where(F.col("status").isin(list(statuses)))
    if keypoints != "all":
        items = items.where(F.col("has_keypoints") == (keypoints == "with"))
    if frame_range is not None:
        items = items.where(F.col("frame_count").between(*frame_range))
    return items


def gallery_order(key: str) -> list[Column]:
    field, _, way = key.partition("-")
    column = F.col({"name": "name", "frames": "frame_count", "progress": "progress"}[field])
    ties = [F.col("sort_order"), F.col("id")]
    return [column.desc() if way == "desc" else column.asc(), *ties]


def gallery_sort(items: DataFrame, key: str = "name-asc") -> DataFrame:
    return items.orderBy(*gallery_order(key))


def gallery_page(items: DataFrame, key: str, page: int, size: int = PAGE) -> DataFrame:
    """Items of one page (from 0) with their position, page and the number of pages."""
    numbered = number_rows(items, gallery_order(key), "position", 0)
    pages = numbered.agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("pages")).first()["pages"]
    return (
        numbered.withColumn("page", F.floor(F.col("position") / size))
        .withColumn("pages", F.lit(pages).cast("long"))
        .where(F.col("page") == page)
    )


def max_frame_count(items: DataFrame) -> DataFrame:
    return items.agg(F.max("frame_count").alias("max_frame_count"))


def sequence_fully_reviewed(frames: DataFrame) -> DataFrame:
    return frames.groupBy("sequence_id").agg(F.bool_and("reviewed").alias("fully_reviewed"))


def frame_neighbours(sequences: DataFrame, frames: DataFrame) -> DataFrame:
    """Previous and next frame over the whole project order, crossing sequences.

    One range shuffle brings neighbours side by side; partitions exchange their first and last frame.
    """
    order = sequences.select(
        F.col("id").alias("sequence_id"), F.col("sort_order").alias("seq_order"), F.col("name").alias("seq_name")
    )
    slim = frames.select("sequence_id", F.col("id").alias("frame_id"), "frame_index").join(order, "sequence_id")
    met = number_with_neighbours(
        slim, [F.col(c) for c in ("seq_order", "seq_name", "frame_index", "frame_id")], "frame_id", "position"
    )
    return met.select(
        "frame_id",
        "sequence_id",
        "position",
        F.col("previous").alias("previous_id"),
        F.col("next").alias("next_id"),
        F.col("previous").isNull().alias("is_first"),
        F.col("next").isNull().alias("is_last"),
    )


# ── labels ──────────────────────────────────────────────────────────────────


def list_labels(labels: DataFrame) -> DataFrame:
    return labels.select("id", "name", "color", "is_instance", "sort_order").orderBy("sort_order")


def get_labels(labels: DataFrame) -> DataFrame:
    return labels.select("name", "color", "is_instance").orderBy(F.col("sort_order"))


def label_index(labels: DataFrame) -> DataFrame:
    """1-based index by sort order: the pixel value a label has in label maps."""
    slim = labels.select(F.col("id").alias("label_id"), "name", "color", "is_instance", "sort_order")
    return number_rows(slim, [F.col("sort_order"), F.col("label_id")], "label_index")


def label_tree(names: DataFrame, name: str = "name") -> DataFrame:
    """Nodes of the '/'-separated name tree with how many rows lie at or below each."""
    split = names.groupBy(name).agg(F.count(F.lit(1)).alias("n")).select(
        F.split(F.col(name), "/").alias("parts"), "n"
    )
    nodes = split.select(
        "n", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")
    )
    path = F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")
    above = F.when(F.col("depth") > 1, F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/"))
    return nodes.groupBy(path.alias("path")).agg(
        F.first(F.element_at("parts", F.col("depth"))).alias("label"),
        F.first(above).alias("parent"),
        F.max("depth").alias("depth"),
        F.bool_or(F.col("depth") == F.size("parts")).alias("has_data"),
        F.sum("n").alias("rows_below"),
    )


# ── what hangs on frames ────────────────────────────────────────────────────


def frame_annotations(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Masks with their label's properties, to be read in label order."""
    shown = labels.select(F.col("id").alias("label_id"), "name", "color", "is_instance", "sort_order")
    return masks.join(shown, "label_id")


def frame_dimensions(frames: DataFrame) -> DataFrame:
    return frames.select("id", "width", "height")


def frame_classifications(classifications: DataFrame, tasks: DataFrame) -> DataFrame:
    """Selected classes with the index of the task in the configuration, -1 when multilabel or unknown."""
    known = tasks.where(~F.col("is_multilabel")).select(F.col("name").alias("task_name"), "task_index")
    return classifications.join(known, "task_name", "left").withColumn(
        "task_index", F.coalesce("task_index", F.lit(-1))
    )


def frame_texts(texts: DataFrame, frame_id) -> DataFrame:
    return texts.where(F.col("frame_id") == frame_id)


def multiclass_choices(classifications: DataFrame, task_names: Sequence[str]) -> DataFrame:
    """Frame by task matrix of the first selected class."""
    first = F.get("selected_classes", F.lit(0))
    return (
        classifications.where(~F.col("is_multilabel"))
        .withColumn("chosen", first)
        .groupBy("frame_id")
        .pivot("task_name", list(task_names))
        .agg(F.max("chosen"))
    )


# ── registrations ───────────────────────────────────────────────────────────


def list_registrations(registrations: DataFrame, pairs: DataFrame) -> DataFrame:
    counts = pairs.groupBy(F.col("registration_id").alias("id")).agg(F.count(F.lit(1)).alias("pair_count"))
    return registrations.join(counts, "id", "left").select(
        "id",
        "sequence_id",
        "reference_frame_id",
        "moving_frame_id",
        "transform_type",
        (F.col("homography").isNotNull() & (F.coalesce("homography", F.lit("null")) != "null")).alias(
            "has_homography"
        ),
        F.coalesce("pair_count", F.lit(0)).alias("pair_count"),
    )


def load_registration(registrations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Registration rows with their pairs in order, one row per pair."""
    coords = ["ref_x", "ref_y", "moving_x", "moving_y"]
    placed = number_within(
        pairs.select("registration_id", "sort_order", *coords),
        ["registration_id"],
        [F.col("sort_order"), *[F.col(c) for c in coords]],
        "position",
    ).withColumnRenamed("registration_id", "id")
    return registrations.select("id", "reference_frame_id", "moving_frame_id", "transform_type").join(
        placed, "id", "left"
    )


# ── export scan, imports ────────────────────────────────────────────────────


def dataset_frames(frames: DataFrame, only_reviewed: bool = False) -> DataFrame:
    """Frames an export covers; a missing path becomes ``frame_<id>``."""
    if only_reviewed:
        frames = frames.where(F.col("reviewed"))
    named = F.coalesce("relative_path", F.concat(F.lit("frame_"), F.col("id").cast("string")))
    return frames.withColumn("relative_path", named)


def next_order(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Order value the next row would get."""
    return df.groupBy(*keys).agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_order"))


def match_frames(imported: DataFrame, frames: DataFrame) -> DataFrame:
    """Catalog frame of each imported path: exact path first, else bare file name (lowest id)."""
    known = frames.where(F.col("relative_path").isNotNull())
    # Paths are unique by constraint; should they repeat, the last one stored counts.
    by_path = known.groupBy("relative_path").agg(F.max("id").alias("path_id"))
    by_name = known.groupBy(file_name(F.col("relative_path")).alias("bare")).agg(F.min("id").alias("name_id"))
    return (
        imported.withColumn("bare", file_name(F.col("relative_path")))
        .join(by_path, "relative_path", "left")
        .join(by_name, "bare", "left")
        .withColumn("frame_id", F.coalesce("path_id", "name_id"))
        .drop("bare", "path_id", "name_id")
    )


def match_summary(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count("frame_id").alias("frames_matched"),
        F.count_if(F.col("frame_id").isNull()).alias("frames_unmatched"),
    )
