"""Export tables: CSV matrices, colour table, vector JSON, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotlake.functions.color import map_rgb, table_rgb
from annotlake.functions.paths import bare_path
from annotlake.operators.catalog import label_index
from annotlake.plans.spread import join_shares


def colormap_table(labels: DataFrame) -> DataFrame:
    """Index, name, colour and channel values of each label."""
    r, g, b = table_rgb(F.col("color"))
    return label_index(labels).select(
        F.col("label_index").alias("index"), "label_id", "name", "color", r.alias("r"), g.alias("g"), b.alias("b")
    )


def map_colors(labels: DataFrame) -> DataFrame:
    """``label_index, r, g, b`` as colour maps paint them; ``labels`` holds label_index and color."""
    r, g, b = map_rgb(F.col("color"))
    return labels.select("label_index", r.alias("r"), g.alias("g"), b.alias("b"))


def _of_task(classifications: DataFrame, task: str) -> DataFrame:
    return classifications.where(F.col("task_name") == task).select("frame_id", "selected_classes")


def _listed(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("relative_path").isNotNull()).select(
        F.col("id").alias("frame_id"), F.col("relative_path").alias("image_path")
    )


def task_csv_multilabel(frames: DataFrame, classifications: DataFrame, task: str, classes: Sequence[str]) -> DataFrame:
    """0/1 per class for every frame with a path."""
    joined = _listed(frames).join(_of_task(classifications, task), "frame_id", "left")
    return joined.select(
        "frame_id",
        "image_path",
        *[
            F.coalesce(F.array_contains("selected_classes", c), F.lit(False)).cast("int").alias(c)
            for c in classes
        ],
    )


def task_csv_multiclass(frames: DataFrame, classifications: DataFrame, task: str, classes: Sequence[str]) -> DataFrame:
    """Class index (-1 when none or unknown), class name and one column per class."""
    chosen = F.get("selected_classes", F.lit(0))
    joined = _listed(frames).join(_of_task(classifications, task), "frame_id", "left")
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("chosen")) - 1
    return joined.withColumn("chosen", chosen).select(
        "frame_id",
        "image_path",
        F.coalesce(index, F.lit(-1)).cast("int").alias("class_index"),
        F.coalesce("chosen", F.lit("")).alias("class_name"),
        *[F.coalesce(F.col("chosen") == c, F.lit(False)).cast("int").alias(c) for c in classes],
    )


def classifications_long_csv(frames: DataFrame, classifications: DataFrame, only_reviewed: bool = False) -> DataFrame:
    """One row per selected class."""
    if only_reviewed:
        frames = frames.where(F.col("reviewed"))
    listed = frames.select(
        F.col("id").alias("frame_id"), F.coalesce("relative_path", F.lit("")).alias("image_path")
    )
    return classifications.join(listed, "frame_id").select(
        "frame_id",
        "image_path",
        "task_name",
        F.explode("selected_classes").alias("class_name"),
        F.lit(1).alias("value"),
    )


def tasks_table(tasks: DataFrame) -> DataFrame:
    return tasks.select("name", "classes", "is_multilabel", F.size("classes").alias("num_classes"))


def vector_json(flattened: DataFrame, label_names: DataFrame) -> DataFrame:
    """One JSON object per shape, keyed by frame: label, closed, filled, polygon."""
    return flattened.join(label_names, "label_id", "left").select(
        "frame_id",
        "shape_id",
        F.to_json(
            F.struct(
                F.col("label_name").alias("label"),
                "closed",
                "filled",
                F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("polygon"),
            )
        ).alias("json"),
    )


def frame_files(frames: DataFrame, folder: str, ending: str) -> DataFrame:
    """``frame_id, file``: where each frame with a path is written below ``folder``, its own folders kept and its ending replaced."""
    named = frames.where(F.col("relative_path").isNotNull())
    file = F.concat(F.lit(f"{folder}/"), bare_path(F.col("relative_path")), F.lit(ending))
    return named.select(F.col("id").alias("frame_id"), file.alias("file"))


def mask_files(masks: DataFrame, frames: DataFrame) -> DataFrame:
    """Individual masks with their ``file``: a folder for each label, the frame's folders below it."""
    rest = frame_files(frames, "", ".png")
    return masks.join(rest, "frame_id").withColumn("file", F.concat(F.lit("individual_masks/"), F.col("label_name"), F.col("file")))


def vector_documents(flattened: DataFrame, labels: DataFrame, frames: DataFrame) -> DataFrame:
    """``file, json``: one JSON array for each frame with shapes, in shape order.

    Every shape carries its label's name and id, its exact nodes with handles, and its outline
    as a polygon. A document holds the shapes of one frame.
    """
    handles = {"x": "x", "y": "y", "inX": "in_x", "inY": "in_y", "outX": "out_x", "outY": "out_y", "smooth": "smooth"}
    nodes = F.transform("nodes", lambda n: F.struct(*[n[c].alias(key) for key, c in handles.items()]))
    polygon = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    names = labels.select("label_id", F.col("name").alias("label"))
    shape = F.struct(F.coalesce("label", F.lit("")).alias("label"), "label_id", "closed", "filled", nodes.alias("nodes"), polygon.alias("polygon"))
    listed = join_shares(flattened, names, "label_id", "left").groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("shape_id", shape.alias("shape")))).alias("l"))
    written = listed.join(frame_files(frames, "vector", ".json"), "frame_id")
    return written.select("file", F.to_json(F.transform("l", lambda s: s["shape"])).alias("json"))


def export_errors(frames: DataFrame) -> DataFrame:
    """Frames an export skips because they have no path."""
    return frames.where(F.col("relative_path").isNull()).select(
        F.col("id").alias("frame_id"), F.lit("frame has no path").alias("error")
    )


def export_summary(frames: DataFrame, only_reviewed: bool = False) -> DataFrame:
    """Frames written (also those without masks) and frames skipped."""
    if only_reviewed:
        frames = frames.where(F.col("reviewed"))
    return frames.agg(
        F.count("relative_path").alias("total_exported"),
        F.count_if(F.col("relative_path").isNull()).alias("errors"),
    )
