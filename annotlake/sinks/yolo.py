"""YOLO label lines and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.functions.paths import stem
from annotlake.operators.geometry import polygon_bounds
from annotlake.plans.numbering import number_within
from annotlake.sinks.files import write_files


def _six(value: Column) -> Column:
    """Six decimals, exact halves to the even digit."""
    return F.format_string("%.6f", F.bround(value.cast("double"), 6))


def _framed(df: DataFrame, frames: DataFrame) -> DataFrame:
    """Join the image size; frames without one are skipped."""
    sizes = frames.where((F.col("width") > 0) & (F.col("height") > 0)).select(
        F.col("id").alias("frame_id"), F.coalesce("relative_path", F.concat(F.lit("frame_"), F.col("id").cast("string"))).alias("relative_path"), "width", "height"
    )
    return df.join(sizes, "frame_id")


def _box_line() -> Column:
    x, y, w, h = (F.col(c).cast("double") for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h"))
    fw, fh = F.col("width").cast("double"), F.col("height").cast("double")
    return F.concat_ws(
        " ",
        (F.col("label_index") - 1).cast("string"),
        _six((x + w / 2.0) / fw),
        _six((y + h / 2.0) / fh),
        _six(w / fw),
        _six(h / fh),
    )


def _ring_line() -> Column:
    fw, fh = F.col("width").cast("double"), F.col("height").cast("double")
    numbers = F.flatten(F.transform("points", lambda p: F.array(_six(p["x"] / fw), _six(p["y"] / fh))))
    return F.concat(((F.col("label_index") - 1).cast("string")), F.lit(" "), F.array_join(numbers, " "))


LINE = ("frame_id", "relative_path", "kind", "label_index", "part", "ring", "line")


def _lines(df: DataFrame, kind: int, part: Column, ring: Column, line: Column) -> DataFrame:
    return df.select(
        "frame_id", "relative_path", F.lit(kind).alias("kind"), F.col("label_index").cast("long").alias("label_index"), part.cast("long").alias("part"), ring.cast("long").alias("ring"), line.alias("line"),
    )


def yolo_detect_lines(regions: DataFrame, shapes: DataFrame, frames: DataFrame) -> DataFrame:
    """``class cx cy w h`` per mask region and per shape with at least three points.

    ``shapes``: frame_id, label_index, shape_id, points.
    """
    zero = F.lit(0)
    boxed = shapes.where(F.size("points") >= 3).withColumns(polygon_bounds(F.col("points")))
    return _lines(_framed(regions, frames), 0, F.col("part"), zero, _box_line()).unionByName(
        _lines(_framed(boxed, frames), 1, F.col("shape_id"), zero, _box_line())
    )


def yolo_segment_lines(rings: DataFrame, shapes: DataFrame, frames: DataFrame) -> DataFrame:
    """One line per region ring and per shape with at least three points.

    ``rings``: frame_id, label_index, part, ring, points.
    """
    of_rings = _lines(_framed(rings, frames), 0, F.col("part"), F.col("ring"), _ring_line())
    return of_rings.unionByName(yolo_shape_lines(shapes, frames))


def yolo_shape_lines(shapes: DataFrame, frames: DataFrame) -> DataFrame:
    """The lines of shapes alone."""
    drawn = shapes.where(F.size("points") >= 3)
    return _lines(_framed(drawn, frames), 1, F.col("shape_id"), F.lit(0), _ring_line())


def yolo_label_files(lines: DataFrame) -> DataFrame:
    """Lines with the file they belong to and their place in it.

    Files are keyed by the full relative path, so same-named images of two folders do not
    overwrite each other; ``stem_collisions`` reports where a stem alone would.
    """
    order = [F.col(c) for c in ("kind", "label_index", "part", "ring")]
    placed = number_within(lines, ["relative_path"], order, "line_no")
    key = F.regexp_replace("relative_path", r"(?<=[^/])\.[^./]*$", "")
    return placed.select(F.concat(key, F.lit(".txt")).alias("file"), "line_no", "line")


def stem_collisions(frames: DataFrame) -> DataFrame:
    """Stems shared by several images."""
    named = frames.where(F.col("relative_path").isNotNull())
    return named.groupBy(stem(F.col("relative_path")).alias("stem")).agg(F.count(F.lit(1)).alias("images")).where("images > 1")


def data_yaml_lines(labels: DataFrame) -> DataFrame:
    """Lines of data.yaml in order; ``labels``: label_index, name."""
    head = labels.sparkSession.createDataFrame(
        [(0, "path: ."), (1, "train: images"), (2, "val: images"), (3, "names:")], "line_no long, line string"
    )
    names = labels.select(
        (F.col("label_index") + 3).cast("long").alias("line_no"),
        F.concat(F.lit("  "), (F.col("label_index") - 1).cast("string"), F.lit(": "), F.col("name")).alias("line"),
    )
    count = labels.agg(
        (F.count(F.lit(1)) + 4).alias("line_no"), F.concat(F.lit("nc: "), F.count(F.lit(1)).cast("string")).alias("line")
    )
    return head.unionByName(names).unionByName(count)


def write_label_files(files: DataFrame, folder: str) -> int:
    """One text file per image below ``labels/``, lines in order; ``files`` as ``yolo_label_files`` makes them."""
    line = F.struct("line_no", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: F.concat(r["line"], F.lit("\n"))), "")
    return write_files(files.groupBy(F.concat(F.lit("labels/"), F.col("file")).alias("path")).agg(text.alias("content")), folder)


def write_data_yaml(lines: DataFrame, folder: str) -> int:
    """``data.yaml`` from its lines, a header of a few."""
    line = F.struct("line_no", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: F.concat(r["line"], F.lit("\n"))), "")
    return write_files(lines.agg(text.alias("content")).withColumn("path", F.lit("data.yaml")), folder)
