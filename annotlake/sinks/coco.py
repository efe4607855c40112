"""COCO tables: images, categories, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotlake.operators.catalog import dataset_frames
from annotlake.operators.geometry import polygon_area, polygon_bounds
from annotlake.plans.numbering import number_rows
from annotlake.plans.spread import join_shares
from annotlake.sinks.files import write_files

BOX = ("bbox_x", "bbox_y", "bbox_w", "bbox_h")


def coco_images(frames: DataFrame, only_reviewed: bool = False) -> DataFrame:
    """Images numbered from 1 in frame id order."""
    chosen = dataset_frames(frames, only_reviewed).select("id", "relative_path", "width", "height")
    numbered = number_rows(chosen, [F.col("id")], "image_id")
    return numbered.select(
        F.col("id").alias("frame_id"), F.col("image_id").alias("id"), F.col("relative_path").alias("file_name"), "width", "height"
    )


def coco_categories(labels: DataFrame) -> DataFrame:
    """``labels``: label_index, name."""
    return labels.select(F.col("label_index").alias("id"), "name", F.lit("").alias("supercategory"))


def coco_annotations(
    images: DataFrame,
    regions: DataFrame,
    shapes: DataFrame,
    labels: DataFrame,
    outlines: DataFrame | None = None,
    segmentation: bool = True,
) -> DataFrame:
    """Annotations numbered from 1: per image the mask regions, then its shapes.

    ``regions``: output of mask_regions. ``shapes`` carry ``points`` and appear only with
    ``segmentation``; those under three points never do. ``outlines``: frame_id, label_id,
    part, rings of the regions; without them a region has no rings.
    """
    image_of = images.select("frame_id", F.col("id").alias("image_id"))
    order = ["image_id", "kind", "category_id", "part"]
    empty = F.expr("cast(array() as array<array<double>>)")
    if segmentation and outlines is not None:
        regions = regions.join(outlines, ["frame_id", "label_id", "part"], "left")
        rings = F.coalesce("rings", empty)
    else:
        rings = empty
    doubles = [F.col(c).cast("double").alias(c) for c in BOX]
    rows = regions.join(image_of, "frame_id").select(
        "image_id", F.lit(0).alias("kind"), F.col("label_index").alias("category_id"), "part", *doubles,
        F.col("area").cast("double").alias("area"), rings.alias("segmentation"),
    )
    if segmentation:
        index_of = labels.select("label_id", "label_index")
        flat = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"])))
        drawn = join_shares(shapes.where(F.size("points") >= 3), index_of, "label_id").join(image_of, "frame_id")
        boxes = polygon_bounds(F.col("points"))
        rows = rows.unionByName(
            drawn.select(
                "image_id", F.lit(1).alias("kind"), F.col("label_index").alias("category_id"), F.col("shape_id").cast("long").alias("part"),
                *[c.alias(name) for name, c in boxes.items()], polygon_area().alias("area"), F.array(flat).alias("segmentation"),
            )
        )
    # Only the four keys are sorted and written; rings and boxes meet their number by one join.
    numbers = number_rows(rows.select(*order), [F.col(c) for c in order], "id")
    return rows.join(numbers, order).withColumn("iscrowd", F.lit(0)).drop("part")


def coco_documents(keyed: DataFrame, images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """One JSON document per key, for corpora cut into documents of bounded size.

    ``keyed``: doc_id, image_id assigns images to documents; annotations follow their image.
    """
    image = F.struct(F.col("id").cast("long").alias("id"), "file_name", "width", "height")
    listed_images = (
        images.join(keyed.withColumnRenamed("image_id", "id"), "id").groupBy("doc_id").agg(F.array_sort(F.collect_list(image)).alias("images"))
    )
    ann = F.struct(
        F.col("id").cast("long").alias("id"), F.col("image_id").cast("long").alias("image_id"), F.col("category_id").cast("long").alias("category_id"),
        F.array(*BOX).alias("bbox"), "area", "iscrowd", "segmentation",
    )
    listed_anns = annotations.join(keyed, "image_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(ann)).alias("annotations"))
    cats = F.struct(F.col("id").cast("long").alias("id"), "name", "supercategory")
    # The category list is one value, the same in every document: a scalar subquery, not a join.
    listed_cats = categories.agg(F.array_sort(F.collect_list(cats)).alias("categories")).scalar()
    return listed_images.join(listed_anns, "doc_id", "left").withColumn("categories", listed_cats)


def write_coco(folder: str, documents: DataFrame) -> int:
    """One JSON file per document, named after its key, as ``read_coco`` and other tools read them."""
    body = F.to_json(F.struct("images", "categories", "annotations"))
    return write_files(documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), body.alias("content")), folder)
