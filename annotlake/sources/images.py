"""Folder scans and frame imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annotlake.functions.paths import IMAGE_PATTERN, below, file_name, sequence_name, sniff_mime
from annotlake.plans.numbering import number_rows, number_within
from annotlake.sinks.files import sharded_files


def read_folder(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path (relative), content and length of every file below ``root``."""
    kept = sharded_files(spark, root)
    if kept is not None:
        shown = kept if recursive else kept.where(~F.contains(F.col("path"), F.lit("/")))
        return shown.select("path", "content", F.length("content").cast("long").alias("length"))
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    )
    return files.select(below(F.col("path"), root).alias("path"), "content", "length")


def image_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (relative), width and height of every file below ``root``; -1 where they can't be told.

    PNG, GIF and BMP files state their size at a fixed place of the header. Only the others
    are decoded.
    """
    return _decoded_sizes(spark, root, with_header_sizes(read_folder(spark, root)).select("path", "width", "height"))


def with_header_sizes(files: DataFrame) -> DataFrame:
    """Add width and height as the header in ``content`` states them, else null."""
    width, height = header_size(F.col("content"))
    return files.withColumns({"width": width, "height": height})


def _decoded_sizes(spark: SparkSession, root: str, told: DataFrame) -> DataFrame:
    """Fill width and height of the kinds that only a decoder can tell; -1 where none can."""
    either = lambda a, b: F.coalesce(a, b, F.lit(-1)).cast("int")
    if sharded_files(spark, root) is not None:  # the decoder reads files only
        return told.withColumns({c: either(F.col(c), F.lit(None)) for c in ("width", "height")})
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG,tif,tiff}").load(root)
    decoded = images.select(below(F.col("image.origin"), root).alias("path"), F.col("image.width").alias("_w"), F.col("image.height").alias("_h"))
    met = told.join(decoded, "path", "left")
    return met.withColumns({"width": either(F.col("width"), F.col("_w")), "height": either(F.col("height"), F.col("_h"))}).drop("_w", "_h")


def header_size(content: Column) -> tuple[Column, Column]:
    """Width and height that a PNG, GIF or BMP header states, else null."""
    at = lambda start, width: F.hex(F.substring(content, start, width))
    turned = lambda digits: F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
    number = lambda digits: F.conv(digits, 16, 10).cast("long").cast("int")
    kind = sniff_mime(content)

    def side(png: int, gif: int, bmp: int) -> Column:
        little = at(gif, 2)
        return (
            F.when((kind == "image/png") & (F.length(content) >= 24), number(at(png, 4)))
            .when((kind == "image/gif") & (F.length(content) >= 10), number(F.concat(F.substring(little, 3, 2), F.substring(little, 1, 2))))
            .when((kind == "image/bmp") & (F.length(content) >= 26), F.abs(number(turned(at(bmp, 4)))))
        )

    return side(17, 7, 19), side(21, 9, 23)


def scan_folder(spark: SparkSession, root: str, embed_images: bool = False, threshold_kb: int = 100) -> DataFrame:
    """Frames of an image folder: each file read once, matched by name, sized by header, hashed; only kinds without a plain header are decoded."""
    files = with_header_sizes(scan_images(read_folder(spark, root)))
    return import_frames(_decoded_sizes(spark, root, files), embed_images, threshold_kb)


def scan_images(files: DataFrame, pattern: str = IMAGE_PATTERN) -> DataFrame:
    """Files whose name matches the pattern anywhere."""
    return files.where(file_name(F.col("path")).rlike(pattern))


def assign_sequences(paths: DataFrame, folders_as_sequences: bool = True) -> DataFrame:
    """Sequence, its order and the frame index of every image path.

    Paths are numbered once in (sequence, path) order; the order of a sequence is its rank
    among the distinct names, the frame index counts from the sequence's first path.
    """
    named = paths.select("path").withColumn(
        "sequence_name", sequence_name(F.col("path"), folders_as_sequences)
    )
    ranks = number_rows(named.select("sequence_name").distinct(), [F.col("sequence_name")], "sort_order", 0)
    placed = number_within(named, ["sequence_name"], [F.col("path")], "frame_index")
    return placed.join(ranks, "sequence_name")


def embeds(length: Column, embed_images: bool, threshold_kb: int) -> Column:
    return F.lit(embed_images) | (F.floor(length / 1024) < threshold_kb)


def import_frames(files: DataFrame, embed_images: bool = False, threshold_kb: int = 100) -> DataFrame:
    """Hash, size and embed decision of each file; ``files``: path, content, width, height."""
    size = F.length("content")
    return files.select(
        F.col("path").alias("relative_path"),
        F.sha2("content", 256).alias("content_hash"),
        "width",
        "height",
        size.cast("long").alias("bytes"),
        embeds(size, embed_images, threshold_kb).alias("is_embedded"),
        sniff_mime(F.col("content")).alias("mime"),
        F.lit(False).alias("reviewed"),
    )


def scan_summary(assigned: DataFrame, imported: DataFrame) -> DataFrame:
    """Sequences created, frames imported, frames embedded, errors (undecodable sizes)."""
    joined = imported.join(assigned.select(F.col("path").alias("relative_path"), "sequence_name"), "relative_path")
    failed = F.coalesce(F.col("width"), F.lit(-1)) < 0
    return joined.agg(
        F.count_distinct("sequence_name").alias("sequences_created"),
        F.count_if(~failed).alias("frames_imported"),
        F.count_if(F.col("is_embedded") & ~failed).alias("frames_embedded"),
        F.count_if(failed).alias("errors"),
    )


def resolve_image_source(frames: DataFrame, blobs: DataFrame, input_folder: str | None) -> DataFrame:
    """Where the bytes of a frame come from: embedded, referenced (with full path) or missing."""
    stored = blobs.where(F.col("embedded_data").isNotNull()).select(F.col("frame_id").alias("id"), F.lit(True).alias("_in"))
    joined = frames.select("id", "relative_path").join(stored, "id", "left")
    here = F.lit(input_folder is not None)
    referenced = F.col("relative_path").isNotNull() & here
    state = F.when(F.col("_in"), "embedded").when(referenced, "referenced").otherwise("missing")
    full = F.concat(F.lit((input_folder or "").rstrip("/") + "/"), F.col("relative_path"))
    return joined.withColumn("state", state).select(
        "id", "state", F.when(F.col("state") == "referenced", full).alias("full_path")
    )
