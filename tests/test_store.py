"""Folders on a file system that only Spark's readers and writers reach."""

import uuid

import pytest
from pyspark.sql import functions as F

from annotlake.plans.durable import qualified
from annotlake.sinks import coco as CO
from annotlake.sinks import yolo as YO
from annotlake.sinks.files import write_files
from annotlake.sources import coco as CI
from annotlake.sources import images as I
from annotlake.sources import yolo as YI


@pytest.fixture
def stores(spark, tmp_path):
    """One folder by a path that tasks can open and one by a path they can't."""
    name = f"t{uuid.uuid4().hex}"
    (tmp_path / "far").mkdir()
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{tmp_path}/far")
    return [f"file://{tmp_path}/near", f"viewfs://{name}/in"]


def test_folders_round_trip(spark, stores):
    images = spark.range(1, 6).select(F.col("id"), F.format_string("a b/é+%d.png", "id").alias("file_name"), F.lit(9).alias("width"), F.lit(7).alias("height"))
    cats = spark.createDataFrame([(1, "cat", "")], "id long, name string, supercategory string")
    anns = images.select(
        F.col("id"), F.col("id").alias("image_id"), F.lit(1).alias("category_id"), *[F.lit(2.0).alias(c) for c in CO.BOX], F.lit(4.0).alias("area"), F.lit(0).alias("iscrowd"),
        F.array(F.array(*[F.lit(float(k)) for k in range(6)])).alias("segmentation"),
    )
    keyed = images.select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("image_id"))
    lines = images.select(F.col("file_name").alias("relative_path"), F.explode(F.array(F.lit(0), F.lit(1))).alias("line_no"))
    files = lines.select(F.concat(F.regexp_replace("relative_path", "png$", "txt")).alias("file"), "line_no", F.concat(F.col("line_no").cast("string"), F.lit(" 0.5 0.5 0.1 0.1")).alias("line"))
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D494844520000000900000007"))
    got = []
    for store in stores:
        assert CO.write_coco(f"{store}/coco", CO.coco_documents(keyed, images, cats, anns)) == 2
        docs = CI.read_coco(spark, f"{store}/coco")
        coco = sorted((r["doc_id"], len(r["images"]), len(r["annotations"]), r["categories"][0]["name"], r["images"][0]["file_name"]) for r in docs.collect())
        assert YO.write_label_files(files, f"{store}/yolo") == 5
        yolo = sorted(tuple(r) for r in YI.read_label_lines(spark, f"{store}/yolo").collect())
        assert write_files(images.select(F.col("file_name").alias("path"), head.alias("content")), f"{store}/scan") == 5
        scan = sorted((r["relative_path"], r["width"], r["height"]) for r in I.scan_folder(spark, f"{store}/scan").collect())
        got.append((coco, yolo, scan))
    assert got[0] == got[1]
    assert [c[:3] for c in got[0][0]] == [("0.json", 2, 2), ("1.json", 3, 3)] and len(got[0][1]) == 10 and got[0][1][0][0] == "a b/é+1"
    assert got[0][2][0] == ("a b/é+1.png", 9, 7)


def test_paths_without_a_scheme_are_sparks(spark, tmp_path):
    assert qualified(spark, str(tmp_path)).startswith("file:/")
    one = spark.createDataFrame([("x/y.txt", "z")], "path string, content string")
    assert write_files(one, str(tmp_path)) == 1 and (tmp_path / "x" / "y.txt").read_text() == "z"
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")] == ["y.txt"]
