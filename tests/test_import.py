"""Imported documents laid over a project."""

import json

from pyspark.sql import functions as F

from annotlake import schema
from annotlake.formats import run_import
from annotlake.operators import merge
from annotlake.sources import coco

SHAPES = schema.SHAPES
LABELS = "id long, name string, color string, is_instance boolean, sort_order long"
MASKS = "frame_id long, label_id long, encoding string, mask_data binary"


def project(spark):
    frames = spark.createDataFrame(
        [(1, 1, 0, "a/x.png", 9, 9, False), (2, 1, 1, "b/y.png", 9, 9, False)],
        "id long, sequence_id long, frame_index long, relative_path string, width int, height int, reviewed boolean",
    )
    return {
        "labels": spark.createDataFrame([(7, "cat", "#000000", False, 0)], LABELS),
        "frames": frames,
        "shapes": spark.createDataFrame([], SHAPES),
        "annotations": spark.createDataFrame([(1, 7, "rle8", b"old")], MASKS),
        "classifications": spark.createDataFrame([(1, "kind", ["old"], True)], schema.CLASSIFICATIONS),
    }


def document(name, path):
    ring = [1, 1, 5, 1, 5, 5]
    return json.dumps(
        {
            "images": [{"id": 1, "file_name": path, "width": 9, "height": 9}],
            "categories": [{"id": 1, "name": name}],
            "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 1, 4, 4], "segmentation": [ring]}],
        }
    )


def test_two_documents_with_the_same_ids(spark, tmp_path):
    (tmp_path / "one.json").write_text(document("cat", "a/x.png"))
    (tmp_path / "two.json").write_text(document("dog", "b/y.png"))
    imported = run_import("coco", {"documents": coco.read_coco(spark, str(tmp_path))})
    p = project(spark)
    out = merge.merge_dataset(**p, imported=imported)
    shapes = out["shapes"].collect()
    assert {(r["frame_id"], r["label_id"], len(r["nodes"])) for r in shapes} == {(1, 7, 3), (2, 8, 3)}
    assert len({r["shape_id"] for r in shapes}) == 2
    assert out["counts"].first().asDict() == {"frames_matched": 2, "frames_unmatched": 0, "annotations_imported": 2, "labels_created": 1}
    again = merge.merge_dataset(**{**p, "labels": out["labels"], "shapes": out["shapes"]}, imported=imported)
    twice = again["shapes"].collect()
    assert len(twice) == 4 == len({r["shape_id"] for r in twice}) and again["labels"].count() == 2


def test_two_paths_that_meet_one_frame(spark):
    imported = {
        "labels": spark.createDataFrame([(1, "cat", "#1", False)], "label_index int, name string, color string, is_instance boolean"),
        "frames": spark.createDataFrame([("p/x.png", 0), ("q/x.png", 1), ("r/none.png", 2)], "relative_path string, pos int"),
        "masks": spark.createDataFrame([("p/x.png", 1, "rle8", b"first"), ("q/x.png", 1, "rle8", b"last")], "relative_path string, label_index int, encoding string, mask_data binary"),
        "classifications": spark.createDataFrame([("p/x.png", "kind", ["first"]), ("q/x.png", "kind", ["last"])], "relative_path string, task_name string, selected_classes array<string>"),
    }
    p = project(spark)
    out = merge.merge_dataset(**p, imported=imported)
    assert [bytes(r["mask_data"]) for r in out["annotations"].collect()] == [b"last"]
    assert [(r["selected_classes"], r["is_multilabel"]) for r in out["classifications"].collect()] == [(["last"], True)]
    assert out["counts"].first().asDict() == {"frames_matched": 2, "frames_unmatched": 1, "annotations_imported": 2, "labels_created": 0}


def test_label_sync_takes_shapes_along(spark):
    labels = spark.createDataFrame([(1, "kept", "#0", False, 0), (2, "drawn", "#0", False, 1), (3, "painted", "#0", False, 2)], LABELS)
    config = spark.createDataFrame([("kept", "#1", False, 0)], "name string, color string, is_instance boolean, sort_order long")
    masks = spark.createDataFrame([(1, 3, "rle8", b"m")], MASKS)
    shapes = spark.createDataFrame([(5, 1, 1, True, True, []), (6, 1, 2, True, True, [])], SHAPES)
    out = merge.sync_labels_everywhere(labels, config, masks, shapes)
    assert {r["id"] for r in out["labels"].collect()} == {1, 3}
    assert [r["shape_id"] for r in out["shapes"].collect()] == [5] and out["annotations"].count() == 1
    same = merge.sync_labels(labels, config.where(F.lit(False)), masks)
    assert same.count() == 3
