import math

import numpy as np
from pyspark.sql import functions as F

from annotlake import schema
from annotlake.formats import format_infos, run_export, run_import
from annotlake.functions.paths import csv_field
from annotlake.operators import catalog as C
from annotlake.operators import geometry as G
from annotlake.operators import merge as M
from annotlake.operators import pixels as X
from annotlake.operators import registration as H
from annotlake.plans.numbering import number_rows, number_within
from annotlake.sinks.csvs import write_csv
from annotlake.sources import coco, yolo
from annotlake.sources.images import assign_sequences


def test_numbering_with_one_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"), (F.lit(3000) - F.col("id")).alias("v"))
    rows = number_rows(df, [F.col("g"), F.col("v")], "n", 1).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["g"], r["v"]))] == list(range(1, 3001))
    inner = number_within(df, ["g"], [F.col("v")], "k").where("g = 0").collect()
    assert sorted(r["k"] for r in inner) == list(range(len(inner)))


def test_sequences_of_paths(spark):
    paths = spark.createDataFrame([("x.png",), ("x/a.png",), ("x/b.png",), ("d/e/c.png",), (".hidden",)], "path string")
    got = {r["path"]: (r["sequence_name"], r["sort_order"], r["frame_index"]) for r in assign_sequences(paths).collect()}
    assert got["x.png"] == ("x", 2, 0) and got["x/b.png"] == ("x", 2, 2)
    assert got["d/e/c.png"] == ("d/e", 1, 0) and got[".hidden"][0] == ".hidden"


def test_match_frames(spark):
    frames = spark.createDataFrame([(5, "a/1.png"), (7, "b/1.png"), (9, None)], "id long, relative_path string")
    got = spark.createDataFrame([("b/1.png",), ("z/1.png",), ("none.png",)], "relative_path string")
    assert {r["relative_path"]: r["frame_id"] for r in C.match_frames(got, frames).collect()} == {"b/1.png": 7, "z/1.png": 5, "none.png": None}


def test_sync_labels_keeps_used_and_numbers_new(spark):
    now = spark.createDataFrame([(1, "a", "#1", False, 0), (2, "b", "#2", False, 1), (3, "c", "#3", False, 2)], schema.LABELS)
    config = spark.createDataFrame([("new", "#9", True, 0), ("a", "#7", True, 1)], "name string, color string, is_instance boolean, sort_order int")
    used = spark.createDataFrame([(2,)], "label_id long")
    got = {(r["id"], r["name"], r["color"]) for r in M.sync_labels(now, config, used).collect()}
    assert got == {(1, "a", "#7"), (2, "b", "#2"), (4, "new", "#9")}
    assert M.sync_labels(now, config.limit(0), used).count() == 3


def test_csv_quoting(spark, tmp_path):
    rows = [("plain",), ("a,b",), ('say "x"',), ("two\nlines",), (" lead",), ("",)]
    df = spark.createDataFrame(rows, "v string")
    want = {"plain": "plain", "a,b": '"a,b"', 'say "x"': '"say ""x"""', "two\nlines": '"two\nlines"', " lead": " lead", "": ""}
    assert {r["v"]: r["q"] for r in df.select("v", csv_field(F.col("v")).alias("q")).collect()} == want
    write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert all(q in text for q in want.values())


COCO = """{"images":[{"id":3,"file_name":"a.png","width":10,"height":8},{"id":4,"file_name":"b.png","width":9,"height":7}],
"categories":[{"id":11,"name":"cell"},{"id":7,"name":"dirt"}],
"annotations":[
 {"id":1,"image_id":3,"category_id":7,"bbox":[0,0,1,1],"segmentation":[[0,0,4,0,4,4],[1,1,2,2]]},
 {"id":2,"image_id":4,"category_id":11,"bbox":[1,2,3,4]},
 {"id":3,"image_id":4,"category_id":99,"bbox":[1,2,3,4]},
 {"id":4,"image_id":8,"category_id":11,"bbox":[1,2,3,4]},
 {"id":5,"image_id":3,"category_id":11,"bbox":[5,5,1,1],"segmentation":{"counts":[1,2],"size":[8,10]}}]}"""


def test_read_coco_file(spark, tmp_path):
    (tmp_path / "x.json").write_text(COCO)
    out = run_import("coco", {"documents": coco.read_coco(spark, str(tmp_path / "x.json"))})
    labels = [(r["label_index"], r["name"], r["color"]) for r in out["labels"].orderBy("label_index").collect()]
    assert labels == [(1, "cell", "#e6194b"), (2, "dirt", "#3cb44b")]
    shapes = {(r["relative_path"], r["label_index"], r["filled"], len(r["points"])) for r in out["shapes"].collect()}
    assert shapes == {("a.png", 2, True, 3), ("b.png", 1, False, 4), ("a.png", 1, False, 4)}


def test_yolo_lines_and_names(spark):
    lines = spark.createDataFrame([("a", "0 0.5 0.5 0.2 0.4"), ("a", "1 .1 .2 .3"), ("a", "2 0 0 1 0 1 1 x"), ("a", "3 0 0 1 0 1"), ("b", "1 0 0 1 1")], "stem string, line string")
    images = spark.createDataFrame([("a", "a.png", 100, 50)], "stem string, relative_path string, width int, height int")
    got = {r["label_index"]: (r["filled"], [(round(p["x"], 6), round(p["y"], 6)) for p in r["points"]]) for r in yolo.parse_label_lines(lines, images).collect()}
    assert got == {1: (False, [(40, 15), (60, 15), (60, 35), (40, 35)]), 3: (True, [(0, 0), (100, 0), (100, 50)])}

    def names(text):
        rows = list(enumerate(text.split("\n")))
        return [r["name"] for r in yolo.read_yolo_names(spark.createDataFrame(rows, "line_no long, line string")).orderBy("label_index").collect()]

    assert names("nc: 2\nnames:\n  0: cat\n  1: 'big dog'\npath: .") == ["cat", "big dog"]
    assert names("names:\n  - a\n  - b\nnc: 2") == ["a", "b"]
    assert names("names: [x, 'y', \"z\"]\nnc: 3") == ["x", "y", "z"]


def shape(i, pts, closed=True, filled=True, bend=0.0):
    nodes = [(x, y, x - bend, y, x + bend, y, bend > 0) for x, y in pts]
    return (i, 1, 1, closed, filled, nodes)


def test_polygon_fill_and_hits(spark, frames):
    shapes = spark.createDataFrame(
        [
            shape(1, [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)]),
            shape(2, [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0), (1.0, 1.0)]),
            shape(3, [(0.0, 0.0), (8.0, 8.0), (8.0, 0.0), (0.0, 8.0)]),
        ],
        schema.SHAPES,
    )
    runs = G.rasterize_filled(shapes, frames((16, 16))).collect()
    area = {i: sum(r["x1"] - r["x0"] for r in runs if r["shape_id"] == i) for i in (1, 2, 3)}
    assert area[1] == area[2] == 9
    bow = {(r["y"], x) for r in runs if r["shape_id"] == 3 for x in range(r["x0"], r["x1"])}
    assert (3, 3) not in bow and (3, 1) in bow and (3, 6) in bow
    clicks = spark.createDataFrame([(1, 1, 2.5, 2.5), (2, 1, 15.0, 15.0)], "point_id long, frame_id long, px double, py double")
    picked = G.pick_shape(shapes.withColumn("z", F.col("shape_id")).where("shape_id < 3"), clicks, 2.0).collect()
    assert [(r["point_id"], r["shape_id"], r["body_hit"]) for r in picked] == [(1, 2, True)]


def test_homography_of_exact_pairs(spark):
    m = np.array([[1.1, 0.02, 5.0], [-0.03, 0.95, -2.0], [1e-4, 2e-4, 1.0]])
    rows = []
    for reg, pts in ((1, [(0, 0), (100, 5), (90, 80), (4, 70), (50, 40)]), (2, [(0, 0), (1, 5), (9, 8)]), (3, [(7, 7)] * 5)):
        for i, (x, y) in enumerate(pts):
            u, v, w = m @ (x, y, 1)
            rows.append((reg, i, float(u / w), float(v / w), float(x), float(y)))
    pairs = spark.createDataFrame(rows, schema.KEYPOINT_PAIRS)
    fitted = H.fit_homography(pairs)
    got = fitted.collect()
    assert [r["registration_id"] for r in got] == [1]
    assert np.allclose([got[0][f"h{i}"] for i in range(9)], m.ravel(), atol=1e-6)
    assert H.residuals(pairs, fitted).agg(F.max("error").alias("e")).first()["e"] < 1e-6
    back = H.invert_homography(H.invert_homography(fitted)).first()
    assert np.allclose([back[f"h{i}"] for i in range(9)], m.ravel(), atol=1e-9)


def test_otsu_two_levels_and_empty(spark, frames):
    rows = [(1, 0, x, v, v, v) for x, v in enumerate([40, 40, 40, 200, 200])] + [(2, 0, 0, 9, 9, 9)]
    pixels = spark.createDataFrame(rows, "frame_id long, y long, x long, r int, g int, b int")
    mask = spark.createDataFrame([(1, 0, 0, 5), (2, 3, 0, 1)], "frame_id long, y long, x0 long, x1 long")
    runs, errors = X.otsu_refine(pixels, mask, frames((5, 1), (5, 5)))
    assert [(r["frame_id"], r["x0"], r["x1"]) for r in runs.collect()] == [(1, 3, 5)]
    assert [r["frame_id"] for r in errors.collect()] == [2]


def test_identity_curve_and_lut(spark):
    curves = spark.createDataFrame([(1, "r", [(0.0, 0.0), (255.0, 255.0)]), (1, "g", [(5.0, 5.0)])], "frame_id long, channel string, nodes array<struct<x:double,y:double>>")
    table = X.curve_table(curves)
    assert all(r["v"] == r["out"] for r in table.collect()) and table.count() == 512
    plain = spark.createDataFrame([(1, "r", 0.0, 0.0, 1.0)], "frame_id long, channel string, brightness double, contrast double, gamma double")
    lut = {r["v"]: r["out"] for r in X.channel_lut(plain, table).collect()}
    c = 259 * 255 / (255 * 259)
    assert lut == {v: math.floor(min(255, max(0, c * (v - 128) + 128)) + 0.5) for v in range(256)}


def test_export_registry(spark, masks, frames):
    infos = {i["id"]: i for i in format_infos()}
    assert infos["coco"]["can_import"] and infos["masks"]["can_export"] and not infos["masks"]["can_import"]
    tables = {
        "frames": frames((20, 20)),
        "labels": spark.createDataFrame([(1, 1, "cell", "#ff0000", False)], "label_id long, label_index long, name string, color string, is_instance boolean"),
        "mask_runs": masks(["." * 20] * 2 + [".." + "1" * 8 + "." * 10] * 8 + ["." * 20] * 10),
        "shapes": spark.createDataFrame([shape(4, [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0)])], schema.SHAPES),
    }
    anns = run_export("coco", tables)["annotations"].orderBy("id").collect()
    assert [(a["id"], a["area"], len(a["segmentation"])) for a in anns] == [(1, 64.0, 1), (2, 32.0, 1)]
    bare = run_export("coco", tables, {"segmentation": False})["annotations"].collect()
    assert [(a["id"], a["segmentation"]) for a in bare] == [(1, [])]
    lines = run_export("yolo", tables, {"task": "detect"})["labels"].orderBy("line_no").collect()
    assert [r["line"] for r in lines] == ["0 0.300000 0.300000 0.400000 0.400000", "0 0.250000 0.250000 0.400000 0.400000"]
    assert set(run_export("masks", tables)) == {"individual_masks", "combined_masks", "vector"}


def test_mask_export_modes(spark, masks):
    sizes = spark.createDataFrame([(1, 1, 1, "d/f.1.png", 12, 6, True), (2, 1, 2, "g.png", 12, 6, False), (3, 1, 3, None, 12, 6, True)], schema.FRAMES)
    row = ["." * 12]
    tables = {
        "frames": sizes,
        "labels": spark.createDataFrame(
            [(1, 1, "cell", "#ff0000", False), (2, 2, "rim", "#00ff00", True)], "label_id long, label_index long, name string, color string, is_instance boolean"
        ),
        "mask_runs": masks(["....33......", *row * 5], ["2" * 12, *row * 5], ["1" * 12, *row * 5]),
        "shapes": spark.createDataFrame([(7, 1, 2, True, True, [(float(x), float(y), float(x), float(y), float(x), float(y), False) for x, y in ((0, 3), (4, 3), (4, 6), (0, 6))])], schema.SHAPES),
        "classifications": spark.createDataFrame([(1, "kind", ["a"], False), (2, "kind", ["b"], False)], schema.CLASSIFICATIONS),
        "tasks": spark.createDataFrame([("kind", ["a", "b"], False)], "name string, classes array<string>, is_multilabel boolean"),
    }
    single = run_export("masks", tables, {"instance": True, "bake": True, "colormap": True, "only_reviewed": True})
    assert set(single) == {"individual_masks", "vector"}
    assert [(r["file"], r["value"], r["y"], r["x0"], r["x1"]) for r in single["individual_masks"].collect()] == [("individual_masks/cell/d/f.1.png", 3, 0, 4, 6)]
    assert [r["file"] for r in single["vector"].collect()] == ["vector/d/f.1.json"]
    baked = run_export("masks", tables, {"bake": True, "colormap": True, "classifications": True})
    assert set(baked) == {"individual_masks", "combined_masks", "colormap", "vector", "classifications", "task_kind"}
    combined = sorted((r["file"], r["value"], r["y"], r["x0"], r["x1"]) for r in baked["combined_masks"].collect())
    assert combined == [("combined_masks/d/f.1.png", 1, 0, 4, 6), *[("combined_masks/d/f.1.png", 2, y, 0, 4) for y in (3, 4, 5)], ("combined_masks/g.png", 1, 0, 0, 12)]
    plain = {(r["file"], r["value"]) for r in run_export("masks", tables)["individual_masks"].collect()}
    assert plain == {("individual_masks/cell/d/f.1.png", 255), ("individual_masks/cell/g.png", 255)}
    assert sorted((r["image_path"], r["class_index"]) for r in baked["task_kind"].collect()) == [("d/f.1.png", 0), ("g.png", 1)]
