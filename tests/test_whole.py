"""Nothing is saturated, cut off or lost on the way."""

from pyspark.sql import functions as F

from annotlake import schema
from annotlake.operators import geometry, merge, runs
from annotlake.sources import rle


def test_many_labels_keep_their_index(spark):
    n = 300
    rows = [(1, i, 1, 0, i, i + 1) for i in range(1, n + 1)]
    index = spark.createDataFrame([(i, i) for i in range(1, n + 1)], "label_id int, label_index int")
    got = runs.combined_index_map(spark.createDataFrame(rows, schema.MASK_RUNS), index).collect()
    assert {(r["x0"], r["value"]) for r in got} == {(i, i) for i in range(1, n + 1)}


def test_empty_and_png_masks_survive_the_upgrade(spark):
    frames = spark.createDataFrame([(1, 4, 2)], "id long, width int, height int")
    full = bytes([3, 8, 0, 0, 0])
    rows = [(1, 1, "rle8", full), (1, 2, "png", b"\x89PNG"), (1, 3, "rle", bytes([8, 0, 0, 0])), (1, 4, "rle8", b"")]
    masks = spark.createDataFrame(rows, "frame_id long, label_id int, encoding string, mask_data binary")
    got = {r["label_id"]: (r["encoding"], bytes(r["mask_data"])) for r in rle.upgrade_encoding(masks, frames).collect()}
    empty = ("rle8", bytes([0, 8, 0, 0, 0]))
    assert got == {1: ("rle8", full), 2: ("png", b"\x89PNG"), 3: empty, 4: empty}
    assert [r["label_id"] for r in rle.undecoded(masks).collect()] == [2]


def test_far_points_find_their_shape(spark):
    node = "struct<x:double,y:double,in_x:double,in_y:double,out_x:double,out_y:double,smooth:boolean>"
    at = lambda x, y: (x, y, x, y, x, y, False)
    shapes = spark.createDataFrame(
        [(1, 1, False, [at(0.0, 0.0), at(10.0, 0.0)]), (2, 1, False, [at(5000.0, 0.0), at(5000.0, 9.0)])],
        f"shape_id long, frame_id long, closed boolean, nodes array<{node}>",
    )
    points = spark.createDataFrame([(1, 1, 3.0, 4.0), (2, 1, 2000.0, 0.0), (3, 1, 9000.0, 0.0), (4, 2, 0.0, 0.0)], "point_id long, frame_id long, px double, py double")
    got = {r["point_id"]: (r["shape_id"], round(r["distance"], 6)) for r in geometry.distance_to_shape(shapes, points).collect()}
    assert got == {1: (1, 4.0), 2: (1, 1990.0), 3: (2, 4000.0)}


def test_no_join_on_a_literal(spark):
    frames = spark.createDataFrame([(i, 1 if i < 3 else 2, i) for i in range(5)], "id long, sequence_id int, frame_index int")
    moved = frames.where("id >= 3").select("id", F.col("id").alias("place"))
    out = merge.move_frames(frames, moved, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r["id"], r["sequence_id"], r["frame_index"]) for r in out.collect()} >= {(3, 1, 3), (4, 1, 4)}
