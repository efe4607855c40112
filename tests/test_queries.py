"""Registered queries against their check SQL, and the shape of their plans."""

import os

import pytest
from check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01" if os.environ.get("ANNOTLAKE_ALL_QUERIES") else "/root/testdata/sf0.001"
CHECKED = entry.oracle_sql()
SAMPLE = [
    "gallery_listing", "frame_neighbours", "label_tree", "match_frames", "upsert_latest", "sync_labels", "replace_pairs",
    "constraint_report", "normalize_runs", "swap_label_runs", "combined_index_map", "close_mask", "component_at_seed",
    "coco_annotations", "yolo_label_files", "write_runs_rle8", "decode_any", "pick_shape", "curve_table", "otsu_threshold",
    "color_fill", "dlt_normal_matrix", "superpixel_select", "stream_latest_edits", "stream_review_progress",
]
NAMES = sorted(CHECKED) if os.environ.get("ANNOTLAKE_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    message, _ = compare(spark, FOLDER, duck, name, entry.queries()[name], CHECKED[name])
    assert message is None, message


def test_every_query_is_registered_once():
    assert set(CHECKED) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.parametrize("name", ["gallery_listing", "match_frames", "combined_index_map", "rasterize_filled", "channel_lut", "otsu_threshold"])
def test_plan_stays_in_the_jvm_without_products(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "MapInPandas", "BatchEvalPython"):
        assert word not in plan, word


def test_filters_and_columns_reach_the_scan(spark):
    from annotlake.fixtures import Tables
    from annotlake.operators.catalog import review_progress

    plan = review_progress(Tables(spark, FOLDER).frames)._jdf.queryExecution().executedPlan().toString()
    assert "s_name" not in plan.split("ReadSchema: ")[1]
