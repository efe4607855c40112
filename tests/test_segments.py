"""YOLO segment lines of mask regions against plain Python."""

import math

import __spark_entry__ as entry
from annotlake import schema
from annotlake.fixtures import Tables
from annotlake.formats import run_export

W, H = 32, 16


def groups(cells):
    """8-connected groups of pixels (x, y)."""
    left, out = set(cells), []
    while left:
        stack, group = [left.pop()], set()
        while stack:
            x, y = stack.pop()
            group.add((x, y))
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            stack += near
        out.append(group)
    return out


def place(cells):
    x, y = min(cells, key=lambda p: (p[1], p[0]))
    return (y << 32) + x


def points_of(line, w, h):
    numbers = [float(v) for v in line.split()[1:]]
    return [(round(x * w, 2), round(y * h, 2)) for x, y in zip(numbers[::2], numbers[1::2], strict=True)]


def outside_sides(cells):
    return {(x, y) for x, y in cells if {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} - cells}


def box(x0, y0, x1, y1):
    return {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}


def test_segment_export_holds_every_region(spark):
    # (frame, label, value) -> boxes; label 1 is semantic, label 2 by instance.
    drawn = {
        (1, 1, 1): [box(1, 1, 5, 6), box(20, 2, 24, 9)],
        (1, 1, 2): [box(6, 3, 9, 6)],
        (1, 2, 1): [box(1, 10, 6, 14), box(12, 10, 15, 14)],
        (1, 2, 2): [box(7, 10, 10, 14)],
        (2, 1, 0): [box(1, 1, 9, 9)],
        (2, 1, 3): [box(2, 2, 9, 2)],
    }
    runs = [(f, l, v, y, min(x for x, _ in b), max(x for x, _ in b) + 1) for (f, l, v), bs in drawn.items() for b in bs for y in sorted({y for _, y in b})]
    nodes = [(x, y, x, y, x, y, False) for x, y in ((3.0, 3.0), (9.0, 3.0), (9.0, 12.0))]
    t = {
        "frames": spark.createDataFrame([(1, 1, 1, "a.png", W, H, False), (2, 1, 2, "b.png", W, H, False)], schema.FRAMES),
        "labels": spark.createDataFrame([(1, 1, "s", "#000000", False), (2, 2, "i", "#000000", True)], "label_id long, label_index int, name string, color string, is_instance boolean"),
        "mask_runs": spark.createDataFrame(runs, schema.MASK_RUNS),
        "shapes": spark.createDataFrame([(7, 1, 2, True, True, nodes)], schema.SHAPES),
    }
    got = sorted((r["line"].split()[0], sorted(set(points_of(r["line"], W, H)))) for r in run_export("yolo", t)["labels"].collect() if r["file"] == "a.txt")
    corners = lambda cells: sorted({(float(f(x for x, _ in cells)), float(g(y for _, y in cells))) for f in (min, max) for g in (min, max)})
    want = [("0", corners(box(20, 2, 24, 9)))]
    want += [("1", corners(b)) for b in (box(1, 10, 6, 14), box(12, 10, 15, 14), box(7, 10, 10, 14))]
    want += [("1", [(3.0, 3.0), (9.0, 3.0), (9.0, 12.0)])]
    joined = box(1, 1, 5, 6) | box(6, 3, 9, 6)
    rest = [g for g in got if g not in want]
    assert len(got) == 6 and all(w in got for w in want)
    assert rest[0][0] == "0" and {(1.0, 1.0), (1.0, 6.0), (9.0, 6.0)} <= set(rest[0][1]) <= {(float(x), float(y)) for x, y in outside_sides(joined)}


def test_segment_query_against_plain_regions(spark):
    """Class, part, ring and border pixels of every region of the whole table; shape lines as in the checked query."""
    folder = "/root/testdata/sf0.001"
    t = Tables(spark, folder)
    labels = {r["id"]: (k, r["is_instance"]) for k, r in enumerate(t.label_defs.orderBy("sort_order").collect(), 1)}
    paths = {r["id"]: r["relative_path"] or f"frame_{r['id']}" for r in t.frames.collect()}
    masks = {}
    for r in t.mask_runs_raw.collect():
        if r["label_id"] in labels and r["frame_id"] in paths and r["value"]:
            value = r["value"] if labels[r["label_id"]][1] else None
            masks.setdefault((r["frame_id"], r["label_id"], value), set()).update((x, r["y"]) for x in range(r["x0"], r["x1"]))
    want = {}
    for (frame, label, value), cells in masks.items():
        for group in groups(cells):
            if len({y for _, y in group}) > 1:
                key = (paths[frame], labels[label][0], place(group) if value is None else value, place(group))
                want[key] = outside_sides(group)
    lines = entry.queries()["yolo_segment_all_lines"](spark, folder).collect()
    regions = [r for r in lines if r["kind"] == 0]
    keys = [(r["relative_path"], r["label_index"], r["part"], r["ring"]) for r in regions]
    assert len(keys) == len(set(keys)) and set(keys) <= set(want) and len(keys) > 100
    for key, r in zip(keys, regions, strict=True):
        assert r["line"].split()[0] == str(key[1] - 1)
        points = points_of(r["line"], 256, 128)
        assert len(points) >= 3 and set(points) <= {(float(x), float(y)) for x, y in want[key]}
    for key in set(want) - set(keys):  # a ring whose simplified border has fewer than three points is no polygon
        border = want[key]
        xs, ys = [x for x, _ in border], [y for _, y in border]
        assert min(max(xs) - min(xs), max(ys) - min(ys)) <= 3 or len(border) < math.hypot(max(xs) - min(xs), max(ys) - min(ys)) * 3
    shapes = sorted((r["relative_path"], r["part"], r["line"]) for r in lines if r["kind"] == 1)
    assert shapes == sorted(map(tuple, entry.queries()["yolo_shape_lines"](spark, folder).collect()))
