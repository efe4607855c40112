import random
import struct

from pixels import pixel_set
from pyspark.sql import functions as F

from annotlake.operators import components as P
from annotlake.operators import runs as R
from annotlake.sources import rle


def to_bytes(picture):
    return [int(c) if c != "." else 0 for line in picture for c in line]


def encode8(values):
    out, i = b"", 0
    while i < len(values):
        j = i
        while j < len(values) and values[j] == values[i]:
            j += 1
        out += bytes([values[i]]) + struct.pack("<I", j - i)
        i = j
    return out


VALUE_CASES = [
    [".111", "..1."],
    ["..1..", "1...1"],
    ["7777", "7777", "7777"],
    ["11", "2."],
    [".1.1.1"],
    ["1", ".", ".", "1"],
]


def test_value_encoding_round_trip(masks, frames):
    runs = masks(*VALUE_CASES)
    sizes = frames(*[(len(p[0]), len(p)) for p in VALUE_CASES])
    stored = rle.write_runs_rle8(runs, sizes)
    got = {r["frame_id"]: bytes(r["mask_data"]) for r in stored.collect()}
    assert got == {i: encode8(to_bytes(p)) for i, p in enumerate(VALUE_CASES, 1)}
    back = pixel_set(rle.read_runs_rle8(stored, sizes), "frame_id", "value")
    assert back == pixel_set(runs, "frame_id", "value")


def test_binary_encoding_round_trip(masks, frames):
    cases = [["1.", ".."], [".1.1.", "1.1.1", ".1.1.", "1.1.1"], [".1.1.1"], ["1", ".", ".", "1"], ["2222", "2222"]]
    runs, sizes = masks(*cases), frames(*[(len(p[0]), len(p)) for p in cases])
    stored = rle.write_runs_rle(runs, sizes)
    first = {r["frame_id"]: bytes(r["mask_data"])[:4] for r in stored.collect()}
    assert first[1] == b"\0\0\0\0" and first[2] == struct.pack("<I", 1)
    back = rle.read_runs_rle(stored, sizes)
    assert pixel_set(back, "frame_id") == pixel_set(runs, "frame_id")
    assert {r["value"] for r in back.collect()} == {1}


def test_overlong_and_torn_records(spark, frames):
    rows = [(1, 1, "rle8", bytes([5]) + struct.pack("<I", 1000)), (2, 1, "rle8", bytes([5, 4, 0, 0, 0, 9, 1]))]
    stored = spark.createDataFrame([(*r, None) for r in rows], "frame_id long, label_id long, encoding string, mask_data binary, t timestamp")
    got = pixel_set(rle.read_runs_rle8(stored, frames((2, 2), (2, 2))), "frame_id", "value")
    assert got == {(f, 5, y, x) for f in (1, 2) for y in (0, 1) for x in (0, 1)}


def test_crop(masks):
    runs = masks(["12", "34"])
    assert pixel_set(R.crop_tile(runs, 0, 0, 2, 2), "value") == {(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1)}
    assert pixel_set(R.crop_tile(runs, 1, 1, 2, 2), "value") == {(4, 0, 0)}
    assert pixel_set(R.crop_tile(runs, 5, 5, 2, 2), "value") == set()


def spiral(n):
    grid = [["."] * n for _ in range(n)]
    y = x = 0
    dy, dx = 0, 1
    lo, hi_y, hi_x = 0, n - 1, n - 1
    top, bottom, left, right = 0, n - 1, 0, n - 1
    while top <= bottom and left <= right:
        for x in range(max(left - 2, 0), right + 1):
            grid[top][x] = "1"
        for y in range(top, bottom + 1):
            grid[y][right] = "1"
        for x in range(left, right + 1):
            grid[bottom][x] = "1"
        for y in range(top + 2, bottom + 1):
            grid[y][left] = "1"
        top, bottom, left, right = top + 2, bottom - 2, left + 2, right - 2
    return ["".join(r) for r in grid]


def flood(cells):
    """Component (smallest y, x) of each cell, 8-connected."""
    left, out = set(cells), {}
    while left:
        group, stack = [], [left.pop()]
        while stack:
            y, x = stack.pop()
            group.append((y, x))
            for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    stack.append(q)
        for c in group:
            out[c] = min(group)
    return out


def test_components_of_long_and_odd_shapes(masks):
    comb = ["1" * 101] + ["1." * 50 + "1"] * 3
    shapes = [["1.", ".1"], ["1.1", "1.1", "111"], spiral(65), comb, ["12"]]
    runs = masks(*shapes)
    parts = P.connected_components(runs)
    assert {r["frame_id"]: r["n"] for r in parts.groupBy("frame_id").agg(F.count_distinct("component").alias("n")).collect()} == {
        1: 1, 2: 1, 3: len(set(flood({(y, x) for y, l in enumerate(spiral(65)) for x, c in enumerate(l) if c == "1"}).values())), 4: 1, 5: 1,
    }
    by_value = P.value_components(runs).where("frame_id = 5")
    assert by_value.select("component").distinct().count() == 2


def test_components_against_flood(masks):
    rng = random.Random(7)
    pictures = [["".join(rng.choice("..1") for _ in range(70)) for _ in range(40)] for _ in range(3)]
    got = P.connected_components(masks(*pictures)).collect()
    for i, picture in enumerate(pictures, 1):
        want = flood({(y, x) for y, l in enumerate(picture) for x, c in enumerate(l) if c == "1"})
        have = {(r["y"], x): (r["component"] >> 32, r["component"] & 0xFFFFFFFF) for r in got if r["frame_id"] == i for x in range(r["x0"], r["x1"])}
        assert have == want


def test_morphology_properties(masks, frames):
    rng = random.Random(3)
    picture = ["".join(rng.choice(".11") for _ in range(40)) for _ in range(30)]
    runs, sizes = masks(picture), frames((40, 30))
    base = pixel_set(runs)
    grown, shrunk = pixel_set(R.dilate(runs, sizes, 3)), pixel_set(R.erode(runs, 3))
    cross = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    assert grown == {(y + a, x + b) for y, x in base for a, b in cross if 0 <= y + a < 30 and 0 <= x + b < 40}
    assert shrunk == {p for p in base if all((p[0] + a, p[1] + b) in base for a, b in cross)}
    other = masks(["1" * 20 + "." * 20] * 30)
    union = pixel_set(R.normalize_runs(runs.unionByName(other), ["frame_id"]))
    both = pixel_set(R.intersect_runs(runs, other, ["frame_id"]))
    assert len(union) + len(both) == len(base) + 600


def test_largest_component_tie_takes_the_last(masks):
    parts = P.connected_components(masks(["11..", "....", "..11"]))
    assert pixel_set(P.largest_component(parts)) == {(2, 2), (2, 3)}


def test_index_map_with_many_labels(spark, masks):
    rows = [(1, i, 1, 0, i % 7, i % 7 + 3) for i in range(1, 301)]
    runs = spark.createDataFrame(rows, "frame_id long, label_id long, value int, y long, x0 long, x1 long")
    index = spark.createDataFrame([(i, i) for i in range(1, 301)], "label_id long, label_index long")
    want = {}
    for i in range(1, 301):
        for x in range(i % 7, i % 7 + 3):
            want[x] = i
    got = {x: r["value"] for r in R.combined_index_map(runs, index).collect() for x in range(r["x0"], r["x1"])}
    assert got == want


def test_strokes_are_runs_solved_per_row(spark):
    from annotlake import schema
    from annotlake.operators import geometry as G

    rng = random.Random(8)
    shapes, want, radius = [], {}, 2.5
    for k in range(40):
        n = 1 if k == 0 else rng.randrange(1, 5)
        nodes = [(rng.randrange(-12, 100) / 2, rng.randrange(-8, 80) / 2) for _ in range(n)]
        if k % 7 == 3:
            nodes.append(nodes[0])
        shapes.append((k, 1, 5, False, False, [(x, y, x, y, x, y, False) for x, y in nodes]))
        hit = set()
        for (x1, y1), (x2, y2) in zip(nodes, nodes[1:] if n > 1 or len(nodes) > 1 else nodes, strict=False):
            size = (x2 - x1) ** 2 + (y2 - y1) ** 2
            for py in range(30):
                for px in range(40):
                    t = max(0.0, min(1.0, ((px + 0.5 - x1) * (x2 - x1) + (py + 0.5 - y1) * (y2 - y1)) / size)) if size else 0.0
                    if (px + 0.5 - x1 - t * (x2 - x1)) ** 2 + (py + 0.5 - y1 - t * (y2 - y1)) ** 2 <= radius * radius:
                        hit.add((py, px))
        want[k] = hit
    frames_ = spark.createDataFrame([(1, 1, 1, "a.png", 40, 30, False), (2, 1, 2, "b.png", 20_000, 10_000, False)], schema.FRAMES)
    table = spark.createDataFrame(shapes, schema.SHAPES)
    edged = {r["shape_id"] for r in G.outline_edges(table).select("shape_id").distinct().collect()}
    got = {}
    for k, y, x in pixel_set(G.rasterize_stroked(table, frames_, radius), "shape_id"):
        got.setdefault(k, set()).add((y, x))
    assert len(edged) >= 25
    assert {k: got.get(k, set()) for k in edged} == {k: want[k] for k in edged}
    long = spark.createDataFrame([(1, 2, 5, False, False, [(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False), (2e4, 1e4, 2e4, 1e4, 2e4, 1e4, False)])], schema.SHAPES)
    runs = G.rasterize_stroked(long, frames_)
    assert runs.groupBy("y").count().agg(F.max("count"), F.count("*")).first()[:] == (1, 10_000)
    assert runs.agg(F.max(F.col("x1") - F.col("x0"))).first()[0] <= 9


def test_column_encoding_of_a_large_image_in_edge_rows(spark):
    """Work follows the edge of a mask, not its area."""
    from annotlake import schema

    side = 6000
    runs = spark.range(side - 200).selectExpr("1L as frame_id", "1L as label_id", "1 as value", "id + 100 as y", "50L as x0", f"{side - 50}L as x1")
    holes = runs.where("y between 1000 and 1100").selectExpr("frame_id", "label_id", "value", "y", "700L as x0", "900L as x1")
    runs = R.difference_runs(runs, holes, ["frame_id", "label_id", "value"])
    size = spark.createDataFrame([(1, 1, 1, "a.png", side, side, False)], schema.FRAMES)
    edge = R.transposed_ends(runs, ["frame_id", "label_id"])
    assert edge.count() == 2 * (side - 100) + 2 * 200
    stored = rle.write_runs_rle(runs, size)
    counts = struct.unpack(f"<{stored.selectExpr('length(mask_data) div 4').first()[0]}I", bytes(stored.first()["mask_data"]))
    assert sum(counts) == side * side and sum(counts[1::2]) == (side - 200) * (side - 100) - 101 * 200
    back = rle.read_runs_rle(stored, size)
    assert back.select("y", "x0", "x1").exceptAll(runs.select("y", "x0", "x1")).isEmpty() and back.count() == runs.count()


def test_masks_are_read_once_and_keep_their_runs(spark, frames):
    """Mixed encodings, split and overlong records, masks that come in two rows, empty and null ones."""
    rng = random.Random(3)
    size, rows, want = (13, 9), [], set()
    for f in range(1, 40):
        flat = [rng.choice((0, 0, 1, 1, 1, 7)) for _ in range(13 * 9)]
        kind = ("rle8", "rle", "mask", None)[f % 4]
        counts, at = [], 0
        upright = flat if kind == "rle8" else [int(v > 0) for v in flat]
        while at < len(flat):
            n = next((i for i in range(at, len(flat)) if upright[i] != upright[at]), len(flat)) - at
            counts += [(upright[at], 1), (upright[at], n - 1)] if kind == "rle8" and n > 1 else [(upright[at], n)]
            at += n
        if kind == "rle8":
            data = b"".join(struct.pack("<BI", *c) for c in counts) + b"\2"
            want |= {(f, v, p // 13, p % 13) for p, v in enumerate(flat) if v}
        else:
            data = b"".join(struct.pack("<I", n) for n in ([0] if counts[0][0] else []) + [n for _, n in counts])
            want |= {(f, 1, p % 9, p // 9) for p, v in enumerate(upright) if v}
        rows.append((f, 1, kind, data))
    rows += [(40, 1, "rle", struct.pack("<II", 2, 3)), (40, 1, "rle", struct.pack("<II", 1, 4)), (41, 1, "rle8", b""), (42, 1, "rle", None), (43, 1, "png", b"x")]
    want |= {(40, 1, p % 9, p // 9) for p in range(3, 10)}  # record by record
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(part.num_rows)
            yield part

    kinds = "frame_id long, label_id long, encoding string, mask_data binary"
    masks, sizes = spark.createDataFrame(rows, kinds).mapInArrow(counted, kinds), frames(*[size] * 43)
    assert pixel_set(rle.decode_any(masks, sizes), "frame_id", "value") == want
    assert read.value == len(rows)
    upgraded = rle.upgrade_encoding(masks, sizes).collect()
    assert read.value == 2 * len(rows)
    back = spark.createDataFrame(upgraded, kinds)
    assert pixel_set(rle.read_runs_rle8(back, sizes), "frame_id", "value") == want
    assert {r["encoding"] for r in upgraded if r["frame_id"] != 43} == {"rle8"}


def test_masks_of_frames_that_come_twice(masks, frames):
    """A frame that comes twice counts every value twice, as before; a mask over a seam of batches stays one."""
    runs, sizes = masks(["12.", ".1."]), frames((3, 2))
    got = rle.write_runs_rle8(runs, sizes.unionByName(sizes)).first()["mask_data"]
    assert bytes(got) == encode8([2, 4, 0, 0, 2, 0])
    spark = runs.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        wide = masks(["1.2.3.1.2.3"] * 3, ["1"], [".1"])
        stored = rle.write_runs_rle8(wide, frames((11, 3), (1, 1), (2, 1)))
        assert pixel_set(rle.read_runs_rle8(stored, frames((11, 3), (1, 1), (2, 1))), "frame_id", "value") == pixel_set(wide, "frame_id", "value")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
