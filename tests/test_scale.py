"""Plans and helpers that have to hold on large tables."""

import contextlib
import io

import numpy as np
from pixels import pixel_set
from pyspark.sql import functions as F

from annotlake.operators import components as C
from annotlake.operators import geometry as G
from annotlake.operators import pixels as X
from annotlake.operators import runs as R
from annotlake.operators import skeleton as S
from annotlake.operators import thinning as T
from annotlake.plans import strips
from annotlake.plans.spread import INITIAL, WANTED, join_shares, size_for


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_lookup_tables_are_not_broadcast(spark):
    frames = spark.range(3).select(F.col("id").alias("frame_id"))
    pixels = frames.select("frame_id", *[F.lit(0).cast("long").alias(c) for c in ("y", "x")], *[F.lit(v).alias(c) for c, v in (("r", 10), ("g", 200), ("b", 90))])
    keys = frames.select("frame_id", F.explode(F.array(*[F.lit(c) for c in X.CHANNELS])).alias("channel"))
    adjusted = keys.select("*", F.lit(0.0).alias("brightness"), F.lit(0.0).alias("contrast"), F.lit(1.0).alias("gamma"))
    node = F.struct(F.lit(0.0).alias("x"), F.lit(255.0).alias("y")), F.struct(F.lit(255.0).alias("x"), F.lit(0.0).alias("y"))
    lut = X.channel_lut(adjusted, X.curve_table(keys.select("*", F.array(*node).alias("nodes"))))
    assert "BroadcastHashJoin" not in plan_of(lut)
    assert sorted((r.v, r.out) for r in lut.where("frame_id = 1 and channel = 'g'").collect()) == [(v, 255 - v) for v in range(256)]
    mapped = X.apply_lut(pixels, lut)
    assert "BroadcastHashJoin" not in plan_of(mapped)
    assert {(r.r, r.g, r.b) for r in mapped.collect()} == {(10, 200, 90)}


def test_strokes_are_measured_in_batches(spark):
    """Against every pixel's distance, with level, upright, slanted, single and outlying segments, a repeated shape and one without a place."""
    lines = {
        1: [(2.0, 3.5), (9.0, 3.5)], 2: [(4.0, -1.0), (4.0, 30.0)], 3: [(0.5, 0.5), (13.25, 9.75), (20.0, 9.75)],
        4: [(5.0, 5.0), (5.0, 5.0)], 5: [(-6.0, 2.0), (-1.5, 2.0)], 6: [(15.5, 4.0), (40.0, 4.0)], 7: [(1.0, 2.0), (float("nan"), 4.0)],
    }
    node = "x double, y double, in_x double, in_y double, out_x double, out_y double, smooth boolean"
    rows = [(k, 1, 7, False, False, [(x, y, x, y, x, y, False) for x, y in p]) for k, p in lines.items()]
    rows.append((1, 1, 7, False, False, [(x + 12.0, 3.5, x + 12.0, 3.5, x + 12.0, 3.5, False) for x in (0.0, 1.0)]))
    shapes = spark.createDataFrame(rows, f"shape_id long, frame_id long, label_id int, closed boolean, filled boolean, nodes array<struct<{node}>>")
    frames = spark.createDataFrame([(1, 16, 12)], "id long, width int, height int")
    drawn = G.rasterize_stroked(shapes, frames)
    assert "MapInArrow" in plan_of(drawn)

    def near(px, py, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        size = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / size)) if size > 0 else 0.0
        return (px - (a[0] + t * dx)) ** 2 + (py - (a[1] + t * dy)) ** 2 <= 2.25

    parts = [(k, p[i], p[i + 1]) for k, p in lines.items() if k != 7 for i in range(len(p) - 1)] + [(1, (12.0, 3.5), (13.0, 3.5))]
    wanted = {(k, y, x) for k, a, b in parts for y in range(12) for x in range(16) if near(x + 0.5, y + 0.5, a, b)}
    assert pixel_set(drawn, "shape_id") == wanted
    found = [(r.shape_id, r.y, x) for r in drawn.collect() for x in range(r.x0, r.x1)]
    assert len(found) == len(set(found)) and {r.label_id for r in drawn.collect()} == {7}


def test_rows_of_a_sweep_are_dealt_once_over_partitions_that_follow_the_input(spark, masks, tmp_path):
    (tmp_path / "part.bin").write_bytes(b"0" * 4000)
    runs = masks(["111.22", "..1..."], ["3.3.3."])
    try:
        size_for(spark, str(tmp_path), 100)
        tidy = R.normalize_runs(runs)
        assert "REPARTITION_BY_NUM" in plan_of(tidy) and plan_of(tidy).count("Exchange") == 1
        assert tidy.rdd.getNumPartitions() == 40
        size_for(spark, str(tmp_path))
        assert R.normalize_runs(runs).rdd.getNumPartitions() == 8
    finally:
        spark.conf.unset(WANTED)
    assert pixel_set(tidy, "frame_id", "value") == {
        (1, 1, 0, 0), (1, 1, 0, 1), (1, 1, 0, 2), (1, 2, 0, 4), (1, 2, 0, 5), (1, 1, 1, 2), (2, 3, 0, 0), (2, 3, 0, 2), (2, 3, 0, 4)
    }


def test_covers_of_strips_are_those_of_pixels(spark):
    """Random masks over several strips, a row with very many runs, a key without a value, a frame listed twice with two sizes."""
    rng = np.random.default_rng(5)
    rows = [(int(f), None if l == 3 else int(l), 1, int(y), int(x), int(x + n)) for f, l, y, x, n in zip(*(rng.integers(0, m, 900) for m in (2, 4, 150, 40, 12)))]
    rows += [(7, 1, 1, 64, i % 50, i % 50 + 3) for i in range(3 * strips.MOST)]
    runs = spark.createDataFrame(rows, "frame_id long, label_id int, value int, y long, x0 int, x1 int").coalesce(2)
    frames = spark.createDataFrame([(0, 30, 140), (0, 45, 70), (1, 48, 129), (7, 60, 66)], "id long, width int, height int")
    held = {(f, l, y, x) for f, l, _, y, a, b in rows for x in range(a, b)}
    disk = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4]
    sizes = {0: [(30, 140), (45, 70)], 1: [(48, 129)], 7: [(60, 66)]}
    grown = {(f, l, y + dy, x + dx) for f, l, y, x in held for dy, dx in disk if any(0 <= y + dy < h and 0 <= x + dx < w for w, h in sizes[f])}
    close = {p for p in {(f, l, y + dy, x + dx) for f, l, y, x in grown for dy, dx in disk} if all((*p[:2], p[2] + dy, p[3] + dx) in grown for dy, dx in disk)}
    square = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    edge = {p for p in held if any((*p[:2], p[2] + dy, p[3] + dx) not in held for dy, dx in square)}
    keys = ["frame_id", "label_id"]
    for made, wanted in ((R.normalize_runs(runs, keys), held), (R.dilate(runs, frames, 4), grown), (R.close_mask(runs, frames, 2), close), (R.mask_edges(runs, 1, keys), edge)):
        assert "Window" not in plan_of(made)
        found = [(r.frame_id, r.label_id, r.y, x) for r in made.collect() for x in range(r.x0, r.x1)]
        assert len(found) == len(set(found)) and set(found) == wanted


def test_shuffles_begin_with_partitions_that_follow_the_input(spark, tmp_path):
    (tmp_path / "part.bin").write_bytes(b"0" * 4000)
    try:
        size_for(spark, str(tmp_path), 100)
        assert ", 40), ENSURE" in plan_of(spark.range(9).selectExpr("id % 3 as k").groupBy("k").count())
    finally:
        spark.conf.unset(WANTED)
        spark.conf.unset(INITIAL)


def test_outlines_of_batches_are_those_of_joins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(f), 1, 1, int(y), int(x), int(x + n)) for f, y, x, n in zip(*(rng.integers(a, b, 700) for a, b in ((0, 4), (0, 40), (0, 60), (1, 9))))]
    ring = [(9, 1, 1, y, *p) for y in range(12) for p in ([(2, 30)] if y in (0, 11) else [(2, 4), (28, 30)])]  # a hole
    runs = spark.createDataFrame(rows + ring, "frame_id long, label_id int, value int, y long, x0 long, x1 long")
    parts = C.value_components(runs).localCheckpoint()
    keys = ["frame_id", "label_id", "value", "component"]
    drawn = lambda: {(*[r[k] for k in keys], tuple((p.x, p.y) for p in r.points)) for r in S.component_outlines(parts, keys).collect()}
    batches = drawn()
    monkeypatch.setattr(S, "SMALL", 0)
    assert len(batches) > 20 and batches == drawn()
    monkeypatch.setattr(S, "SMALL", 20)
    assert batches == drawn()
    monkeypatch.undo()
    monkeypatch.setattr(S, "component_borders", None)  # small components need no joins
    assert batches == drawn()


def test_rows_of_one_label_are_dealt_over_all_partitions(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 < 8, 7).when(F.col("id") % 10 == 8, 9).alias("label_id"), F.array("id").alias("points"))
    labels = spark.createDataFrame([(7, 1), (9, 2), (9, 3), (11, 4)], "label_id int, label_index int")
    wanted = sorted((r.id, i) for r in rows.collect() for l, i in ((7, 1), (9, 2), (9, 3)) if l == r.label_id)
    assert sorted((r.id, r.label_index) for r in join_shares(rows, labels, "label_id").collect()) == wanted
    outer = join_shares(rows, labels, "label_id", "left")
    assert outer.count() == len(wanted) + 400 and outer.columns == ["label_id", "id", "points", "label_index"]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        runs = rows.select(F.col("id").alias("frame_id"), "label_id", F.lit(1).alias("value"))
        met = join_shares(runs, labels, "label_id")
        share = [r["count"] for r in met.where("label_id = 7").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(share) > 2 and max(share) < 2000  # a join by the label alone leaves all 3,200 to one task


def test_components_of_strips_are_those_of_pixels(spark):
    """Random masks over several strips, a ring and a comb across them, keys without a value, both connectivities."""
    rng = np.random.default_rng(11)
    rows = {(int(f), None if f == 3 else 1, int(y), int(x)) for f, y, x in zip(*(rng.integers(0, m, 6000) for m in (4, 200, 30)))}
    rows |= {(8, 1, y, x) for y in range(140) for x in range(21) if x % 4 == 0 or y in (0, 139)}
    rows |= {(9, 1, y, x) for y in range(60, 70) for x in (0, 2, 4)} | {(9, 1, 70, x) for x in range(5)}
    pixels = spark.createDataFrame(sorted(rows, key=str), "frame_id long, label_id int, y long, x long")
    keys = ["frame_id", "label_id"]
    runs = R.normalize_runs(pixels.select(*keys, "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1")), keys).localCheckpoint()
    for connectivity, near in ((8, [(-1, -1), (-1, 0), (-1, 1), (0, -1)]), (4, [(-1, 0), (0, -1)])):
        root = {p: p for p in rows if p[1] is not None}

        def top(p):
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        for f, l, y, x in list(root):
            for dy, dx in near:
                if (f, l, y + dy, x + dx) in root:
                    a, b = sorted((top((f, l, y, x)), top((f, l, y + dy, x + dx))))
                    root[b] = a
        found = C.components_of(runs, keys, connectivity).collect()
        assert len(found) == runs.count() and sum(r.x1 - r.x0 for r in found) == len(rows)
        for r in found:
            want = (r.y, r.x0) if r.label_id is None else top((r.frame_id, r.label_id, r.y, r.x0))[2:]
            assert r.component == want[0] * 2**32 + want[1]


def test_skeletons_of_batches_are_those_of_tiles(spark, monkeypatch):
    """Noise, a wide bar over many words, thick blocks over several strips, a key without a value, a run without a row."""
    rng = np.random.default_rng(3)
    rows = [(int(f), None if f == 3 else 1, int(y), int(x), int(x + n)) for f, y, x, n in zip(*(rng.integers(a, b, 900) for a, b in ((0, 4), (0, 90), (0, 140), (1, 12))))]
    rows += [(5, 1, y, 30, 5000) for y in range(7)] + [(6, 1, y, 40 + y // 3, 95 + y // 2) for y in range(200)]
    rows += [(6, 2, y, x, x + 1) for y in range(150) for x in range(0, 400, 3)] + [(7, 1, None, 3, 9), (7, 1, 4, 3, 9)]
    runs = spark.createDataFrame(rows, "frame_id long, label_id int, y long, x0 long, x1 long")
    keys = ["frame_id", "label_id"]
    tidy = R.normalize_runs(runs.where("y is not null"), keys).unionByName(runs.where("y is null")).localCheckpoint()
    found = lambda: sorted((*[str(r[k]) for k in keys], r.y, r.x, r.crossings, r.kind) for r in S.skeleton_nodes(S.thin_words(tidy, keys), keys).collect())
    monkeypatch.setattr(T, "AREA", 300)  # the bar goes by tiles, and so does the key of many runs
    mixed = found()
    assert {r[0] for r in mixed} == {"0", "1", "2", "3", "5", "6", "7"}
    monkeypatch.setattr(T, "SMALL", 60)
    assert mixed == found()
    monkeypatch.undo()
    assert mixed == found()
    monkeypatch.setattr(S, "thin_tiles", None)  # none of these needs an exchange of rims but the key of many runs
    tidy = tidy.where("not (frame_id = 6 and label_id = 2)")
    assert [r for r in mixed if r[:2] != ("6", "2")] == found()


def test_erasing_components_makes_their_runs_once(spark, masks, tmp_path):
    def marked(parts):
        import uuid

        (tmp_path / uuid.uuid4().hex).touch()
        yield from parts

    runs = masks(["11.22.3", "1...2.3", "......."]).coalesce(1)
    runs = runs.mapInArrow(marked, runs.schema)
    stroke = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 0, 7)], "frame_id long, y long, x0 long, x1 long")
    left = C.erase_touched_components(runs, stroke, across_labels=True)
    assert pixel_set(left, "value") == {(2, 0, 3), (2, 0, 4), (2, 1, 4), (3, 0, 6), (3, 1, 6)}
    assert len(list(tmp_path.iterdir())) == 1
