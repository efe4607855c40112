"""Pixel statistics over ``pixels(frame_id, y, x, r, g, b)``; filter to a region first."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotlake.functions.color import luma709, rgb_to_lab, with_delta_e
from annotlake.operators.components import components_at, components_of, largest_component
from annotlake.operators.runs import close_mask, normalize_runs
from annotlake.plans.overlap import cell_of, with_cells

CHANNELS = ("r", "g", "b", "luma")


def round_half_up(x: Column) -> Column:
    """Rounding that takes halves upwards, also below zero."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def region(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    return pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


# ── histograms ──────────────────────────────────────────────────────────────


def channel_histogram(pixels: DataFrame) -> DataFrame:
    """Counts per frame, channel and value; luma with integer weights.

    At most 4 x 256 groups a frame, combined before the shuffle.
    """
    values = F.array(
        *[
            F.struct(F.lit(name).alias("channel"), value.cast("int").alias("v"))
            for name, value in (
                ("r", F.col("r")), ("g", F.col("g")), ("b", F.col("b")),
                ("luma", luma709(F.col("r"), F.col("g"), F.col("b"))),
            )
        ]
    )
    listed = pixels.select("frame_id", F.inline(values))
    return listed.groupBy("frame_id", "channel", "v").agg(F.count(F.lit(1)).alias("n"))


def _cumulative(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add cum and total; a group has at most 256 rows."""
    by = Window.partitionBy(*keys)
    upto = by.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(by))


def hist_percentile(hist: DataFrame, p: float, keys: Sequence[str] = ("frame_id", "channel")) -> DataFrame:
    """Smallest value whose cumulative count reaches ``p`` of the total, else 255.

    With p = 0 every count reaches it, so the answer is 0 whether or not value 0 occurs.
    """
    reached = _cumulative(hist, keys).where(F.col("cum") >= F.col("total") * F.lit(float(p)))
    found = reached.groupBy(*keys).agg(F.min("v").alias("value"))
    return found.withColumn("value", F.lit(0)) if p <= 0 else found


def auto_stretch(hist: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Brightness and contrast sliders that spread [low, high] over the range, within +-100."""
    keys = ["frame_id", "channel"]
    ends = _cumulative(hist, keys)
    lo = F.min(F.when(F.col("cum") >= F.col("total") * F.lit(low), F.col("v"))).alias("lo")
    hi = F.min(F.when(F.col("cum") >= F.col("total") * F.lit(high), F.col("v"))).alias("hi")
    found = ends.groupBy(*keys).agg(lo, hi)
    flat = F.col("hi") <= F.col("lo")
    gain = F.lit(255.0) / F.when(flat, F.lit(1)).otherwise(F.col("hi") - F.col("lo"))
    slider = (F.lit(255.0) * (gain * 259.0 - 259.0)) / (gain * 259.0 + 255.0)
    shift = (F.lit(128.0) - (F.col("lo") + F.col("hi")) / F.lit(2.0)) / 2.55
    return found.select(
        *keys,
        "lo",
        "hi",
        F.when(flat, F.lit(0.0)).otherwise(clamp(shift, -100.0, 100.0)).alias("brightness"),
        F.when(flat, F.lit(0.0)).otherwise(clamp(slider, -100.0, 100.0)).alias("contrast"),
    )


STOPS = (0, 85, 170, 255)


def equalize_curve(hist: DataFrame) -> DataFrame:
    """Curve nodes at 0, 85, 170, 255 from the cumulative histogram, as an array of x, y."""
    keys = ["frame_id", "channel"]
    counted = hist.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("v") <= s, F.col("n")).otherwise(0)).alias(f"c{s}") for s in STOPS],
        F.min_by("n", "v").alias("first"),
        F.sum("n").alias("total"),
    )
    span = F.greatest(F.lit(1), F.col("total") - F.col("first"))
    node = lambda s: F.struct(
        F.lit(float(s)).alias("x"),
        clamp(round_half_up((F.col(f"c{s}") - F.col("first")) / span * 255), 0, 255).cast("double").alias("y"),
    )
    return counted.select(*keys, F.array(*[node(s) for s in STOPS]).alias("nodes"))


# ── lookup tables ───────────────────────────────────────────────────────────


def with_tangents(curves: DataFrame) -> DataFrame:
    """Add ``m``: monotone cubic tangents (Fritsch and Carlson 1980) of ``nodes``.

    Nodes are sorted; a repeated x moves one to the right. Tangents are settled segment by
    segment, each seeing what the one before left, which is a fold over the short node list.
    """
    at = F.element_at
    step = lambda acc, p: F.concat(
        acc,
        F.array(
            F.struct(
                F.when((F.size(acc) > 0) & (p["x"] <= F.try_element_at(acc, F.lit(-1))["x"]), F.try_element_at(acc, F.lit(-1))["x"] + 1)
                .otherwise(p["x"])
                .alias("x"),
                p["y"].alias("y"),
            )
        ),
    )
    empty = F.expr("cast(array() as array<struct<x:double,y:double>>)")
    tidy = curves.withColumn("nodes", F.aggregate(F.array_sort("nodes"), empty, step))
    n = F.size("nodes")
    inner = F.sequence(F.lit(1), n - 1)
    slopes = F.transform(
        inner,
        lambda i: (at("nodes", i + 1)["y"] - at("nodes", i)["y"]) / (at("nodes", i + 1)["x"] - at("nodes", i)["x"]),
    )
    with_d = tidy.withColumn("d", slopes)
    first = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(i == 1, at("d", F.lit(1)))
        .when(i == n, at("d", n - 1))
        .when(F.try_element_at("d", F.greatest(i - 1, F.lit(1))) * F.try_element_at("d", F.least(i, n - 1)) <= 0, F.lit(0.0))
        .otherwise((F.try_element_at("d", F.greatest(i - 1, F.lit(1))) + F.try_element_at("d", F.least(i, n - 1))) / 2.0),
    )

    # A zero slope must not be divided by: a null keeps the branch not taken quiet.
    def settle(m: Column, i: Column) -> Column:
        d = at("d", i)
        quiet = F.when(d == 0, F.lit(None).cast("double")).otherwise(d)
        a, b = at(m, i) / quiet, at(m, i + 1) / quiet
        s = a * a + b * b
        t = F.lit(3.0) / F.sqrt(F.when(s > 9, s).otherwise(F.lit(9.0)))
        left = F.when(d == 0, F.lit(0.0)).when(s > 9, t * a * d).otherwise(at(m, i))
        right = F.when(d == 0, F.lit(0.0)).when(s > 9, t * b * d).otherwise(at(m, i + 1))
        return F.transform(m, lambda v, k: F.when(k == i - 1, left).when(k == i, right).otherwise(v))

    return with_d.withColumn("m", first).withColumn("m", F.aggregate(inner, F.col("m"), settle))


def curve_table(curves: DataFrame) -> DataFrame:
    """Curve value at every integer 0..255; ``curves`` carries ``nodes`` array<struct<x,y>>.

    Fewer than two nodes mean the identity.
    """
    keys = [c for c in curves.columns if c != "nodes"]
    many = with_tangents(curves.where(F.size("nodes") >= 2))
    at, n = F.element_at, F.size("nodes")
    pieces = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(
            at("nodes", i)["x"].alias("x0"), at("nodes", i)["y"].alias("y0"), at("m", i).alias("m0"),
            at("nodes", i + 1)["x"].alias("x1"), at("nodes", i + 1)["y"].alias("y1"), at("m", i + 1).alias("m1"),
            (i == 1).alias("first"), (i == n - 1).alias("last"),
        ),
    )
    segment = many.select(*keys, F.inline(pieces))
    # A value belongs to the segment whose right end it has not passed.
    low = F.when(F.col("first"), F.lit(0)).otherwise(F.greatest(F.floor("x0") + 1, F.lit(0)))
    high = F.when(F.col("last"), F.lit(255)).otherwise(F.least(F.floor("x1"), F.lit(255)))
    spread = segment.where(low <= high).withColumn("v", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    timed = spread.withColumn("h", F.col("x1") - F.col("x0")).withColumn("t", (F.col("v") - F.col("x0")) / F.col("h"))
    t = F.col("t")
    shaped = timed.withColumn("t2", t * t).withColumn("t3", t * t * t)
    t2, t3 = F.col("t2"), F.col("t3")
    y = (
        (t3 * 2.0 - t2 * 3.0 + 1.0) * F.col("y0")
        + (t3 - t2 * 2.0 + t) * F.col("h") * F.col("m0")
        + (t2 * 3.0 - t3 * 2.0) * F.col("y1")
        + (t3 - t2) * F.col("h") * F.col("m1")
    )
    value = F.when(t <= 0, F.col("y0")).when(t >= 1, F.col("y1")).otherwise(y)
    drawn = shaped.select(*keys, "v", clamp(round_half_up(value), 0, 255).cast("int").alias("out"))
    few = curves.where(F.size("nodes") < 2).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return drawn.unionByName(few.withColumn("out", F.col("v")))


def channel_lut(adjustments: DataFrame, curve: DataFrame) -> DataFrame:
    """Lookup table of each (frame, channel): brightness, contrast, gamma, then the curve.

    ``adjustments``: frame_id, channel, brightness, contrast, gamma; ``curve``: a curve table.
    Both sides hold 256 rows a channel that Spark's size estimate doesn't see, so they are
    merged by key and never broadcast.
    """
    keys = ["frame_id", "channel"]
    spread = adjustments.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255))))
    gain = ((F.col("contrast") + 255.0) * 259.0) / ((F.lit(259.0) - F.col("contrast")) * 255.0)
    value = gain * (F.col("v") + F.col("brightness") * 2.55 - 128.0) + 128.0
    value = clamp(value, 0.0, 255.0)
    value = F.pow(value / 255.0, F.lit(1.0) / F.greatest(F.lit(0.01), F.col("gamma"))) * 255.0
    bent = spread.select(*keys, "v", clamp(round_half_up(clamp(value, 0.0, 255.0)), 0, 255).cast("int").alias("mid"))
    looked = curve.select(*keys, F.col("v").alias("mid"), "out")
    return bent.join(looked.hint("merge"), [*keys, "mid"]).select(*keys, "v", "out")


def lut_arrays(lut: DataFrame) -> DataFrame:
    """One row per frame with a 256-entry array per channel (bounded: 4 x 256 values)."""
    listed = lut.groupBy("frame_id", "channel").agg(F.array_sort(F.collect_list(F.struct("v", "out"))).alias("t"))
    return listed.groupBy("frame_id").agg(
        *[
            F.max(F.when(F.col("channel") == c, F.transform("t", lambda e: e["out"]))).alias(f"lut_{c}")
            for c in CHANNELS
        ]
    )


def apply_lut(pixels: DataFrame, lut: DataFrame) -> DataFrame:
    """Map r, g, b through their tables and the luma table on top; alpha is not touched.

    Tables meet pixels by key: 4 KB a frame, or the pixels, are too much for a broadcast.
    """
    joined = pixels.join(lut_arrays(lut).hint("merge"), "frame_id")

    def mapped(c: str) -> Column:
        own = F.element_at(f"lut_{c}", F.col(c).cast("int") + 1)
        return F.coalesce(F.element_at("lut_luma", own + 1), own).cast("int").alias(c)

    return joined.select("frame_id", "y", "x", mapped("r"), mapped("g"), mapped("b"))


# ── intensities ─────────────────────────────────────────────────────────────


def mean_intensity(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_id").agg(F.avg((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("mean_intensity"))


def masked_pixels(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels inside the mask runs of their frame. Runs stay runs: a pixel meets the disjoint runs of its row's cell only."""
    runs = normalize_runs(mask, ["frame_id"]).select(F.col("frame_id"), F.col("y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    pieces = with_cells(runs, F.col("_x0"), F.col("_x1") - 1, name="_cell")
    met = pixels.withColumn("_cell", cell_of(F.col("x"))).join(pieces, ["frame_id", "y", "_cell"])
    return met.where((F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x1"))).select(*pixels.columns)


def otsu_threshold(values: DataFrame) -> DataFrame:
    """Threshold of the largest between-class variance per frame, the smallest on ties.

    ``values``: frame_id, v (0..255), n; at most 256 rows a frame reach the window.
    """
    hist = values.groupBy("frame_id", "v").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("frame_id")
    upto = by.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = (
        hist.withColumn("total", F.sum("n").over(by))
        .withColumn("weight", F.sum("n").over(upto))
        .withColumn("all_v", F.sum(F.col("v") * F.col("n")).over(by))
        .withColumn("low_v", F.sum(F.col("v") * F.col("n")).over(upto))
    )
    rest = F.col("total") - F.col("weight")
    # n^2 times the variance, in exact integers up to the division: equal splits compare equal.
    gap = F.col("all_v") * F.col("weight") - F.col("low_v") * F.col("total")
    scored = sums.withColumn(
        "variance", F.when(rest > 0, gap.cast("double") * gap.cast("double") / (F.col("weight").cast("double") * rest.cast("double")))
    )
    best = scored.groupBy("frame_id").agg(
        F.max(F.struct(F.coalesce("variance", F.lit(0.0)).alias("variance"), (-F.col("v")).alias("down"))).alias("b")
    )
    return best.select(
        "frame_id", F.when(F.col("b.variance") > 0, -F.col("b.down")).otherwise(F.lit(0)).cast("int").alias("threshold")
    )


def otsu_gray(pixels: DataFrame) -> Column:
    """Gray value thresholding works on: Rec. 709 weights in ten-thousandths, rounded down."""
    return F.floor((F.col("r") * 2126 + F.col("g") * 7152 + F.col("b") * 722) / 10000)


def otsu_refine(
    pixels: DataFrame,
    mask: DataFrame,
    frames: DataFrame,
    inverse: bool = False,
    opening: bool = False,
    kernel: int = 3,
    connected: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Mask pixels above the frame's threshold as runs, and the frames that have none to judge.

    ``opening`` closes holes with twice the kernel, ``connected`` keeps the largest component.
    """
    gray = otsu_gray(pixels)
    value = F.lit(255) - gray if inverse else gray
    inside = masked_pixels(pixels, mask).select("frame_id", "y", "x", value.cast("int").alias("v"))
    limits = otsu_threshold(inside.withColumn("n", F.lit(1)))
    kept = inside.join(limits, "frame_id").where(F.col("v") > F.col("threshold"))
    keys = ["frame_id"]
    runs = normalize_runs(kept.select("frame_id", "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1")), keys)
    if opening:
        runs = close_mask(runs.withColumn("value", F.lit(1)), frames, kernel, keys)
    if connected:
        runs = largest_component(components_of(runs, keys), keys).drop("component")
    empty = mask.select("frame_id").distinct().join(limits, "frame_id", "left_anti").withColumn(
        "error", F.lit("no pixels under the mask")
    )
    return runs, empty


# ── colour ──────────────────────────────────────────────────────────────────


def with_lab(pixels: DataFrame) -> DataFrame:
    """Add l, a, lab_b, computed once per pixel whatever is later filtered on them."""
    lab = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumn("_lab", F.explode(F.array(lab))).select(*pixels.columns, "_lab.l", "_lab.a", F.col("_lab.b").alias("lab_b"))


# The lightness weight of the difference is 1 + 0.015 d^2 / sqrt(20 + d^2) for a mean lightness d away from 50; this is its largest value, at 0 and 100.
LIGHTNESS_WEIGHT = 1 + 0.015 * 50**2 / math.sqrt(20 + 50**2)
LIGHTNESS_CELL = 4


def color_fill(pixels: DataFrame, seeds: DataFrame, tolerance: float) -> DataFrame:
    """Runs 8-connected to each seed whose colour differs from the seed's by at most ``tolerance``.

    ``seeds``: frame_id, seed_id, x, y. Filtering by colour and taking the component under the
    seed gives the set a flood fill reaches; the seed itself differs by 0.

    Each distinct colour of a frame is compared once. A difference is at least the difference in
    lightness over ``LIGHTNESS_WEIGHT`` (what the other terms add is never negative), so seeds meet
    only colours in cells of lightness within reach; pixels then meet the seeds their colour suits.
    """
    rgb = ["r", "g", "b"]
    colours = with_lab(pixels.select("frame_id", *rgb).distinct())
    wide = F.lit(tolerance * LIGHTNESS_WEIGHT + 1e-3)
    at = pixels.join(seeds, ["frame_id", "y", "x"]).select("frame_id", "seed_id", *rgb)
    origin = with_lab(at).select("frame_id", "seed_id", F.col("l").alias("l1"), F.col("a").alias("a1"), F.col("lab_b").alias("b1"))
    origin = with_cells(origin, F.col("l1") - wide, F.col("l1") + wide, LIGHTNESS_CELL)
    targets = colours.select("frame_id", *rgb, F.col("l").alias("l2"), F.col("a").alias("a2"), F.col("lab_b").alias("b2"), cell_of(F.col("l"), LIGHTNESS_CELL).alias("cell"))
    pairs = targets.join(origin, ["frame_id", "cell"])
    suits = with_delta_e(pairs).where(F.round("delta_e", 6) <= tolerance).select("frame_id", "seed_id", *rgb)
    alike = pixels.join(suits, ["frame_id", *rgb])
    keys = ["frame_id", "seed_id"]
    runs = normalize_runs(
        alike.select(*keys, "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1")), keys
    )
    parts = components_of(runs, keys)
    chosen = components_at(parts, seeds, keys).select(*keys, "component").distinct()
    return parts.join(chosen, [*keys, "component"], "left_semi").drop("component")


# ── scaling ─────────────────────────────────────────────────────────────────


def downsample_pixels(pixels: DataFrame, frames: DataFrame, max_dim: int) -> DataFrame:
    """Overview whose longest side is at most ``max_dim``; smaller frames stay as they are.

    Box averages over whole blocks of the smallest integer step that fits.
    """
    step = F.greatest(F.lit(1), F.ceil(F.greatest("width", "height") / max_dim)).cast("int")
    sizes = frames.select(F.col("id").alias("frame_id"), step.alias("step"))
    blocks = pixels.join(sizes, "frame_id").groupBy(
        "frame_id", F.floor(F.col("y") / F.col("step")).alias("y"), F.floor(F.col("x") / F.col("step")).alias("x")
    )
    return blocks.agg(*[round_half_up(F.avg(c)).cast("int").alias(c) for c in ("r", "g", "b")])


def pyramid_levels(frames: DataFrame, max_levels: int = 8, min_side: int = 16, level_side: int = 4096) -> DataFrame:
    """Level sizes of each frame's pyramid: native, then halves until a side is under ``min_side``,
    a level's longest side is at most ``level_side`` or ``max_levels`` exist."""
    spread = frames.where((F.col("width") > 0) & (F.col("height") > 0)).select(
        F.col("id").alias("frame_id"), "width", "height", F.explode(F.sequence(F.lit(0), F.lit(max_levels - 1))).alias("level")
    )
    shrink = lambda side, k: F.floor(F.col(side) / F.pow(F.lit(2.0), k)).cast("int")
    w, h = shrink("width", F.col("level")), shrink("height", F.col("level"))
    before = F.greatest(shrink("width", F.col("level") - 1), shrink("height", F.col("level") - 1))
    # Level 1 is always tried; later ones only while the level before is still large.
    wanted = (F.col("level") == 0) | (
        (F.least(w, h) >= min_side) & ((F.col("level") == 1) | (before > level_side))
    )
    return spread.where(wanted).select(
        "frame_id", "level", w.alias("width"), h.alias("height"), F.pow(F.lit(0.5), F.col("level")).alias("scale")
    )
