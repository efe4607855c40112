"""Algebra over ``mask_runs(frame_id, label_id, value, y, x0, x1)`` with half-open runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.plans.strips import LIMIT, both, cover, laid, strip_runs
from annotlake.plans.sweep import run_ends, sweep

FRAME_LABEL = ("frame_id", "label_id")
WORD = 60


def normalize_runs(runs: DataFrame, keys: Sequence[str] = (*FRAME_LABEL, "value")) -> DataFrame:
    """Merge touching and overlapping runs that share ``keys`` and the row."""
    return strip_runs(runs, keys)


def presence(runs: DataFrame, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    """Runs of any non-zero value, per label."""
    return normalize_runs(runs.where(F.col("value") != 0), keys)


def union_presence(runs: DataFrame) -> DataFrame:
    """Pixels covered by any label of the frame."""
    return normalize_runs(runs.where(F.col("value") != 0), ["frame_id"])


def mask_area_bbox(runs: DataFrame, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    """Pixel count and inclusive box of disjoint runs."""
    return runs.groupBy(*keys).agg(
        F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"),
        F.min("x0").cast("long").alias("bbox_x"),
        F.min("y").cast("long").alias("bbox_y"),
        (F.max("x1") - F.min("x0")).cast("long").alias("bbox_w"),
        (F.max("y") - F.min("y") + 1).cast("long").alias("bbox_h"),
    )


def regions_by_instance(runs: DataFrame) -> DataFrame:
    """One region per distinct non-zero value of an instance label."""
    tidy = normalize_runs(runs.where(F.col("value") != 0))
    return mask_area_bbox(tidy, [*FRAME_LABEL, "value"])


# ── set operations ──────────────────────────────────────────────────────────


def _two_sided(left: DataFrame, right: DataFrame, keys: Sequence[str], state: Column, out: str) -> DataFrame:
    a = run_ends(left, keys, {"a": F.lit(1), "b": F.lit(0)})
    b = run_ends(right, keys, {"a": F.lit(0), "b": F.lit(1)})
    return sweep(a.unionByName(b), keys, ["a", "b"], state, out)


def difference_runs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of ``left`` not in ``right``."""
    inside = F.when((F.col("a") > 0) & (F.col("b") == 0), F.lit(1))
    return _two_sided(left, right, keys, inside, "_in").drop("_in")


def intersect_runs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels in both."""
    inside = F.when((F.col("a") > 0) & (F.col("b") > 0), F.lit(1))
    return _two_sided(left, right, keys, inside, "_in").drop("_in")


def transposed_ends(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ends of disjoint runs after rows and columns change places: keys, y (the old x), x (the old y), ``cover`` 1 or -1.

    A column begins where the row above lacks the pixel and stops where only the row above has
    it, so only the upper and lower edge of the mask become rows, never its inside.
    """
    here = F.struct(F.col("y"), F.lit(1).alias("own"), F.lit(0).alias("above"))
    below = F.struct((F.col("y") + 1).alias("y"), F.lit(0).alias("own"), F.lit(1).alias("above"))
    each = runs.select(*keys, "x0", "x1", F.explode(F.array(here, below)).alias("r")).select(*keys, "r.y", "x0", "x1", "r.own", "r.above")
    ends = run_ends(each, keys, {"own": F.col("own"), "above": F.col("above")})
    begins, stops = (F.col("own") > 0) & (F.col("above") == 0), (F.col("above") > 0) & (F.col("own") == 0)
    edge = sweep(ends, keys, ["own", "above"], F.when(begins, F.lit(1)).when(stops, F.lit(-1)), "cover")
    turned = edge.withColumn("_x", F.explode(F.sequence("x0", F.col("x1") - 1)))
    return turned.select(*keys, F.col("_x").alias("y"), F.col("y").alias("x"), F.col("cover").cast("long").alias("cover"))


def _valued_sweep(runs: DataFrame, stroke: DataFrame, state: Column) -> DataFrame:
    """Sweep a disjoint valued mask against stroke runs keyed by frame and label."""
    mask = run_ends(runs, FRAME_LABEL, {"held": F.col("value"), "stroke": F.lit(0)})
    laid = run_ends(stroke, FRAME_LABEL, {"held": F.lit(0), "stroke": F.lit(1)})
    swept = sweep(mask.unionByName(laid), FRAME_LABEL, ["held", "stroke"], state)
    return swept.withColumn("value", F.col("value").cast("int"))


def write_runs(runs: DataFrame, stroke: DataFrame, value: int) -> DataFrame:
    """Set ``value`` where the stroke covers; the rest of the mask keeps its values."""
    state = F.when(F.col("stroke") > 0, F.lit(value).cast("long")).when(F.col("held") > 0, F.col("held"))
    return _valued_sweep(runs, stroke, state)


def on_every_label(runs: DataFrame, stroke: DataFrame) -> DataFrame:
    """Repeat a frame-keyed stroke for each label the frame has."""
    labels = runs.select(*FRAME_LABEL).distinct()
    return stroke.select("frame_id", "y", "x0", "x1").join(labels, "frame_id")


def erase_runs(runs: DataFrame, stroke: DataFrame) -> DataFrame:
    """Clear the pixels a stroke keyed by frame and label covers."""
    state = F.when((F.col("stroke") == 0) & (F.col("held") > 0), F.col("held"))
    return _valued_sweep(runs, stroke, state)


def swap_label_runs(runs: DataFrame, stroke: DataFrame, active_label, value: int) -> DataFrame:
    """Stroked pixels owned by any label move to ``active_label``; background stays untouched."""
    owned = intersect_runs(stroke, runs.where(F.col("value") != 0), ["frame_id"])
    cleared = erase_runs(runs, on_every_label(runs, owned))
    gained = owned.select(
        "frame_id",
        F.lit(active_label).alias("label_id"),
        F.lit(value).cast("int").alias("value"),
        "y",
        "x0",
        "x1",
    )
    return normalize_runs(cleared.unionByName(gained)).withColumn("value", F.col("value").cast("int"))


# ── compositing ─────────────────────────────────────────────────────────────


def index_words(runs: DataFrame) -> DataFrame:
    """Add ``value`` = label index; ``runs`` must hold ``label_index``."""
    return runs.withColumn("value", F.col("label_index").cast("int"))


def combined_index_map(runs: DataFrame, label_index: DataFrame, max_index: int | None = None) -> DataFrame:
    """Per pixel the last label in order that covers it, as runs of ``value`` = label index.

    Each label index owns one bit; the running sum over run ends is then the set of labels
    at that pixel and its highest bit the answer, 60 bits a word. The number of words follows
    the largest index, which one aggregate over the label table finds unless it is given.
    """
    if max_index is None:
        max_index = label_index.agg(F.coalesce(F.max("label_index"), F.lit(0))).first()[0]
    indexed = index_words(runs.where(F.col("value") != 0).join(label_index, "label_id"))
    single = normalize_runs(indexed, ["frame_id", "value"])
    words = [f"w{i}" for i in range(max_index // WORD + 1)]
    slot, bit = F.floor(F.col("value") / WORD), F.col("value") % WORD
    measures = {
        w: F.when(slot == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).otherwise(F.lit(0))
        for i, w in enumerate(words)
    }
    ends = run_ends(single, ["frame_id"], measures)
    state = None
    for i, w in reversed(list(enumerate(words))):
        top = F.length(F.bin(F.col(w))) - 1 + i * WORD
        state = F.when(F.col(w) > 0, top) if state is None else state.when(F.col(w) > 0, top)
    swept = sweep(ends, ["frame_id"], words, state)
    return swept.withColumn("value", F.col("value").cast("int"))


def colormap_map(index_runs: DataFrame, colors: DataFrame) -> DataFrame:
    """Replace the label index of a combined map by the label's map colour."""
    looked = colors.select(F.col("label_index").alias("value"), "r", "g", "b")
    grey = F.lit(128)
    return index_runs.join(looked, "value", "left").select(
        "frame_id", "y", "x0", "x1", *[F.coalesce(c, grey).cast("int").alias(c) for c in ("r", "g", "b")]
    )


def individual_masks(runs: DataFrame, labels: DataFrame, all_ids: bool = False) -> DataFrame:
    """Exported mask per label: instance ids kept (``all_ids``: those of every label), semantic presence as 255."""
    flags = labels.select("label_id", F.col("name").alias("label_name"), F.lit(True).alias("is_instance") if all_ids else F.col("is_instance"))
    shown = runs.where(F.col("value") != 0).join(flags, "label_id").withColumn(
        "value", F.when(F.col("is_instance"), F.col("value")).otherwise(F.lit(255)).cast("int")
    )
    return normalize_runs(shown, ["frame_id", "label_name", "value"])


# ── geometry of masks ───────────────────────────────────────────────────────


def downsample_presence(runs: DataFrame, step: int, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    """A cell is set when any pixel of its ``step`` x ``step`` block is set."""
    coarse = runs.where(F.col("value") != 0).select(
        *keys,
        F.floor(F.col("y") / step).alias("y"),
        F.floor(F.col("x0") / step).alias("x0"),
        (F.floor((F.col("x1") - 1) / step) + 1).alias("x1"),
    )
    return normalize_runs(coarse, keys)


def crop_tile(runs: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Runs of a rectangle in tile coordinates; nothing outside the image appears."""
    rows = runs.where((F.col("y") >= y) & (F.col("y") < y + h) & (F.col("x1") > x) & (F.col("x0") < x + w))
    return (
        rows.withColumn("x0", F.greatest(F.col("x0"), F.lit(x)) - x)
        .withColumn("x1", F.least(F.col("x1"), F.lit(x + w)) - x)
        .withColumn("y", F.col("y") - y)
    )


def disk_rows(radius: int) -> list[tuple[int, int]]:
    """(dy, half width) of each row of a disk element."""
    return [(dy, math.isqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)]


def dilate(runs: DataFrame, frames: DataFrame, kernel: int, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    """Disk dilation of presence, radius ``kernel // 2``, clipped to the image."""
    rows = disk_rows(kernel // 2)
    grown = strip_runs(runs.where(F.col("value") != 0), keys, kernel // 2, lambda r: cover(laid(r, rows)))
    # A frame that is listed with several sizes is as wide in a row as the widest that reaches it.
    size = F.struct(F.coalesce(F.col("width").cast("long"), F.lit(LIMIT)).alias("width"), "height")
    sizes = frames.groupBy(F.col("id").alias("frame_id")).agg(F.collect_set(size).alias("_sizes"))
    room = F.array_max(F.transform(F.filter("_sizes", lambda s: F.col("y") < s["height"]), lambda s: s["width"]))
    clipped = grown.join(sizes, "frame_id").where(F.col("y") >= 0).withColumn("_room", room)
    clipped = clipped.select(*keys, "y", F.greatest(F.col("x0"), F.lit(0)).alias("x0"), F.least("x1", "_room").alias("x1"), "_room")
    return clipped.where(F.col("_room").isNotNull() & (F.col("x1") > F.col("x0"))).drop("_room")


def erode(runs: DataFrame, kernel: int, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    """Disk erosion of presence; outside the image counts as background.

    A pixel stays when each of the element's rows fits inside a run, so after narrowing the
    runs by each row's half width it must be covered once per row.
    """
    rows = [(dy, -half) for dy, half in disk_rows(kernel // 2)]
    return strip_runs(runs.where(F.col("value") != 0), keys, kernel // 2, lambda r: cover(laid(r, rows), lambda n: n == len(rows)))


def close_mask(runs: DataFrame, frames: DataFrame, kernel: int, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    """Dilate, then erode, both with ``2 * kernel`` (what the "opening" flag runs)."""
    grown = dilate(runs, frames, 2 * kernel, keys).withColumn("value", F.lit(1))
    return erode(grown, 2 * kernel, keys)


def mask_edges(runs: DataFrame, radius: int = 0, keys: Sequence[str] = ("frame_id", "value")) -> DataFrame:
    """Foreground pixels with a neighbour of another id, or on the image border.

    ``radius`` 0 looks at the four neighbours; above, at the square of that half side.
    ``runs`` hold one id per pixel (a combined map); ``keys`` name frame and id.
    """
    rows = [(-1, 0), (0, -1), (1, 0)] if radius == 0 else [(dy, -radius) for dy in range(-radius, radius + 1)]
    # The core lies within the mask, so its edge is what the two cover once.
    core = lambda r: cover(laid(r, rows), lambda n: n == len(rows))
    return strip_runs(runs, keys, max(radius, 1), lambda r: cover(both(r, core(r)), lambda n: n == 1))


def next_instance_id(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Ids for shapes about to be burnt in: largest value of the label plus position."""
    from annotlake.plans.numbering import number_within

    used = runs.groupBy(*FRAME_LABEL).agg(F.max("value").alias("used"))
    placed = number_within(shapes.select(*FRAME_LABEL, "shape_id"), FRAME_LABEL, [F.col("shape_id")], "place", 1)
    return placed.join(used, list(FRAME_LABEL), "left").select(
        *FRAME_LABEL,
        "shape_id",
        (F.coalesce(F.col("used"), F.lit(0)) + F.col("place")).cast("int").alias("instance_id"),
    )


def bake_shapes(runs: DataFrame, shape_runs: DataFrame) -> DataFrame:
    """OR rasterised shapes into the masks; labels with only shapes gain a mask."""
    cols = [*FRAME_LABEL, "y", "x0", "x1"]
    both = runs.where(F.col("value") != 0).select(*cols).unionByName(shape_runs.select(*cols))
    return normalize_runs(both, FRAME_LABEL)
