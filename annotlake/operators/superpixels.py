"""SLIC superpixels and selections over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.functions.color import with_delta_e
from annotlake.operators.components import components_of
from annotlake.operators.pixels import with_lab
from annotlake.operators.runs import normalize_runs
from annotlake.plans.durable import cut
from annotlake.plans.graph import star_components
from annotlake.plans.numbering import number_within
from annotlake.plans.spread import spread

COMPACTNESS, PASSES = 10.0, 10
# Passes between lineage cuts: a pass reads the centres twice, so the plan doubles with each.
PASSES_PER_CUT = 2


def _grid(frames: DataFrame, target: int) -> DataFrame:
    """frame_id, width, height and the seed grid: step s, columns, rows, cell sizes."""
    sized = frames.select(F.col("id").alias("frame_id"), "width", "height")
    step = F.greatest(F.sqrt(F.col("width") * F.col("height") / F.lit(float(max(target, 1)))), F.lit(1.0))
    count = lambda side: F.greatest(F.floor(F.col(side) / F.col("s") + 0.5), F.lit(1))
    return (
        sized.withColumn("s", step)
        .withColumns({"cols": count("width"), "rows": count("height")})
        .withColumns({"cell_w": F.col("width") / F.col("cols"), "cell_h": F.col("height") / F.col("rows")})
    )


def slic_labels(pixels: DataFrame, frames: DataFrame, target: int) -> DataFrame:
    """Grid cluster of every pixel after ten passes: frame_id, y, x, l, a, lab_b, ci.

    A pixel meets one row holding the up to nine centres around its grid cell, so a pass is
    one join on (frame, cell) and one combined average; cells bound the groups, not frames.
    """
    grid = _grid(frames, target)
    placed = with_lab(pixels).select("frame_id", "y", "x", "l", "a", "lab_b").join(grid, "frame_id")
    located = cut(
        spread(
            placed.withColumns(
                {"gc": F.floor(F.col("x") / F.col("cell_w")), "gr": F.floor(F.col("y") / F.col("cell_h"))}
            ),
            "frame_id",
            "gr",
            "gc",
        )
    )
    cells = grid.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1))
    )
    middle = cells.select(
        "frame_id", "r", "c", (F.col("r") * F.col("cols") + F.col("c")).alias("ci"),
        ((F.col("c") + 0.5) * F.col("cell_w")).alias("cx"), ((F.col("r") + 0.5) * F.col("cell_h")).alias("cy"), "width", "height",
    )
    at = middle.withColumns(
        {"x": F.least(F.floor("cx"), F.col("width") - 1), "y": F.least(F.floor("cy"), F.col("height") - 1)}
    )
    lab = located.select("frame_id", "y", "x", F.col("l").alias("cl"), F.col("a").alias("ca"), F.col("lab_b").alias("cb"))
    slim = ["frame_id", "r", "c", "ci", "cl", "ca", "cb", "cx", "cy"]
    centres = at.join(lab, ["frame_id", "y", "x"]).select(*slim)
    for done in range(1, PASSES):
        labelled = _assign(located, centres)
        means = labelled.groupBy("frame_id", "ci").agg(
            *[F.avg(c).alias(n) for c, n in (("l", "nl"), ("a", "na"), ("lab_b", "nb"), ("x", "nx"), ("y", "ny"))]
        )
        moved = centres.join(means, ["frame_id", "ci"], "left")
        names = zip(("cl", "ca", "cb", "cx", "cy"), ("nl", "na", "nb", "nx", "ny"))
        centres = moved.select("frame_id", "r", "c", "ci", *[F.coalesce(n, c).alias(c) for c, n in names])
        if done % PASSES_PER_CUT == 0:
            centres = cut(centres)
    return _assign(located, centres).select("frame_id", "y", "x", "l", "a", "lab_b", "ci")


def _assign(located: DataFrame, centres: DataFrame) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    shown = centres.withColumn("_d", F.explode(steps)).select(
        "frame_id", (F.col("r") + F.col("_d.dr")).alias("gr"), (F.col("c") + F.col("_d.dc")).alias("gc"),
        F.struct("ci", "cl", "ca", "cb", "cx", "cy").alias("centre"),
    )
    nine = shown.groupBy("frame_id", "gr", "gc").agg(F.array_sort(F.collect_list("centre")).alias("centres"))
    weight = F.pow(F.lit(COMPACTNESS) / F.col("s"), F.lit(2.0))
    square = lambda v: v * v
    scored = F.transform(
        "centres",
        lambda c: F.struct(
            (
                square(F.col("l") - c["cl"]) + square(F.col("a") - c["ca"]) + square(F.col("lab_b") - c["cb"])
                + (square(F.col("x") - c["cx"]) + square(F.col("y") - c["cy"])) * weight
            ).alias("d"),
            c["ci"].alias("ci"),
        ),
    )
    return located.join(nine, ["frame_id", "gr", "gc"]).withColumn("ci", F.array_min(scored)["ci"]).drop("centres")


def slic_segments(pixels: DataFrame, frames: DataFrame, target: int) -> DataFrame:
    """Superpixel of every pixel: frame_id, y, x, l, a, lab_b, sp_id, ids from 0 in raster order.

    Clusters are cut into 4-connected parts. A part of at most a quarter of the nominal size
    joins the part beside its first pixel that a raster scan reaches earlier: of left, right,
    up and down the last one that starts before it. A small first part of a frame joins the
    first large one.
    """
    labelled = cut(slic_labels(pixels, frames, target))
    keys = ["frame_id", "ci"]
    runs = normalize_runs(labelled.select(*keys, "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1")), keys)
    parts = components_of(runs, keys, connectivity=4)
    part_px = cut(
        parts.select("frame_id", "component", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    )
    limits = frames.select(
        F.col("id").alias("frame_id"),
        F.greatest(F.floor(F.floor(F.col("width") * F.col("height") / max(target, 1)) / 4), F.lit(1)).alias("limit"),
    )
    sizes = part_px.groupBy("frame_id", "component").agg(F.count(F.lit(1)).alias("size"))
    marked = sizes.join(limits, "frame_id").withColumn("large", F.col("size") > F.col("limit"))
    # Neighbours of each small part's first pixel, in the order left, right, up, down.
    small = marked.where("not large").select("frame_id", "component")
    step = 1 << 32
    origin = small.select(
        "frame_id",
        "component",
        F.posexplode(
            F.array(
                *[
                    F.struct((F.floor(F.col("component") / step) + dy).alias("y"), (F.col("component") % step + dx).alias("x"))
                    for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))
                ]
            )
        ).alias("turn", "p"),
    ).select("frame_id", "component", "turn", F.col("p.y").alias("y"), F.col("p.x").alias("x"))
    beside = part_px.select("frame_id", "y", "x", F.col("component").alias("other"))
    chosen = (
        origin.join(beside, ["frame_id", "y", "x"])
        .where("other < component")
        .groupBy("frame_id", "component")
        .agg(F.max_by("other", "turn").alias("parent"))
    )
    first_large = marked.where("large").groupBy("frame_id").agg(F.min("component").alias("first_large"))
    # Every small part hangs on an earlier part, so following parents ends at a large part or
    # at the frame's small first part, which stands for the first large one.
    links = chosen.select("frame_id", F.col("component").alias("u"), F.col("parent").alias("v"))
    tops = star_components_by_parent(links)
    resolved = (
        marked.select("frame_id", "component", "large")
        .join(tops.withColumnRenamed("u", "component"), ["frame_id", "component"], "left")
        .withColumn("top", F.coalesce("root", "component"))
        .join(first_large, "frame_id", "left")
    )
    large_of = marked.select("frame_id", F.col("component").alias("top"), F.col("large").alias("_top_large"))
    settled = resolved.join(large_of, ["frame_id", "top"]).select(
        "frame_id",
        "component",
        F.when(F.col("_top_large"), F.col("top")).otherwise(F.coalesce("first_large", F.col("top"))).alias("home"),
    )
    ids = number_within(settled.select("frame_id", "home").distinct(), ["frame_id"], [F.col("home")], "sp_id")
    named = settled.join(ids, ["frame_id", "home"]).select("frame_id", "component", "sp_id")
    return part_px.join(named, ["frame_id", "component"]).join(
        labelled.drop("ci"), ["frame_id", "y", "x"]
    ).select("frame_id", "y", "x", "l", "a", "lab_b", "sp_id")


def star_components_by_parent(links: DataFrame) -> DataFrame:
    """frame_id, u, root: the end of each chain of parents.

    Only small parts have a parent, and each has one, so the links form trees whose smallest
    member is their end: exactly what components by smallest vertex return.
    """
    return star_components(links, ["frame_id"])


def superpixel_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("frame_id", "sp_id").agg(
        F.avg("l").alias("l"), F.avg("a").alias("a"), F.avg("lab_b").alias("lab_b"), F.count(F.lit(1)).alias("size")
    )


def _beside(segments: DataFrame) -> DataFrame:
    """Each pixel with the superpixel to its right and below it, by meeting on the pixel."""
    slim = segments.select("frame_id", "y", "x", "sp_id")
    roles = F.explode(
        F.array(
            F.struct(F.col("y").alias("y"), F.col("x").alias("x"), F.lit(0).alias("role")),
            F.struct(F.col("y").alias("y"), (F.col("x") - 1).alias("x"), F.lit(1).alias("role")),
            F.struct((F.col("y") - 1).alias("y"), F.col("x").alias("x"), F.lit(2).alias("role")),
        )
    )
    sent = slim.select("frame_id", "sp_id", roles.alias("p"))
    pick = lambda role: F.max(F.when(F.col("p.role") == role, F.col("sp_id")))
    return (
        sent.groupBy("frame_id", F.col("p.y").alias("y"), F.col("p.x").alias("x"))
        .agg(pick(0).alias("sp_id"), pick(1).alias("right"), pick(2).alias("below"))
        .where(F.col("sp_id").isNotNull())
    )


def superpixel_adjacency(segments: DataFrame) -> DataFrame:
    """Distinct neighbouring pairs (a, b), both ways."""
    near = _beside(segments)
    pairs = near.select("frame_id", F.col("sp_id").alias("a"), F.explode(F.array("right", "below")).alias("b"))
    one_way = pairs.where("b is not null and a <> b").select("frame_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return one_way.unionByName(one_way.select("frame_id", F.col("b").alias("a"), F.col("a").alias("b")))


def superpixel_edges(segments: DataFrame) -> DataFrame:
    """Pixels whose right or lower neighbour belongs to another superpixel."""
    near = _beside(segments)
    differs = lambda c: F.coalesce(F.col(c) != F.col("sp_id"), F.lit(False))
    return near.where(differs("right") | differs("below")).select("frame_id", "y", "x")


def _close(stats: DataFrame, dominant: DataFrame, threshold: float) -> DataFrame:
    pairs = stats.select("frame_id", "sp_id", F.col("l").alias("l1"), F.col("a").alias("a1"), F.col("lab_b").alias("b1")).join(dominant, "frame_id")
    return with_delta_e(pairs).where(F.round("delta_e", 6) < threshold).select("frame_id", "sp_id")


def superpixel_select(
    segments: DataFrame, stroke: DataFrame, threshold: float = 10.0, fraction: float = 0.5
) -> DataFrame:
    """Superpixels a stroke selects: ``stroke`` has frame_id, y, x.

    Seeds are covered by at least ``fraction`` and close to the colour under the stroke; the
    selection is every close superpixel connected to a seed through close ones. A stroke
    without a seed selects the close superpixels it touches.
    """
    stats = superpixel_stats(segments)
    covered = (
        segments.join(stroke.select("frame_id", "y", "x").distinct(), ["frame_id", "y", "x"])
        .groupBy("frame_id", "sp_id")
        .agg(F.count(F.lit(1)).alias("overlap"))
    )
    touched = stats.join(covered, ["frame_id", "sp_id"])
    weigh = lambda c, n: (F.sum(F.col("overlap") * F.col(c)) / F.sum("overlap")).alias(n)
    dominant = touched.groupBy("frame_id").agg(weigh("l", "l2"), weigh("a", "a2"), weigh("lab_b", "b2"))
    close = cut(_close(stats, dominant, threshold))
    near = touched.join(close, ["frame_id", "sp_id"])
    seeds = near.where(F.col("overlap") / F.greatest("size", F.lit(1)) >= fraction).select("frame_id", "sp_id")
    edges = superpixel_adjacency(segments).where("a < b")
    for side in ("a", "b"):
        edges = edges.join(close.withColumnRenamed("sp_id", side), ["frame_id", side], "left_semi")
    roots = star_components(edges.select("frame_id", F.col("a").alias("u"), F.col("b").alias("v")), ["frame_id"])
    islands = close.join(roots.withColumnRenamed("u", "sp_id"), ["frame_id", "sp_id"], "left").withColumn(
        "root", F.coalesce("root", "sp_id")
    )
    wanted = islands.join(seeds, ["frame_id", "sp_id"], "left_semi").select("frame_id", "root").distinct()
    grown = islands.join(wanted, ["frame_id", "root"], "left_semi").select("frame_id", "sp_id")
    seeded = seeds.select("frame_id").distinct()
    light = near.join(seeded, "frame_id", "left_anti").select("frame_id", "sp_id")
    return grown.unionByName(light)


def selected_pixels(segments: DataFrame, selection: DataFrame) -> DataFrame:
    return segments.join(selection, ["frame_id", "sp_id"], "left_semi").select("frame_id", "y", "x")
