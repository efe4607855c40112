"""Connected components of run masks and what is done with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotlake.operators.runs import (
    FRAME_LABEL,
    downsample_presence,
    mask_area_bbox,
    normalize_runs,
    on_every_label,
    presence,
    union_presence,
)
from annotlake.plans.durable import cut
from annotlake.plans.graph import star_components
from annotlake.plans.overlap import cell_of, overlap_join, with_cells
from annotlake.plans.spread import join_shares
from annotlake.plans.strips import STRIP, strip_parts


def _contacts(runs: DataFrame, keys: Sequence[str], connectivity: int) -> DataFrame:
    """Pairs of parts that touch where two strips of rows meet; a diagonal counts under 8-connectivity."""
    reach = 1 if connectivity == 8 else 0
    at = lambda y: runs.where(F.pmod(y, F.lit(STRIP)) == 0)
    upper = at(F.col("y") + 1).select(
        *keys, (F.col("y") + 1).alias("y"), F.col("part").alias("v"),
        F.greatest(F.col("x0") - reach, F.lit(0)).alias("a0"), (F.col("x1") - 1 + reach).alias("a1"),
    )
    lower = at(F.col("y")).select(
        *keys, "y", F.col("part").alias("u"), F.col("x0").alias("b0"), (F.col("x1") - 1).alias("b1")
    )
    return overlap_join(upper, lower, [*keys, "y"], ("a0", "a1"), ("b0", "b1")).select(*keys, "u", "v")


def components_of(runs: DataFrame, keys: Sequence[str], connectivity: int = 8) -> DataFrame:
    """Add ``component`` to disjoint maximal runs: the place of its first pixel in raster order.

    The place is y * 2^32 + x, so components order as a raster scan meets them. Inside strips of
    rows runs are joined in batches; only the parts that touch where strips meet make a graph.
    The runs are read three times below, so what made them is run once and cut off.
    """
    placed = cut(strip_parts(runs, keys, 1 if connectivity == 8 else 0))
    roots = star_components(_contacts(placed, keys, connectivity), keys).withColumnRenamed("u", "part")
    return (
        placed.join(roots, [*keys, "part"], "left")
        .withColumn("component", F.coalesce("root", "part"))
        .drop("part", "root")
    )


def connected_components(runs: DataFrame, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    """8-connected components of presence (semantic labels)."""
    return components_of(presence(runs, keys), keys)


def value_components(runs: DataFrame, keys: Sequence[str] = (*FRAME_LABEL, "value")) -> DataFrame:
    """8-connected components in which only equal values touch."""
    return components_of(normalize_runs(runs.where(F.col("value") != 0), keys), keys)


def component_regions(components: DataFrame, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    return mask_area_bbox(components, [*keys, "component"])


def components_at(components: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Component ids under seed pixels: ``seeds`` has keys, y, x (and may carry more columns)."""
    known = [c for c in keys if c in seeds.columns]
    cells = with_cells(components, F.col("x0"), F.col("x1") - 1)
    placed = seeds.withColumn("cell", cell_of(F.col("x")))
    hit = placed.join(cells, [*known, "y", "cell"]).where((F.col("x0") <= F.col("x")) & (F.col("x") < F.col("x1")))
    carried = [c for c in seeds.columns if c not in ("x", "y") and c not in keys]
    return hit.select(*keys, "component", *carried)


def component_at_seed(runs: DataFrame, seeds: DataFrame, by_value: bool = True) -> DataFrame:
    """Runs of the component that holds each seed; nothing for a seed on background."""
    keys = [*FRAME_LABEL, "value"] if by_value else list(FRAME_LABEL)
    parts = value_components(runs) if by_value else connected_components(runs)
    chosen = components_at(parts, seeds, keys)
    return parts.join(chosen, [*keys, "component"])


def clear_component(runs: DataFrame, seeds: DataFrame, by_value: bool = True) -> DataFrame:
    """The mask without the components under the seeds."""
    if by_value:
        keys = [*FRAME_LABEL, "value"]
        parts = value_components(runs)
        chosen = components_at(parts, seeds, keys).select(*keys, "component").distinct()
        return parts.join(chosen, [*keys, "component"], "left_anti").drop("component")
    parts = connected_components(runs)
    chosen = components_at(parts, seeds, FRAME_LABEL).select(*FRAME_LABEL, "component").distinct()
    gone = parts.join(chosen, [*FRAME_LABEL, "component"], "left_semi")
    from annotlake.operators.runs import erase_runs

    return erase_runs(runs, gone)


def _touched(parts: DataFrame, stroke: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components any stroke pixel touches."""
    laid = normalize_runs(stroke, keys).select(
        *keys, "y", F.col("x0").alias("s0"), (F.col("x1") - 1).alias("s1")
    )
    ranged = parts.withColumn("c1", F.col("x1") - 1)
    met = overlap_join(ranged, laid, [*keys, "y"], ("x0", "c1"), ("s0", "s1"))
    return met.select(*keys, "component").distinct()


def erase_touched_components(runs: DataFrame, stroke: DataFrame, across_labels: bool = False) -> DataFrame:
    """Delete every component a stroke pixel touches.

    The stroke is keyed by frame and label, or by frame alone when ``across_labels`` works on
    the union of the frame's labels. The runs are read up to three times below, so what made
    them is run once and cut off.
    """
    from annotlake.operators.runs import erase_runs

    runs = cut(runs)
    if across_labels:
        keys = ["frame_id"]
        parts = components_of(union_presence(runs), keys)
        gone = parts.join(_touched(parts, stroke, keys), [*keys, "component"], "left_semi")
        return erase_runs(runs, on_every_label(runs, gone))
    parts = connected_components(runs)
    gone = parts.join(_touched(parts, stroke, FRAME_LABEL), [*FRAME_LABEL, "component"], "left_semi")
    return erase_runs(runs, gone)


def largest_component(components: DataFrame, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    """Runs of the largest component; on equal areas the one a raster scan leaves last."""
    sizes = components.groupBy(*keys, "component").agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area"), F.max(F.struct("y", "x1")).alias("last")
    )
    best = sizes.groupBy(*keys).agg(F.max(F.struct("area", "last", "component")).alias("b"))
    return components.join(best.select(*keys, F.col("b.component").alias("component")), [*keys, "component"], "left_semi")


def approx_component_boxes(runs: DataFrame, step: int, keys: Sequence[str] = FRAME_LABEL) -> DataFrame:
    """Component boxes found on a coarse grid and scaled back."""
    parts = components_of(downsample_presence(runs, step, keys), keys)
    boxes = component_regions(parts, keys).drop("area", "component")
    return boxes.select(*keys, *[(F.col(c) * step).alias(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")])


def mask_regions(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Objects of every mask: one per instance id, or per component for semantic labels.

    ``labels``: label_id, label_index, is_instance. ``part`` orders the regions of a mask.
    """
    flagged = join_shares(runs.where(F.col("value") != 0), labels.select("label_id", "label_index", "is_instance"), "label_id")
    keys = [*FRAME_LABEL, "label_index"]
    instances = normalize_runs(flagged.where("is_instance"), [*keys, "value"])
    by_id = mask_area_bbox(instances, [*keys, "value"]).withColumnRenamed("value", "part")
    semantic = components_of(normalize_runs(flagged.where("not is_instance"), keys), keys)
    by_part = mask_area_bbox(semantic, [*keys, "component"]).withColumnRenamed("component", "part")
    return by_id.withColumn("part", F.col("part").cast("long")).unionByName(by_part)
