"""Registry of interchange formats: named exports and imports with described options."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

TableSet = dict[str, DataFrame]


@dataclass(frozen=True)
class Option:
    """One setting of a format: kind is bool, enum or int."""

    key: str
    label: str
    kind: str
    default: Any
    choices: Sequence[tuple[str, str]] = ()
    low: int | None = None
    high: int | None = None

    def read(self, given: dict[str, Any]) -> Any:
        value = given.get(self.key, self.default)
        if self.kind == "bool":
            return value if isinstance(value, bool) else self.default
        if self.kind == "enum":
            return value if value in [c for c, _ in self.choices] else self.default
        if not isinstance(value, int) or isinstance(value, bool):
            return self.default
        if self.low is not None:
            value = max(value, self.low)
        return value if self.high is None else min(value, self.high)


@dataclass(frozen=True)
class Format:
    name: str
    description: str = ""
    options: Sequence[Option] = ()
    masks: bool = False
    polygons: bool = False
    bboxes: bool = False
    classifications: bool = False
    instances: bool = False
    run: Callable[[TableSet, dict[str, Any]], TableSet] | None = field(default=None, compare=False)

    def settings(self, given: dict[str, Any] | None) -> dict[str, Any]:
        return {o.key: o.read(given or {}) for o in self.options}


EXPORTS: dict[str, Format] = {}
IMPORTS: dict[str, Format] = {}


def register_export(key: str, fmt: Format) -> None:
    EXPORTS[key] = fmt


def register_import(key: str, fmt: Format) -> None:
    IMPORTS[key] = fmt


def run_export(key: str, tables: TableSet, options: dict[str, Any] | None = None) -> TableSet:
    fmt = EXPORTS[key]
    return fmt.run(tables, fmt.settings(options))


def run_import(key: str, tables: TableSet, options: dict[str, Any] | None = None) -> TableSet:
    fmt = IMPORTS[key]
    return fmt.run(tables, fmt.settings(options))


def format_infos() -> list[dict[str, Any]]:
    """One merged entry per format: what it can carry, and whether it reads and writes."""
    out = []
    for key in sorted({*EXPORTS, *IMPORTS}):
        fmt = EXPORTS.get(key) or IMPORTS[key]
        out.append(
            {
                "id": key,
                "name": fmt.name,
                "description": fmt.description,
                "can_export": key in EXPORTS,
                "can_import": key in IMPORTS,
                "masks": fmt.masks,
                "polygons": fmt.polygons,
                "bboxes": fmt.bboxes,
                "classifications": fmt.classifications,
                "instances": fmt.instances,
                "export_options": list(EXPORTS[key].options) if key in EXPORTS else [],
                "import_options": list(IMPORTS[key].options) if key in IMPORTS else [],
            }
        )
    return out


# ── built-in formats ────────────────────────────────────────────────────────
# Exports take: frames, labels (label_id, label_index, name, color, is_instance), mask_runs,
# shapes (nodes), and where they are wanted classifications and tasks. Imports take the tables their readers return.


def _export_coco(t: TableSet, settings: dict[str, Any]) -> TableSet:
    from annotlake.operators.components import mask_regions
    from annotlake.operators.geometry import flatten_shapes
    from annotlake.sinks import coco

    images = coco.coco_images(t["frames"])
    return {
        "images": images,
        "categories": coco.coco_categories(t["labels"]),
        "annotations": coco.coco_annotations(
            images,
            mask_regions(t["mask_runs"], t["labels"]),
            flatten_shapes(t["shapes"]),
            t["labels"],
            region_rings(t) if settings["segmentation"] else None,
            settings["segmentation"],
        ),
    }


def region_rings(t: TableSet) -> DataFrame:
    """Rings of every mask region: frame_id, label_id, part, rings (flat coordinate lists)."""
    from pyspark.sql import functions as F

    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"])))
    rings = ring_rows(t).withColumn("ring_flat", F.struct("ring", flat.alias("flat")))
    listed = rings.groupBy("frame_id", "label_id", "part").agg(F.array_sort(F.collect_list("ring_flat")).alias("l"))
    return listed.select("frame_id", "label_id", "part", F.transform("l", lambda r: r["flat"]).alias("rings"))


def ring_rows(t: TableSet) -> DataFrame:
    """One row per ring: frame_id, label_id, label_index, part, ring (place of its first pixel), points."""
    from pyspark.sql import functions as F

    from annotlake.operators.components import connected_components, value_components
    from annotlake.operators.skeleton import component_outlines
    from annotlake.plans.spread import join_shares

    flagged = join_shares(t["mask_runs"], t["labels"].select("label_id", "label_index", "is_instance"), "label_id")
    by_id = component_outlines(
        value_components(flagged.where("is_instance")), ["frame_id", "label_id", "value", "component"]
    ).withColumn("part", F.col("value").cast("long"))
    by_part = component_outlines(
        connected_components(flagged.where("not is_instance")), ["frame_id", "label_id", "component"]
    ).withColumn("part", F.col("component"))
    cols = ["frame_id", "label_id", "part", F.col("component").alias("ring"), "points"]
    both = by_id.select(*cols).unionByName(by_part.select(*cols))
    return join_shares(both, t["labels"].select("label_id", "label_index"), "label_id")


def _export_yolo(t: TableSet, settings: dict[str, Any]) -> TableSet:
    from annotlake.operators.components import mask_regions
    from annotlake.operators.geometry import flatten_shapes
    from annotlake.plans.spread import join_shares
    from annotlake.sinks import yolo

    shapes = flatten_shapes(join_shares(t["shapes"], t["labels"].select("label_id", "label_index"), "label_id"))
    if settings["task"] == "segment":
        lines = yolo.yolo_segment_lines(ring_rows(t), shapes, t["frames"])
    else:
        lines = yolo.yolo_detect_lines(mask_regions(t["mask_runs"], t["labels"]), shapes, t["frames"])
    return {"labels": yolo.yolo_label_files(lines), "data_yaml": yolo.data_yaml_lines(t["labels"])}


def _export_masks(t: TableSet, settings: dict[str, Any]) -> TableSet:
    """Masks, maps and vector documents of the frames that have a path; ``export_errors`` lists the others.

    Instance mode writes the ids of every label and nothing that mixes labels or draws into
    masks. Baking draws each frame's shapes into its masks first; vector documents hold the
    shapes either way.
    """
    from pyspark.sql import functions as F

    from annotlake.operators import exports, runs
    from annotlake.operators.geometry import flatten_shapes, rasterize_shapes

    frames = t["frames"].where("reviewed") if settings["only_reviewed"] else t["frames"]
    shown = frames.where(F.col("relative_path").isNotNull())
    chosen = shown.select(F.col("id").alias("frame_id"))
    of_frames = lambda df: df.join(chosen, "frame_id", "left_semi")
    masks, shapes = of_frames(t["mask_runs"]), of_frames(t["shapes"])
    single = settings["instance"]
    if settings["bake"] and not single:
        drawn = shapes.select("frame_id").distinct()
        baked = runs.bake_shapes(masks.join(drawn, "frame_id", "left_semi"), rasterize_shapes(shapes, shown, runs.FRAME_LABEL))
        plain = masks.join(drawn, "frame_id", "left_anti")
        masks = plain.select(*runs.FRAME_LABEL, "value", "y", "x0", "x1").unionByName(baked.withColumn("value", F.lit(1)))
    index = t["labels"].select("label_id", "label_index")
    out: TableSet = {}
    if settings["individual"] or single:
        out["individual_masks"] = exports.mask_files(runs.individual_masks(masks, t["labels"], single), shown)
    if (settings["combined"] or settings["colormap"]) and not single:
        combined = runs.combined_index_map(masks, index)
        if settings["combined"]:
            out["combined_masks"] = combined.join(exports.frame_files(shown, "combined_masks", ".png"), "frame_id")
        if settings["colormap"]:
            painted = runs.colormap_map(combined, exports.map_colors(t["labels"]))
            out["colormap"] = painted.join(exports.frame_files(shown, "colormap", ".png"), "frame_id")
    if settings["vectors"]:
        out["vector"] = exports.vector_documents(flatten_shapes(shapes), t["labels"], shown)
    if settings["classifications"] and "classifications" in t:
        out["classifications"] = exports.classifications_long_csv(frames, t["classifications"])
        for name, classes, several in [tuple(r) for r in t["tasks"].select("name", "classes", "is_multilabel").collect()] if "tasks" in t else []:
            table = exports.task_csv_multilabel if several else exports.task_csv_multiclass
            out[f"task_{name}"] = table(frames, t["classifications"], name, classes)
    return out


def _import_coco(t: TableSet, settings: dict[str, Any]) -> TableSet:
    from annotlake.sources import coco

    images, labels = coco.coco_frames(t["documents"]), coco.coco_labels(t["documents"])
    return {"labels": labels, "frames": images, "shapes": coco.coco_shapes(coco.coco_annotation_rows(t["documents"]), images, labels)}


def _import_yolo(t: TableSet, settings: dict[str, Any]) -> TableSet:
    from annotlake.sources import yolo

    return {
        "labels": yolo.read_yolo_names(t["data_yaml"]),
        "frames": t["images"],
        "shapes": yolo.parse_label_lines(t["label_lines"], t["images"]),
    }


_coco = dict(name="COCO", description="Boxes and polygons as COCO tables.", polygons=True, bboxes=True, instances=True)
register_export("coco", Format(run=_export_coco, options=[Option("segmentation", "Include polygons", "bool", True)], **_coco))
register_import("coco", Format(run=_import_coco, **_coco))
_yolo = dict(name="YOLO", description="Label lines and class names.", polygons=True, bboxes=True, instances=True)
register_export(
    "yolo",
    Format(run=_export_yolo, options=[Option("task", "Task", "enum", "segment", [("segment", "Segmentation"), ("detect", "Detection")])], **_yolo),
)
register_import("yolo", Format(run=_import_yolo, **_yolo))
register_export(
    "masks",
    Format(
        name="Masks",
        description="Label masks as runs, colour maps and vector JSON.",
        masks=True,
        polygons=True,
        classifications=True,
        instances=True,
        run=_export_masks,
        options=[
            Option("individual", "One mask per label", "bool", True),
            Option("combined", "Label index map", "bool", True),
            Option("colormap", "Colour map", "bool", False),
            Option("vectors", "Vector shapes", "bool", True),
            Option("instance", "Instance ids only", "bool", False),
            Option("bake", "Draw shapes into masks", "bool", False),
            Option("only_reviewed", "Reviewed frames only", "bool", False),
            Option("classifications", "Classifications as CSV tables", "bool", False),
        ],
    ),
)
