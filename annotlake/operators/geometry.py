"""Vector shapes: flattening, bounds, areas, hit tests, rasterising.

A shape is one row with its node list, so everything up to the flattened outline is a
row-local expression and needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.operators.runs import FRAME_LABEL
from annotlake.plans.durable import cut
from annotlake.plans.overlap import cell_of
from annotlake.plans.spread import partitions, spread
from annotlake.plans.strips import cover, starts, whole_groups
from annotlake.plans.sweep import sweep
from annotlake.schema import SHAPES_JSON

SAMPLES = 24
STROKE_RADIUS = 1.5
GRID = 64


# ── stored form ─────────────────────────────────────────────────────────────


def frame_shapes(stored: DataFrame) -> DataFrame:
    """Rows (frame_id, label_id, shapes JSON) to one row per shape."""
    listed = stored.select("frame_id", "label_id", F.explode(F.from_json("shapes_json", SHAPES_JSON)).alias("s"))
    return listed.select(
        "frame_id",
        "label_id",
        F.col("s.id").alias("shape_id"),
        F.col("s.closed").alias("closed"),
        F.col("s.filled").alias("filled"),
        F.transform(
            "s.nodes",
            lambda n: F.struct(
                n["x"].alias("x"), n["y"].alias("y"), n["inX"].alias("in_x"), n["inY"].alias("in_y"),
                n["outX"].alias("out_x"), n["outY"].alias("out_y"), n["smooth"].alias("smooth"),
            ),
        ).alias("nodes"),
    )


def shapes_to_rows(shapes: DataFrame) -> DataFrame:
    """Stored form: the shape list of each frame and label, as an array and as JSON."""
    node = lambda n: F.struct(
        n["x"].alias("x"), n["y"].alias("y"), n["in_x"].alias("inX"), n["in_y"].alias("inY"),
        n["out_x"].alias("outX"), n["out_y"].alias("outY"), n["smooth"].alias("smooth"),
    )
    one = F.struct(
        F.col("shape_id").cast("string").alias("id"), F.col("label_id").cast("long").alias("labelId"), "closed", "filled", F.transform("nodes", node).alias("nodes")
    )
    listed = shapes.groupBy("frame_id", "label_id").agg(F.array_sort(F.collect_list(one)).alias("shapes"))
    return listed.withColumn("shapes_json", F.to_json("shapes"))


# ── outlines ────────────────────────────────────────────────────────────────


def curve_weights(samples: int) -> list[tuple[float, float, float, float]]:
    """Weights of the four control points at each of ``samples`` + 1 parameters from 0 to 1."""
    out = []
    for k in range(samples + 1):
        t = k / samples
        s = 1.0 - t
        out.append((s * s * s, 3.0 * s * s * t, 3.0 * s * t * t, t * t * t))
    return out


def _weight_struct(**named: tuple[float, float, float, float]) -> Column:
    return F.struct(*[F.lit(v).alias(f"{prefix}{i}") for prefix, ws in named.items() for i, v in enumerate(ws)])


def _is_straight(a: Column, b: Column) -> Column:
    return (a["out_x"] == a["x"]) & (a["out_y"] == a["y"]) & (b["in_x"] == b["x"]) & (b["in_y"] == b["y"])


def _weighed(w: Column, prefix: str, p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    return w[f"{prefix}0"] * p0 + w[f"{prefix}1"] * p1 + w[f"{prefix}2"] * p2 + w[f"{prefix}3"] * p3


def _segment_points(a: Column, b: Column, samples: int) -> Column:
    weights = F.array(*[_weight_struct(w=w) for w in curve_weights(samples)[1:]])
    curve = F.transform(
        weights,
        lambda w: F.struct(
            _weighed(w, "w", a["x"], a["out_x"], b["in_x"], b["x"]).alias("x"),
            _weighed(w, "w", a["y"], a["out_y"], b["in_y"], b["y"]).alias("y"),
        ),
    )
    corner = F.array(F.struct(b["x"].alias("x"), b["y"].alias("y")))
    return F.when(_is_straight(a, b), corner).otherwise(curve)


def segments(nodes: str = "nodes") -> Column:
    """Array of (a, b) node pairs; a closed shape also joins its last node to the first."""
    n = F.size(nodes)
    count = F.when(F.col("closed"), n).otherwise(n - 1)
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda i: F.struct(
            F.element_at(nodes, i).alias("a"), F.element_at(nodes, (i % n) + 1).alias("b"), i.alias("i")
        ),
    )
    return F.when((n >= 2), pairs)


def flatten_shapes(shapes: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Add ``points``: the outline as a polyline. A closed ring repeats its first point."""
    first = F.transform(F.slice("nodes", 1, 1), lambda n: F.struct(n["x"].alias("x"), n["y"].alias("y")))
    rest = F.flatten(F.transform(segments(), lambda s: _segment_points(s["a"], s["b"], samples)))
    return shapes.withColumn("points", F.when(F.size("nodes") >= 2, F.concat(first, rest)).otherwise(first))


def _low(points: Column, axis: str) -> Column:
    return F.array_min(F.transform(points, lambda p: p[axis]))


def _high(points: Column, axis: str) -> Column:
    return F.array_max(F.transform(points, lambda p: p[axis]))


def polygon_bounds(points: Column) -> dict[str, Column]:
    """x, y, w, h of a point list; zeros when empty."""
    zero = F.lit(0.0)
    x, y = _low(points, "x"), _low(points, "y")
    return {
        "bbox_x": F.coalesce(x, zero),
        "bbox_y": F.coalesce(y, zero),
        "bbox_w": F.coalesce(_high(points, "x") - x, zero),
        "bbox_h": F.coalesce(_high(points, "y") - y, zero),
    }


def polygon_area(points: str = "points") -> Column:
    """Shoelace area of the ring through the points."""
    n = F.size(points)
    rotated = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, rotated, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    twice = F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(n > 0, F.abs(twice) / 2.0).otherwise(F.lit(0.0))


def polyline_length(points: str = "points") -> Column:
    n = F.size(points)
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.hypot(
            F.element_at(points, i + 1)["x"] - F.element_at(points, i)["x"],
            F.element_at(points, i + 1)["y"] - F.element_at(points, i)["y"],
        ),
    )
    return F.when(n >= 2, F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)).otherwise(F.lit(0.0))


def outline_edges(shapes: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per edge (x1, y1, x2, y2) of the flattened outline, straight from the nodes.

    A closed shape's outline ends where it began, so no further closing edge exists. The
    points are weighted sums of the control points: plain column arithmetic on exploded rows
    with weights known when the plan is made.
    """
    n = F.size("nodes")
    count = F.when(F.col("closed"), n).otherwise(n - 1)
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda i: F.struct(F.element_at("nodes", i).alias("a"), F.element_at("nodes", i % n + 1).alias("b")),
    )
    kept = [c for c in shapes.columns if c not in ("nodes", "points")]
    pairs = shapes.where(n >= 2).select(*kept, F.inline(ends))
    ws = curve_weights(samples)
    curve = F.array(*[_weight_struct(p=ws[k], q=ws[k + 1]) for k in range(samples)])
    line = F.array(_weight_struct(p=ws[0], q=ws[-1]))
    steps = F.explode(F.when(_is_straight(F.col("a"), F.col("b")), line).otherwise(curve))
    split = pairs.select(*kept, "a", "b", steps.alias("w"))

    def place(prefix: str, axis: str) -> Column:
        controls = (F.col(f"a.{axis}"), F.col(f"a.out_{axis}"), F.col(f"b.in_{axis}"), F.col(f"b.{axis}"))
        return _weighed(F.col("w"), prefix, *controls)

    return split.select(
        *kept,
        place("p", "x").alias("x1"),
        place("p", "y").alias("y1"),
        place("q", "x").alias("x2"),
        place("q", "y").alias("y2"),
    )


# ── rasterising ─────────────────────────────────────────────────────────────


def _sized_edges(shapes: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges of the outlines with the image size and ``solid``: closed and filled; those of equal keys side by side.

    The size is joined while a shape is one row of nodes. Ranges of the keys spread a frame with
    very many shapes over tasks and leave the shapes of other frames together.
    """
    sizes = frames.select(F.col("id").alias("frame_id"), "width", "height")
    flagged = shapes.withColumn("solid", F.col("closed") & F.col("filled")).where(F.col("solid").isNotNull())
    sized = flagged.select(*keys, "closed", "nodes", "solid").join(sizes, "frame_id")
    dealt = sized.repartitionByRange(partitions(shapes.sparkSession), *keys).sortWithinPartitions(*keys)
    return outline_edges(dealt).select(*keys, "solid", "x1", "y1", "x2", "y2", "width", "height")


def _drawn(edges: DataFrame, keys: Sequence[str], radius: float, merged: Sequence[str] | None = None) -> DataFrame:
    """Runs of what ``_sized_edges`` gives, drawn by whole shapes inside the tasks; no pixel row is shuffled."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields if f.name in (merged or keys))
    return edges.mapInArrow(_shape_runs(keys, radius, merged), f"{kinds}, y long, x0 long, x1 long")


def rasterize_filled(shapes: DataFrame, frames: DataFrame) -> DataFrame:
    """Even-odd fill at pixel centres of closed, filled shapes, as runs per shape.

    Each edge crosses a row at most once; a crossing flips the parity from its pixel on, so
    the fill is a row sweep over crossings and the pixel list of a polygon never exists.
    """
    keys = [*FRAME_LABEL, "shape_id"]
    return _drawn(_sized_edges(shapes.where(F.col("closed") & F.col("filled")), frames, keys), keys, 0.0)


# Pixel rows of edges that are measured at once.
STROKE_ROWS = 1 << 17


def _shape_runs(keys: Sequence[str], r: float, merged: Sequence[str] | None = None, rows_at_once: int = STROKE_ROWS):
    """Edges of whole shapes to runs, a bounded number of image rows at a time.

    Solid shapes are filled, the others stroked; edges without a finite place are not stroked. With
    ``merged`` the runs of neighbouring shapes that agree in these keys are united as far as they are at hand.
    """

    def capsule_runs(edge: dict[str, np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, x0 and x1 of the runs that the capsules around edges leave on image rows ``y``, one row each.

        A capsule is convex, so the cut is one interval: the hull of what its two disks and the
        strip between them leave of the row. Along a level edge whose side lies on the row centre
        rounding decides for each pixel, so there every pixel is measured and is a run of its own.
        """
        x1, y1, x2, y2, width = (edge[c] for c in ("x1", "y1", "x2", "y2", "width"))
        yc = y + 0.5
        dx, dy, up = x2 - x1, y2 - y1, yc - y1
        size = dx * dx + dy * dy
        lo, hi = np.full(len(y), np.inf), np.full(len(y), -np.inf)

        def widen(holds: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            np.minimum(lo, low, out=lo, where=holds)
            np.maximum(hi, high, out=hi, where=holds)

        for x_end, y_end in ((x1, y1), (x2, y2)):
            inside = r * r - (yc - y_end) * (yc - y_end)
            half = np.sqrt(np.maximum(inside, 0.0))
            widen(inside >= 0, x_end - half, x_end + half)
        # The strip: between the two ends, and within r to either side.
        along = x1 - up * dy / dx, x1 + (size - up * dy) / dx
        across = [x1 + (up * dx + k * r * np.sqrt(size)) / dy for k in (-1, 1)]
        level, upright = dy == 0, dx == 0
        low = np.where(level, np.minimum(*along), np.where(upright, np.minimum(*across), np.maximum(np.minimum(*along), np.minimum(*across))))
        high = np.where(level, np.maximum(*along), np.where(upright, np.maximum(*across), np.minimum(np.maximum(*along), np.maximum(*across))))
        met = np.where(level, np.abs(up) <= r, np.where(upright, (up * dy >= 0) & (up * dy <= size), low <= high))
        widen((size > 0) & met, low, high)
        flat = (np.abs(dy) <= np.abs(dx) * 1e-9) & (np.abs(np.abs(up) - r) <= 1e-6) & ~upright
        widen(flat, np.minimum(x1, x2) - 1, np.maximum(x1, x2) + 1)

        cut_by = np.flatnonzero(lo <= hi)
        left = np.maximum(np.ceil(lo[cut_by] - 0.5), 0)
        right = np.minimum(np.floor(hi[cut_by] - 0.5), width[cut_by] - 1)

        def near(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
            px = x + 0.5
            t = np.where(size[rows] > 0, ((px - x1[rows]) * dx[rows] + (yc[rows] - y1[rows]) * dy[rows]) / size[rows], 0.0)
            t = np.maximum(0.0, np.minimum(1.0, t))
            ex, ey = px - (x1[rows] + t * dx[rows]), yc[rows] - (y1[rows] + t * dy[rows])
            return (x >= 0) & (x < width[rows]) & (ex * ex + ey * ey <= r * r)

        least, most = np.full(len(cut_by), np.inf), np.full(len(cut_by), -np.inf)
        for end in (left, right):
            for k in (-1, 0, 1):
                holds = near(cut_by, end + k)
                np.minimum(least, end + k, out=least, where=holds)
                np.maximum(most, end + k, out=most, where=holds)
        whole = (least <= most) & ~flat[cut_by]
        crossed = left <= right
        wide = np.flatnonzero(flat[cut_by] & crossed)
        n = (right[wide] - left[wide]).astype(np.int64) + 1
        each = np.repeat(wide, n)
        x = left[each] + (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
        beyond = np.flatnonzero(flat[cut_by] & ~crossed)
        each = np.concatenate([each, *[beyond] * 6])
        x = np.concatenate([x, *[end[beyond] + k for end in (left, right) for k in (-1, 0, 1)]])
        single = near(cut_by[each], x)
        each, x = each[single], x[single]
        return (
            np.concatenate([cut_by[whole], cut_by[each]]),
            np.concatenate([least[whole], x]).astype(np.int64),
            np.concatenate([most[whole], x]).astype(np.int64) + 1,
        )

    def crossings(edge: dict[str, np.ndarray], y: np.ndarray) -> np.ndarray:
        """The pixel from which on an edge flips the parity of the image row ``y``, one row each."""
        along = (y + 0.5 - edge["y1"]) / (edge["y2"] - edge["y1"])
        x = np.ceil(edge["x1"] + along * (edge["x2"] - edge["x1"]) - 0.5)
        most = np.where(np.isnan(edge["width"]), float(1 << 62), edge["width"])
        return np.minimum(np.maximum(np.where(np.isnan(x), 0, x), 0), most).astype(np.int64)

    def reach(edge: dict[str, np.ndarray], solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last image row of each edge; the last lies before the first where there is none."""
        height = np.where(np.isnan(edge["height"]), np.inf, edge["height"])
        low, high = np.fmin(edge["y1"], edge["y2"]), np.maximum(edge["y1"], edge["y2"])
        first = np.maximum(np.where(solid, np.ceil(low - 0.5), np.floor(np.minimum(edge["y1"], edge["y2"]) - r)), 0)
        last = np.minimum(np.where(solid, np.ceil(high - 0.5) - 1, np.ceil(high + r)), height - 1)
        placed = np.where(solid, first <= last, np.isfinite(edge["x1"] + edge["x2"] + first + last + edge["width"]))
        return np.where(placed, first, 0).astype(np.int64), np.where(placed, last, -1).astype(np.int64)

    def filled(of: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs between the places that are named an odd number of times; without a second place x1 is -1."""
        base, low, span = of.min(), y.min(), int(y.max() - y.min()) + 1
        if int(of.max() - base + 1) * span < 1 << 30 and x.max() < 1 << 32:
            # Places as single numbers sort faster.
            place = ((of - base) * span + y - low) << 32 | x
            place.sort()
            of, y = np.divmod(place >> 32, span)
            of, y, x = of + base, y + low, place & (1 << 32) - 1
        else:
            order = np.lexsort((x, y, of))
            of, y, x = of[order], y[order], x[order]
        fresh = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1])))
        odd = fresh[np.diff(np.append(fresh, len(x))) % 2 == 1]
        of, y, x = of[odd], y[odd], x[odd]
        head = np.append(True, (of[1:] != of[:-1]) | (y[1:] != y[:-1]))[: len(x)]
        place = np.arange(len(x))
        begins = (place - place[head][np.cumsum(head) - 1]) % 2 == 0
        paired = np.append(~head[1:], False)[: len(x)]
        return of[begins], y[begins], x[begins], np.where(paired, np.append(x[1:], 0)[: len(x)], -1)[begins]

    def united(of: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
        """Maximal runs of each ``of`` and row."""
        if not len(y):
            return of, y, x0, x1
        base, low, span = of.min(), y.min(), int(y.max() - y.min()) + 1
        names, line = None, (of - base) * span + y - low
        if line.max() >= 1 << 30:
            names, line = np.unique(line, return_inverse=True)
        line, x0, x1 = cover((line, x0, x1))
        of, row = np.divmod(line if names is None else names[line], span)
        return of + base, row + low, x0, x1

    def drawn(edge: dict[str, np.ndarray], solid: np.ndarray, of: np.ndarray, to: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs (of, y, x0, x1) on the image rows from ``first`` to ``last`` of each edge."""
        n = np.maximum(last - first + 1, 0)
        each = np.repeat(np.arange(len(n)), n)
        y = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        inner, rim = solid[each] & (edge["y1"] != edge["y2"])[each], ~solid[each]
        made = []
        if inner.any():
            at = each[inner]
            found = filled(of[at], y[inner], crossings({c: v[at] for c, v in edge.items()}, y[inner]))
            made.append((to[found[0]], *found[1:]))
        if rim.any():
            at, rows = each[rim], y[rim]
            which, x0, x1 = capsule_runs({c: v[at] for c, v in edge.items()}, rows)
            stroke = to[of[at[which]]], rows[which], x0, x1
            made.append(stroke if merged else united(*stroke))
        if not made:
            return (np.zeros(0, np.int64),) * 4
        runs = tuple(np.concatenate(c) for c in zip(*made))
        return united(*runs) if merged else runs

    def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(parts, keys):
            edge = {c: part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2", "width", "height")}
            solid = part.column("solid").to_numpy(zero_copy_only=False).astype(bool)
            head = starts(part, keys)
            of = np.repeat(np.arange(len(head)), np.diff(np.append(head, part.num_rows)))
            named = starts(part, merged) if merged else head
            to = np.searchsorted(named, head, "right") - 1
            with np.errstate(all="ignore"):
                first, last = reach(edge, solid)
                total = np.cumsum(np.maximum(last - first + 1, 0))
                ends, at = np.append(head[1:], part.num_rows), 0
                while at < part.num_rows:
                    # As many shapes as have few enough rows, one at least.
                    done = total[at - 1] if at else 0
                    k = max(int(np.searchsorted(total[ends - 1], done + rows_at_once, "right")), int(of[at]) + 1)
                    till = int(ends[k - 1])
                    mine = slice(at, till)
                    held = {c: v[mine] for c, v in edge.items()}
                    low, high = int(first[mine].min()), int(last[mine].max())
                    step = max(rows_at_once // (till - at), 1) if total[till - 1] - done > rows_at_once else max(high - low + 1, 1)
                    for top in range(low, high + 1, step):
                        which, y, x0, x1 = drawn(held, solid[mine], of[mine], to, np.maximum(first[mine], top), np.minimum(last[mine], top + step - 1))
                        whole = x1 >= 0
                        if merged:
                            which, y, x0, x1 = (a[whole] for a in (which, y, x0, x1))
                        kept = [part.column(c).take(pa.array(named[which])) for c in merged or keys]
                        yield pa.RecordBatch.from_arrays([*kept, pa.array(y), pa.array(x0), pa.array(x1, mask=x1 < 0)], names=[*(merged or keys), "y", "x0", "x1"])
                    at = till

    return runs


def rasterize_stroked(shapes: DataFrame, frames: DataFrame, radius: float = STROKE_RADIUS) -> DataFrame:
    """Other shapes: pixels whose centre lies within ``radius`` of the outline, as runs per shape.

    Each segment gives one run an image row, solved from the segment; only the pixels at the
    two ends of a run are measured, and those along a side that lies on a row centre, so that
    ties at the radius fall as they do for single pixels. That is arithmetic over whole batches
    of edges in numpy, where the runs of a shape are merged too.
    """
    keys = [*FRAME_LABEL, "shape_id"]
    return _drawn(_sized_edges(shapes.where(~(F.col("closed") & F.col("filled"))), frames, keys), keys, radius)


def with_distance(df: DataFrame, px: Column, py: Column) -> DataFrame:
    """Add ``d2``, the squared distance of (px, py) to the edge (x1, y1, x2, y2) of the row.

    Built in steps so that each intermediate value is computed once; the last one leaves
    through a one-element explode, which keeps filters on it from unrolling the steps.
    """
    kept = df.columns
    df = df.withColumns({"_dx": F.col("x2") - F.col("x1"), "_dy": F.col("y2") - F.col("y1"), "_px": px, "_py": py})
    df = df.withColumn("_size", F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    along = ((F.col("_px") - F.col("x1")) * F.col("_dx") + (F.col("_py") - F.col("y1")) * F.col("_dy")) / F.col("_size")
    t = F.when(F.col("_size") > 0, along).otherwise(F.lit(0.0))
    df = df.withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    df = df.withColumns(
        {
            "_ex": F.col("_px") - (F.col("x1") + F.col("_t") * F.col("_dx")),
            "_ey": F.col("_py") - (F.col("y1") + F.col("_t") * F.col("_dy")),
        }
    )
    d2 = F.col("_ex") * F.col("_ex") + F.col("_ey") * F.col("_ey")
    return df.select(*kept, F.explode(F.array(d2)).alias("d2"))


def rasterize_shapes(shapes: DataFrame, frames: DataFrame, merged: Sequence[str] | None = None) -> DataFrame:
    """Runs per shape: filled interiors and stroked outlines.

    With ``merged``, of the keys frame, label and shape those in front, the runs carry these alone and
    are united as far as shapes lie together; runs from different tasks or batches may still overlap.
    """
    keys = [*FRAME_LABEL, "shape_id"]
    return _drawn(_sized_edges(shapes, frames, keys), keys, STROKE_RADIUS, merged)


# ── hit tests ───────────────────────────────────────────────────────────────


def _with_grid(df: DataFrame, size: int) -> DataFrame:
    """One row per grid cell the box (bbox_x, bbox_y, bbox_w, bbox_h) touches."""
    xs = F.sequence(cell_of(F.col("bbox_x"), size), cell_of(F.col("bbox_x") + F.col("bbox_w"), size))
    ys = F.sequence(cell_of(F.col("bbox_y"), size), cell_of(F.col("bbox_y") + F.col("bbox_h"), size))
    return df.withColumn("gx", F.explode(xs)).withColumn("gy", F.explode(ys))


def bbox_intersects(boxes: DataFrame, windows: DataFrame, size: int = GRID) -> DataFrame:
    """Boxes of ``boxes`` that meet a selection window of their frame, touching included.

    Both sides are laid on grid cells; a pair is kept in the cell that holds the larger of
    the two left edges and the larger of the two top edges, so it appears once.
    """
    a = _with_grid(boxes, size)
    renamed = windows.select(
        "frame_id", "window_id", *[F.col(c).alias("w" + c[4:]) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")]
    )
    b = (
        renamed.withColumn("gx", F.explode(F.sequence(cell_of(F.col("w_x"), size), cell_of(F.col("w_x") + F.col("w_w"), size))))
        .withColumn("gy", F.explode(F.sequence(cell_of(F.col("w_y"), size), cell_of(F.col("w_y") + F.col("w_h"), size))))
    )
    meets = (
        (F.col("bbox_x") <= F.col("w_x") + F.col("w_w"))
        & (F.col("bbox_x") + F.col("bbox_w") >= F.col("w_x"))
        & (F.col("bbox_y") <= F.col("w_y") + F.col("w_h"))
        & (F.col("bbox_y") + F.col("bbox_h") >= F.col("w_y"))
        & (F.col("gx") == cell_of(F.greatest("bbox_x", "w_x"), size))
        & (F.col("gy") == cell_of(F.greatest("bbox_y", "w_y"), size))
    )
    return a.join(b, ["frame_id", "gx", "gy"]).where(meets).drop("gx", "gy")


# Cell borders lie off the places where nodes and clicks usually are, so that no outline touches a corner of a cell.
GRID_X, GRID_Y = 0.3712345, 0.2718281


def _column(x: Column, size: int) -> Column:
    """The cell whose right border is the first at or after ``x``."""
    return F.ceil((x - F.lit(GRID_X)) / F.lit(size))


def _band(y: Column, size: int) -> Column:
    """The cell whose upper border is the last at or before ``y``."""
    return F.floor((y - F.lit(GRID_Y)) / F.lit(size))


def _crossing(y: Column) -> Column:
    """Where the edge of the row meets the height ``y``; edges that are level there have no place."""
    return (F.col("x1") - F.col("x2")) * (y - F.col("y2")) / F.nullif(F.col("y1") - F.col("y2"), F.lit(0.0)) + F.col("x2")


def edge_cells(edges: DataFrame, size: int) -> DataFrame:
    """One row per grid cell (gx, gy) an edge passes through: at most one more than it crosses borders."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.withColumn("gy", F.explode(F.sequence(_band(low, size), _band(high, size))))
    top = F.col("gy") * F.lit(size) + F.lit(GRID_Y)
    ends = [F.coalesce(_crossing(F.greatest(low, top)), F.col("x1")), F.coalesce(_crossing(F.least(high, top + size)), F.col("x2"))]
    slack = F.lit(1e-6)
    return banded.withColumn("gx", F.explode(F.sequence(_column(F.least(*ends) - slack, size), _column(F.greatest(*ends) + slack, size))))


def corner_parity(edges: DataFrame, size: int) -> DataFrame:
    """frame_id, shape_id, gx, gy of the cells whose upper right corner lies inside, by the outline's crossings of the upper border."""
    lines = F.sequence(_band(F.least("y1", "y2"), size), _band(F.greatest("y1", "y2"), size) + 1)
    rows = edges.withColumn("gy", F.explode(lines)).withColumn("_line", F.col("gy") * F.lit(size) + F.lit(GRID_Y))
    rows = rows.where((F.col("y1") > F.col("_line")) != (F.col("y2") > F.col("_line")))
    keys = ["frame_id", "shape_id"]
    flips = rows.select(*keys, F.col("gy").alias("y"), _column(_crossing(F.col("_line")), size).alias("x"), F.lit(1).cast("long").alias("odd"))
    spans = sweep(flips, keys, ["odd"], F.when(F.col("odd") % 2 == 1, F.lit(1)), "_in")
    return spans.select(*keys, F.explode(F.sequence("x0", F.col("x1") - 1)).alias("gx"), F.col("y").alias("gy"))


def point_in_polygon(shapes: DataFrame, points: DataFrame, size: int = GRID) -> DataFrame:
    """(shape_id, point_id) where a point lies inside a closed shape, even-odd.

    A parity grid: of every cell it is known whether its upper right corner lies inside. From
    there a path runs down the right border to the point's height and left to the point;
    every edge of the cell that crosses it flips the answer. So a point meets the edges of one
    cell, and one row for each shape around the cell, however many edges the shapes have.
    """
    closed = shapes.where("closed").select("frame_id", "shape_id", "closed", "nodes")
    edges = outline_edges(spread(closed, "frame_id", "shape_id")).drop("closed")
    cell = ["frame_id", "gx", "gy"]
    placed = points.select("frame_id", "point_id", "px", "py", _column(F.col("px"), size).alias("gx"), _band(F.col("py"), size).alias("gy"))
    border, top = F.col("gx") * F.lit(size) + F.lit(GRID_X), F.col("gy") * F.lit(size) + F.lit(GRID_Y)
    cross = _crossing(F.col("py"))
    left = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < cross) & (cross <= border)
    fall = (F.col("y1") - F.col("y2")) * (border - F.col("x2")) / F.nullif(F.col("x1") - F.col("x2"), F.lit(0.0)) + F.col("y2")
    down = ((F.col("x1") > border) != (F.col("x2") > border)) & (fall > top) & (fall <= F.col("py"))
    flips = F.coalesce(left, F.lit(False)).cast("int") + F.coalesce(down, F.lit(False)).cast("int")
    pair = ["frame_id", "shape_id", "point_id"]
    met = edge_cells(edges, size).join(placed, cell).select(*pair, flips.alias("n")).where("n > 0")
    around = corner_parity(edges, size).join(placed, cell).select(*pair, F.lit(1).alias("n"))
    odd = met.unionByName(around).groupBy(*pair).agg(F.sum("n").alias("n")).where("n % 2 = 1")
    return odd.drop("n")


def outline_segments(shapes: DataFrame) -> DataFrame:
    """``frame_id, shape_id, x1, y1, x2, y2`` of every outline edge; a single node is an edge of no length."""
    single = shapes.where(F.size("nodes") == 1).select(
        "frame_id", "shape_id",
        *[F.col("nodes")[0][a].alias(f"{a}{i}") for i in (1, 2) for a in ("x", "y")],
    )
    slim = spread(shapes.select("frame_id", "shape_id", "closed", "nodes"), "frame_id", "shape_id")
    drawn = outline_edges(slim).drop("closed")
    return drawn.unionByName(single).dropna(subset=["x1", "y1", "x2", "y2"])


def outlines_near(shapes: DataFrame, points: DataFrame, reach: float, size: int = GRID) -> DataFrame:
    """Least distance of a point to each outline of its frame within ``reach``.

    Edges are laid on the grid cells within reach of them, so a point meets nearby edges only.
    """
    edges = outline_segments(shapes)
    r = F.lit(float(reach))
    nearby = edges.withColumn(
        "gx", F.explode(F.sequence(cell_of(F.least("x1", "x2") - r, size), cell_of(F.greatest("x1", "x2") + r, size)))
    ).withColumn(
        "gy", F.explode(F.sequence(cell_of(F.least("y1", "y2") - r, size), cell_of(F.greatest("y1", "y2") + r, size)))
    )
    placed = points.select(
        "frame_id", "point_id", "px", "py", cell_of(F.col("px"), size).alias("gx"), cell_of(F.col("py"), size).alias("gy")
    )
    met = nearby.join(placed, ["frame_id", "gx", "gy"])
    near = with_distance(met, F.col("px"), F.col("py")).where(F.col("d2") <= reach * reach)
    return near.groupBy("frame_id", "shape_id", "point_id").agg(F.sqrt(F.min("d2")).alias("distance"))


def distance_to_shape(shapes: DataFrame, points: DataFrame, reach: float = GRID) -> DataFrame:
    """``frame_id, point_id, shape_id, distance``: the outline of its frame nearest to each point, the lowest id on ties.

    Points look within ``reach`` first; those that found nothing look twice as far, on cells
    twice as wide, until every point whose frame has an outline has one. The number of
    rounds grows with the logarithm of the farthest distance.
    """
    drawn = outline_segments(shapes).select("frame_id").distinct()
    left = cut(points.select("frame_id", "point_id", "px", "py").dropna(subset=["px", "py"]).join(drawn, "frame_id", "left_semi"))
    found = None
    while not left.isEmpty():
        near = outlines_near(shapes, left, reach, max(1, math.ceil(reach)))
        best = near.groupBy("frame_id", "point_id").agg(F.min(F.struct(F.round("distance", 9).alias("d"), "shape_id", "distance")).alias("b"))
        best = cut(best.select("frame_id", "point_id", "b.shape_id", "b.distance"))
        found = best if found is None else found.unionByName(best)
        left = cut(left.join(best.select("frame_id", "point_id"), ["frame_id", "point_id"], "left_anti"))
        reach *= 2
    if found is None:
        return left.select("frame_id", "point_id", F.lit(None).cast("long").alias("shape_id"), F.lit(None).cast("double").alias("distance"))
    return found


def pick_shape(shapes: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """Shape a click selects: scanning from the top, a body hit ends the search and wins;
    without any body hit the nearest outline within tolerance, the lower shape on ties.

    ``shapes`` carry ``z``, the drawing order; both candidates per point are single
    combined aggregates.
    """
    order = shapes.select("shape_id", "z")
    body = (
        point_in_polygon(shapes, points)
        .join(order, "shape_id")
        .groupBy("point_id")
        .agg(F.max(F.struct("z", "shape_id")).alias("_body"))
    )
    near = (
        outlines_near(shapes, points, tolerance)
        .join(order, "shape_id")
        .groupBy("point_id")
        .agg(F.min(F.struct("distance", "z", "shape_id")).alias("_near"))
    )
    return (
        body.join(near, "point_id", "full")
        .select(
            "point_id",
            F.coalesce("_body.shape_id", "_near.shape_id").alias("shape_id"),
            F.col("_body").isNotNull().alias("body_hit"),
        )
    )


def closest_segment(shapes: DataFrame, points: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Segment and parameter of the nearest of ``samples`` points per segment.

    ``points`` name the shape they ask about (shape_id); the samples of a shape are searched
    inside the row, no sample row is ever shuffled.
    """
    asked = points.select("shape_id", "point_id", "px", "py").join(
        shapes.where(F.size("nodes") >= 2).select("shape_id", "closed", "nodes"), "shape_id"
    )
    weights = F.array(
        *[
            F.struct(*[F.lit(v).alias(f"w{i}") for i, v in enumerate(w)], F.lit(k / samples).alias("t"))
            for k, w in enumerate(curve_weights(samples))
            if k > 0
        ]
    )
    candidates = F.flatten(
        F.transform(
            segments(),
            lambda s: F.transform(
                weights,
                lambda w: F.struct(
                    F.hypot(
                        _weighed(w, "w", s["a"]["x"], s["a"]["out_x"], s["b"]["in_x"], s["b"]["x"]) - F.col("px"),
                        _weighed(w, "w", s["a"]["y"], s["a"]["out_y"], s["b"]["in_y"], s["b"]["y"]) - F.col("py"),
                    ).alias("distance"),
                    (s["i"] - 1).alias("segment"),
                    w["t"].alias("t"),
                ),
            ),
        )
    )
    return asked.select("shape_id", "point_id", F.array_min(candidates).alias("best")).select(
        "shape_id", "point_id", "best.segment", "best.t", "best.distance"
    )


def translate_shapes(shapes: DataFrame, dx: float, dy: float) -> DataFrame:
    """Shift anchors and handles."""
    return shapes.withColumn(
        "nodes",
        F.transform(
            "nodes",
            lambda n: F.struct(
                (n["x"] + dx).alias("x"), (n["y"] + dy).alias("y"),
                (n["in_x"] + dx).alias("in_x"), (n["in_y"] + dy).alias("in_y"),
                (n["out_x"] + dx).alias("out_x"), (n["out_y"] + dy).alias("out_y"),
                n["smooth"].alias("smooth"),
            ),
        ),
    )


def points_to_shape(polygons: DataFrame, salt: Column | None = None) -> DataFrame:
    """Polygons as shapes of straight corner nodes.

    Where ``polygons`` have no ``shape_id`` it is a hash of the whole row and ``salt``, a value
    that tells one import from the next.
    """
    if "shape_id" not in polygons.columns:
        seed = salt if salt is not None else F.lit(0).cast("long")
        polygons = polygons.withColumn("shape_id", F.xxhash64(*polygons.columns, seed))
    corner = lambda p: F.struct(
        p["x"].alias("x"), p["y"].alias("y"), p["x"].alias("in_x"), p["y"].alias("in_y"),
        p["x"].alias("out_x"), p["y"].alias("out_y"), F.lit(False).alias("smooth"),
    )
    return polygons.withColumn("nodes", F.transform("points", corner)).drop("points")
