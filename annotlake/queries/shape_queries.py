"""Vector geometry and rasterising with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from annotlake.operators import exports as E
from annotlake.operators import geometry as G
from annotlake.operators import runs as R
from annotlake.queries.mask_queries import EXTRA as MASKS
from annotlake.queries.mask_queries import to_runs
from annotlake.queries.registry import query
from annotlake.schema import NODE_JSON

NEXT = """select *, lead(node) over w is null as is_end, count(*) over (partition by shape_id) as n,
     coalesce(lead(x) over w, first_value(x) over w) as bx, coalesce(lead(y) over w, first_value(y) over w) as by_,
     coalesce(lead(in_x) over w, first_value(in_x) over w) as bin_x, coalesce(lead(in_y) over w, first_value(in_y) over w) as bin_y
   from {shape_nodes} window w as (partition by shape_id order by node)"""


def cubic(a, o, i, b):
    return (
        f"(1.0::double - t) * (1.0::double - t) * (1.0::double - t) * {a} + 3.0::double * (1.0::double - t) * (1.0::double - t) * t * {o} "
        f"+ 3.0::double * (1.0::double - t) * t * t * {i} + t * t * t * {b}"
    )


FLAT = f"""
  select shape_id, frame_id, label_id, closed, filled, row_number() over (partition by shape_id order by node, s) as p, x, y
  from (
    select shape_id, frame_id, label_id, closed, filled, 0 as node, 0 as s, x, y from {{shape_nodes}} where node = 1
    union all
    select shape_id, frame_id, label_id, closed, filled, node, 0, bx, by_ from {{nexts}}
    where n >= 2 and (closed or not is_end) and out_x = x and out_y = y and bin_x = bx and bin_y = by_
    union all
    select shape_id, frame_id, label_id, closed, filled, node, s, {cubic('x', 'out_x', 'bin_x', 'bx')}, {cubic('y', 'out_y', 'bin_y', 'by_')}
    from (select nx.*, s, s::double / 24.0::double as t from {{nexts}} nx, (select unnest(range(1, 25)) as s) k
          where n >= 2 and (closed or not is_end) and not (out_x = x and out_y = y and bin_x = bx and bin_y = by_)) c
  ) u"""

# Outline edges; ring edges also join the last point to the first.
EDGES = """select shape_id, frame_id, label_id, closed, filled, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2, p,
                  count(*) over (partition by shape_id) as n,
                  first_value(x) over w as fx, first_value(y) over w as fy
           from {flat} window w as (partition by shape_id order by p)"""

RING = "select * replace (coalesce(x2, fx) as x2, coalesce(y2, fy) as y2) from {edges}"

FILL_PX = """
  select frame_id, label_id, shape_id, y, unnest(range(greatest(xa, 0), least(xb, 256))) as x from (
    select *, cast(ceil(cx - 0.5::double) as bigint) as xa, cast(ceil(lead(cx) over w - 0.5::double) as bigint) as xb,
           row_number() over w as k
    from (select frame_id, label_id, shape_id, y, x1 + ((y + 0.5::double) - y1) / (y2 - y1) * (x2 - x1) as cx
          from {ring}, (select unnest(range(0, 128)) as y) rows
          where closed and filled and n >= 2
            and ((y1 <= y + 0.5::double and y2 > y + 0.5::double) or (y2 <= y + 0.5::double and y1 > y + 0.5::double))) c
    window w as (partition by shape_id, y order by cx)) s
  where k % 2 = 1 and xb is not null"""


def dist2(px, py):
    t = f"greatest(0.0::double, least(1.0::double, case when dx * dx + dy * dy > 0 then (({px} - x1) * dx + ({py} - y1) * dy) / (dx * dx + dy * dy) else 0.0::double end))"
    return (
        f"({px} - (x1 + {t} * dx)) * ({px} - (x1 + {t} * dx)) + ({py} - (y1 + {t} * dy)) * ({py} - (y1 + {t} * dy))"
    )


SEGS = "select *, x2 - x1 as dx, y2 - y1 as dy from {edges} where x2 is not null"

STROKE_SHAPE_PX = f"""
  select distinct frame_id, label_id, shape_id, y, x from (
    select *, unnest(range(greatest(floor(least(x1, x2) - 1.5)::bigint, 0), least(ceil(greatest(x1, x2) + 1.5)::bigint, 255) + 1)) as x
    from (select *, unnest(range(greatest(floor(least(y1, y2) - 1.5)::bigint, 0), least(ceil(greatest(y1, y2) + 1.5)::bigint, 127) + 1)) as y
          from {{segs}} where not (closed and filled)) r) b
  where {dist2('(x + 0.5::double)', '(y + 0.5::double)')} <= 2.25"""

EXTRA = {
    **MASKS, "nexts": NEXT, "flat": FLAT, "edges": EDGES, "ring": RING, "segs": SEGS,
    "fill_px": FILL_PX, "stroke_shape_px": STROKE_SHAPE_PX,
}

BOX = """select shape_id, frame_id, label_id, min(x) as bbox_x, min(y) as bbox_y, max(x) - min(x) as bbox_w,
                max(y) - min(y) as bbox_h, count(*) as n from {flat} group by all"""
EXTRA["boxes"] = BOX


def flat(t):
    return G.flatten_shapes(t.shapes)


def boxes(t):
    return flat(t).withColumns(G.polygon_bounds(F.col("points")))


@query("flatten_shapes", "select shape_id, p - 1 as place, round(x, 6) as x, round(y, 6) as y from {flat}", EXTRA)
def _(t):
    listed = flat(t).select("shape_id", F.posexplode("points").alias("place", "p"))
    return listed.select(
        "shape_id",
        F.col("place").cast("long").alias("place"),
        F.round("p.x", 6).alias("x"),
        F.round("p.y", 6).alias("y"),
    )


@query(
    "polygon_bounds",
    "select shape_id, round(bbox_x, 6) as bbox_x, round(bbox_y, 6) as bbox_y, round(bbox_w, 6) as bbox_w, round(bbox_h, 6) as bbox_h from {boxes}",
    EXTRA,
)
def _(t):
    return boxes(t).select("shape_id", *[F.round(c, 6).alias(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")])


@query(
    "polygon_area",
    "select shape_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 4) as area from {ring} group by shape_id",
    EXTRA,
)
def _(t):
    return flat(t).select("shape_id", F.round(G.polygon_area(), 4).alias("area"))


@query(
    "polyline_length",
    "select shape_id, round(coalesce(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 0), 4) as length from {edges} group by shape_id",
    EXTRA,
)
def _(t):
    return flat(t).select("shape_id", F.round(G.polyline_length(), 4).alias("length"))


WINDOWS = """select p_partkey as window_id, 2 * s_suppkey as frame_id, cast(p_partkey % 200 as double) as bbox_x,
                    cast(p_size as double) as bbox_y, 24.0 as bbox_w, 16.0 as bbox_h
             from {part} join {supplier} on s_suppkey = 1 + p_partkey % (select count(*) from {supplier})"""
WINDOWS_CAST = WINDOWS.replace("24.0 as", "cast(24 as double) as").replace("16.0 as", "cast(16 as double) as")


@query(
    "bbox_intersects",
    """select b.shape_id, w.window_id from {boxes} b join {windows} w on b.frame_id = w.frame_id
       and b.bbox_x <= w.bbox_x + w.bbox_w and b.bbox_x + b.bbox_w >= w.bbox_x
       and b.bbox_y <= w.bbox_y + w.bbox_h and b.bbox_y + b.bbox_h >= w.bbox_y""",
    {**EXTRA, "windows": WINDOWS_CAST},
)
def _(t):
    return G.bbox_intersects(
        boxes(t).drop("nodes", "points"), t.sql(WINDOWS_CAST)
    ).select("shape_id", "window_id")


# A click on each frame: where its first order line points.
CLICKS = """select s_suppkey as point_id, 2 * s_suppkey as frame_id, cast(s_suppkey * 37 % 256 as double) + 0.25 as px,
                   cast(s_suppkey * 11 % 128 as double) + 0.25 as py from {supplier}"""
CLICKS = CLICKS.replace("0.25", "cast(0.25 as double)")

INSIDE = """select e.shape_id, c.point_id from {ring} e join {clicks} c on c.frame_id = e.frame_id
            where e.closed and e.n >= 3 and (e.y1 > c.py) <> (e.y2 > c.py)
              and c.px < (e.x1 - e.x2) * (c.py - e.y2) / (e.y1 - e.y2) + e.x2
            group by all having count(*) % 2 = 1"""
NEAR = f"""select shape_id, point_id, sqrt(min(d2)) as distance from (
      select shape_id, point_id, {dist2('px', 'py')} as d2 from {{segs1}} join {{clicks}} using (frame_id)) t
      where d2 <= 64 group by all"""
SEGS1 = """select frame_id, shape_id, x1, y1, dx, dy from {segs}
           union all select frame_id, shape_id, x, y, 0, 0 from {flat}
           where shape_id in (select shape_id from {boxes} where n = 1)"""
EXTRA.update(clicks=CLICKS, inside=INSIDE, near=NEAR, segs1=SEGS1)


@query("point_in_polygon", "select shape_id, point_id from {inside}", EXTRA)
def _(t):
    return G.point_in_polygon(t.shapes, t.sql(CLICKS)).select("shape_id", "point_id")


@query("outlines_near", "select shape_id, point_id, round(distance, 6) as distance from {near}", EXTRA)
def _(t):
    near = G.outlines_near(t.shapes, t.sql(CLICKS), 8.0)
    return near.select("shape_id", "point_id", F.round("distance", 6).alias("distance"))


@query(
    "distance_to_shape",
    f"""select point_id, arg_min(shape_id, (round(distance, 9), shape_id)) as shape_id, round(min(distance), 6) as distance from (
          select shape_id, point_id, sqrt(min({dist2('px', 'py')})) as distance from {{segs1}} join {{clicks}} using (frame_id) group by all) t
        group by 1""",
    EXTRA,
)
def _(t):
    nearest = G.distance_to_shape(t.shapes, t.sql(CLICKS))
    return nearest.select("point_id", "shape_id", F.round("distance", 6).alias("distance"))


@query(
    "pick_shape",
    """select coalesce(b.point_id, n.point_id) as point_id, coalesce(b.shape_id, n.shape_id) as shape_id, b.shape_id is not null as body_hit
       from (select point_id, max(shape_id) as shape_id from {inside} group by 1) b
       full join (select point_id, arg_min(shape_id, (distance, shape_id)) as shape_id from {near} group by 1) n using (point_id)""",
    EXTRA,
)
def _(t):
    return G.pick_shape(t.shapes.withColumn("z", F.col("shape_id")), t.sql(CLICKS), 8.0)


@query(
    "closest_segment",
    f"""select shape_id, (node - 1)::int as segment, round(t, 6) as t, round(distance, 6) as distance from (
          select *, row_number() over (partition by shape_id order by distance, node, t) as rn from (
            select shape_id, node, t, sqrt((cx - 128) * (cx - 128) + (cy - 64) * (cy - 64)) as distance from (
              select shape_id, node, t, {cubic('x', 'out_x', 'bin_x', 'bx')} as cx, {cubic('y', 'out_y', 'bin_y', 'by_')} as cy
              from (select nx.*, s::double / 24.0::double as t from {{nexts}} nx, (select unnest(range(1, 25)) as s) k
                    where n >= 2 and (closed or not is_end)) c) d) e) f where rn = 1""",
    EXTRA,
)
def _(t):
    asked = t.shapes.select(
        "shape_id", F.lit(0).alias("point_id"), F.lit(128.0).alias("px"), F.lit(64.0).alias("py")
    )
    best = G.closest_segment(t.shapes, asked)
    return best.select(
        "shape_id", F.col("segment").cast("int").alias("segment"), F.round("t", 6).alias("t"), F.round("distance", 6).alias("distance")
    )


@query(
    "translate_shapes",
    """select shape_id, node - 1 as place, x + 3 as x, y - 2 as y, in_x + 3 as in_x, out_y - 2 as out_y from {shape_nodes}""",
)
def _(t):
    moved = G.translate_shapes(t.shapes, 3.0, -2.0).select("shape_id", F.posexplode("nodes").alias("place", "n"))
    return moved.select("shape_id", F.col("place").cast("long").alias("place"), "n.x", "n.y", "n.in_x", "n.out_y")


@query(
    "points_to_shape",
    "select shape_id, p - 1 as place, round(x, 6) as x, round(y, 6) as in_y, false as smooth from {flat}",
    EXTRA,
)
def _(t):
    made = G.points_to_shape(flat(t).drop("nodes")).select("shape_id", F.posexplode("nodes").alias("place", "n"))
    return made.select(
        "shape_id", F.col("place").cast("long").alias("place"), F.round("n.x", 6).alias("x"), F.round("n.in_y", 6).alias("in_y"), "n.smooth"
    )


@query("rasterize_filled", to_runs("select * from {fill_px}", "frame_id, label_id, shape_id"), EXTRA)
def _(t):
    return G.rasterize_filled(t.shapes, t.frames)


@query("rasterize_stroked", to_runs("select * from {stroke_shape_px}", "frame_id, label_id, shape_id"), EXTRA)
def _(t):
    return G.rasterize_stroked(t.shapes, t.frames)


@query(
    "bake_shapes",
    to_runs(
        """select frame_id, label_id, y, x from {label_px} union select frame_id, label_id, y, x from {fill_px}
           union select frame_id, label_id, y, x from {stroke_shape_px}""",
        "frame_id, label_id",
    ),
    EXTRA,
)
def _(t):
    return R.bake_shapes(t.mask_runs_raw, G.rasterize_shapes(t.shapes, t.frames, R.FRAME_LABEL))


@query(
    "vector_json",
    """select s.shape_id, s.frame_id, l.name as label, s.closed, s.filled, count(*) as points, round(sum(x), 3) as sum_x
       from {flat} s join {label_defs} l on l.id = s.label_id group by all""",
    EXTRA,
)
def _(t):
    names = t.label_defs.select(F.col("id").alias("label_id"), F.col("name").alias("label_name"))
    written = E.vector_json(flat(t), names)
    # Read back, so that the check sees what a reader of the JSON would.
    doc = F.from_json("json", "label string, closed boolean, filled boolean, polygon array<array<double>>")
    return written.select("shape_id", "frame_id", doc.alias("d")).select(
        "shape_id",
        "frame_id",
        "d.label",
        "d.closed",
        "d.filled",
        F.size("d.polygon").cast("long").alias("points"),
        F.round(F.aggregate("d.polygon", F.lit(0.0), lambda acc, p: acc + p[0]), 3).alias("sum_x"),
    )


# ── the export dispatcher ───────────────────────────────────────────────────

# Frames that are reviewed and have a path, with the path without its ending.
SHOWN = "select id as frame_id, regexp_replace(relative_path, '([^/])[.][^./]*$', '\\1') as bare from {frames} where relative_path is not null"
EXPORTED = {
    **EXTRA,
    "shown": SHOWN,
    "reviewed_files": SHOWN + " and reviewed",
    "own_value": """select distinct frame_id, l.name as label_name, value, y, x from {value_px} join {label_defs} l on l.id = label_id""",
    "drawn_frames": "select distinct frame_id from {shape_nodes}",
    "baked_px": """select frame_id, label_id, y, x from {label_px} union select frame_id, label_id, y, x from {fill_px}
                   union select frame_id, label_id, y, x from {stroke_shape_px}""",
    "baked_map": """select frame_id, y, x, cast(max(label_index) as int) as value from {baked_px} join {label_idx} using (label_id) group by all""",
}


def exported(t, table: str, **options):
    from annotlake.formats import run_export
    from annotlake.queries.component_queries import labelled

    tables = {"frames": t.frames, "labels": labelled(t), "mask_runs": t.mask_runs_raw, "shapes": t.shapes}
    return run_export("masks", tables, options)[table]


@query(
    "export_masks_instance",
    to_runs(
        """select 'individual_masks/' || label_name || '/' || bare || '.png' as file, value, y, x
           from {own_value} join {reviewed_files} using (frame_id)""",
        "file, value",
    ),
    EXPORTED,
)
def _(t):
    return exported(t, "individual_masks", instance=True, bake=True, only_reviewed=True).select("file", "value", "y", "x0", "x1")


@query(
    "export_masks_baked",
    to_runs("select 'combined_masks/' || bare || '.png' as file, value, y, x from {baked_map} join {shown} using (frame_id)", "file, value"),
    EXPORTED,
)
def _(t):
    return exported(t, "combined_masks", bake=True).select("file", "value", "y", "x0", "x1")


@query(
    "vector_documents",
    """select 'vector/' || bare || '.json' as file, count(*)::int as shapes, sum(nodes)::bigint as nodes, sum(points)::bigint as points,
              round(sum(handles), 3) as handles, string_agg(name, ',' order by shape_id) as labels
       from (select shape_id, frame_id, label_id, count(*) as nodes, sum(in_x - out_y) as handles from {shape_nodes} group by all) n
       join (select shape_id, count(*) as points from {flat} group by 1) f using (shape_id)
       join {label_defs} l on l.id = n.label_id join {shown} using (frame_id) group by all""",
    EXPORTED,
)
def _(t):
    kind = f"array<struct<label:string,label_id:long,closed:boolean,filled:boolean,nodes:array<{NODE_JSON}>,polygon:array<array<double>>>>"
    docs = exported(t, "vector").select("file", F.from_json("json", kind).alias("d"))
    total = lambda f: F.aggregate("d", F.lit(0), lambda a, s: a + f(s)).cast("long")
    handles = F.flatten(F.transform("d", lambda s: F.transform(s["nodes"], lambda n: n["inX"] - n["outY"])))
    return docs.select(
        "file",
        F.size("d").alias("shapes"),
        total(lambda s: F.size(s["nodes"])).alias("nodes"),
        total(lambda s: F.size(s["polygon"])).alias("points"),
        F.round(F.aggregate(handles, F.lit(0.0), lambda a, h: a + h), 3).alias("handles"),
        F.array_join(F.transform("d", lambda s: s["label"]), ",").alias("labels"),
    )
