"""Run algebra against pixel-level SQL."""

from __future__ import annotations

from annotlake.operators import runs as R
from annotlake.queries.registry import query


def to_runs(pixels: str, keys: str) -> str:
    """SQL: maximal runs of a pixel set (distinct ``keys, y, x``)."""
    return f"""
        select {keys}, cast(y as bigint) as y, cast(min(x) as bigint) as x0, cast(max(x) + 1 as bigint) as x1
        from (select {keys}, y, x, x - row_number() over (partition by {keys}, y order by x) as island
              from ({pixels}) p) q
        group by {keys}, y, island"""


EXTRA = {
    "label_px": "select distinct frame_id, label_id, y, unnest(range(x0, x1)) as x from {mask_runs_raw}",
    "value_px": "select distinct frame_id, label_id, value, y, unnest(range(x0, x1)) as x from {mask_runs_raw}",
    "stroke_px": "select distinct frame_id, y, unnest(range(x0, x1)) as x from {stroke_runs}",
    "label_idx": "select id as label_id, name, color, is_instance, row_number() over (order by sort_order) as label_index from {label_defs}",
    # One value per pixel and label: the largest one laid over it.
    "held_px": "select frame_id, label_id, y, x, max(value) as value from {value_px} group by all",
    "index_px": """select frame_id, y, x, cast(max(label_index) as int) as value
                   from {label_px} join {label_idx} using (label_id) group by all""",
    "swap_px": """
        select s.frame_id, s.y, s.x from {stroke_px} s
        semi join {label_px} m on m.frame_id = s.frame_id and m.y = s.y and m.x = s.x""",
}

RUN = "frame_id, label_id, cast(value as int) as value, y, x0, x1"


def held_runs(t):
    """A disjoint valued mask: where raw runs of a label overlap, the largest value stays."""
    import pyspark.sql.functions as F

    from annotlake.plans.sweep import run_ends, sweep

    single = R.normalize_runs(t.mask_runs_raw)
    bits = {"held": F.call_function("shiftleft", F.lit(1).cast("long"), F.col("value").cast("int"))}
    top = F.when(F.col("held") > 0, (F.length(F.bin("held")) - 1).cast("int"))
    return sweep(run_ends(single, R.FRAME_LABEL, bits), R.FRAME_LABEL, ["held"], top)


def label_index(t):
    from annotlake.operators.catalog import label_index as numbered

    return numbered(t.label_defs).select(
        "label_id", "label_index"
    )


@query("normalize_runs", to_runs("select * from {value_px}", "frame_id, label_id, value"), EXTRA)
def _(t):
    return R.normalize_runs(t.mask_runs_raw)


@query(
    "mask_area_bbox",
    """select frame_id, label_id, count(*) as area, min(x) as bbox_x, min(y) as bbox_y,
              max(x) - min(x) + 1 as bbox_w, max(y) - min(y) + 1 as bbox_h from {label_px} group by all""",
    EXTRA,
)
def _(t):
    return R.mask_area_bbox(R.presence(t.mask_runs_raw))


@query(
    "regions_by_instance",
    """select frame_id, label_id, value, count(*) as area, min(x) as bbox_x, min(y) as bbox_y,
              max(x) - min(x) + 1 as bbox_w, max(y) - min(y) + 1 as bbox_h from {value_px} group by all""",
    EXTRA,
)
def _(t):
    return R.regions_by_instance(t.mask_runs_raw)


@query("union_presence", to_runs("select distinct frame_id, y, x from {label_px}", "frame_id"), EXTRA)
def _(t):
    return R.union_presence(t.mask_runs_raw)


@query(
    "write_runs",
    to_runs(
        """select coalesce(m.frame_id, s.frame_id) as frame_id, coalesce(m.label_id, s.label_id) as label_id,
                  case when s.x is not null then 9 else m.value end as value, coalesce(m.y, s.y) as y,
                  coalesce(m.x, s.x) as x
           from {held_px} m full join (select frame_id, 78 as label_id, y, x from {stroke_px}) s
             on m.frame_id = s.frame_id and m.label_id = s.label_id and m.y = s.y and m.x = s.x""",
        "frame_id, label_id, value",
    ),
    EXTRA,
)
def _(t):
    import pyspark.sql.functions as F

    return R.write_runs(held_runs(t), t.stroke_runs.withColumn("label_id", F.lit(78)), 9)


@query(
    "erase_runs",
    to_runs(
        """select m.* from {held_px} m anti join {stroke_px} s
             on m.frame_id = s.frame_id and m.y = s.y and m.x = s.x""",
        "frame_id, label_id, value",
    ),
    EXTRA,
)
def _(t):
    held = held_runs(t)
    return R.erase_runs(held, R.on_every_label(held, t.stroke_runs))


@query(
    "swap_label_runs",
    to_runs(
        """select m.frame_id, m.label_id, m.value, m.y, m.x from {held_px} m anti join {swap_px} s
             on m.frame_id = s.frame_id and m.y = s.y and m.x = s.x
           union all select frame_id, 65, 3, y, x from {swap_px}""",
        "frame_id, label_id, value",
    ),
    EXTRA,
)
def _(t):
    return R.swap_label_runs(held_runs(t), t.stroke_runs, 65, 3)


@query("combined_index_map", to_runs("select * from {index_px}", "frame_id, value"), EXTRA)
def _(t):
    return R.combined_index_map(t.mask_runs_raw, label_index(t))


MAP_COLOR = """select label_index,
    case when length(ltrim(color, '#')) >= 6 then coalesce(try_cast('0x' || substr(ltrim(color, '#'), 1, 2) as int), 128) else 128 end as r,
    case when length(ltrim(color, '#')) >= 6 then coalesce(try_cast('0x' || substr(ltrim(color, '#'), 3, 2) as int), 128) else 128 end as g,
    case when length(ltrim(color, '#')) >= 6 then coalesce(try_cast('0x' || substr(ltrim(color, '#'), 5, 2) as int), 128) else 128 end as b
  from {label_idx}"""


@query(
    "colormap_map",
    "select frame_id, y, x0, x1, r, g, b from ("
    + to_runs("select * from {index_px}", "frame_id, value")
    + ") join {map_color} on label_index = value",
    {**EXTRA, "map_color": MAP_COLOR},
)
def _(t):
    from annotlake.operators.exports import map_colors

    index = label_index(t)
    return R.colormap_map(
        R.combined_index_map(t.mask_runs_raw, index),
        map_colors(t.label_defs.withColumnRenamed("id", "label_id").join(index, "label_id")),
    )


@query(
    "mask_edges",
    to_runs(
        """select c.frame_id, c.value, c.y, c.x from {index_px} c
           left join {index_px} l on l.frame_id = c.frame_id and l.y = c.y and l.x = c.x - 1
           left join {index_px} r on r.frame_id = c.frame_id and r.y = c.y and r.x = c.x + 1
           left join {index_px} u on u.frame_id = c.frame_id and u.y = c.y - 1 and u.x = c.x
           left join {index_px} d on d.frame_id = c.frame_id and d.y = c.y + 1 and d.x = c.x
           where l.value is distinct from c.value or r.value is distinct from c.value
              or u.value is distinct from c.value or d.value is distinct from c.value""",
        "frame_id, value",
    ),
    EXTRA,
)
def _(t):
    return R.mask_edges(R.combined_index_map(t.mask_runs_raw, label_index(t)))


@query(
    "mask_edges_radius",
    to_runs(
        """select frame_id, value, y, x from (
             select c.frame_id, c.value, c.y, c.x, count(n.x) as same
             from {index_px} c, (select unnest(range(-2, 3)) as dy) a, (select unnest(range(-2, 3)) as dx) b
             left join {index_px} n on n.frame_id = c.frame_id and n.value = c.value
                                    and n.y = c.y + dy and n.x = c.x + dx
             group by all) t where same < 25""",
        "frame_id, value",
    ),
    EXTRA,
)
def _(t):
    return R.mask_edges(R.combined_index_map(t.mask_runs_raw, label_index(t)), 2)


@query(
    "downsample_presence",
    to_runs("select distinct frame_id, label_id, y // 4 as y, x // 4 as x from {label_px}", "frame_id, label_id"),
    EXTRA,
)
def _(t):
    return R.downsample_presence(t.mask_runs_raw, 4)


@query(
    "crop_tile",
    to_runs(
        """select frame_id, label_id, value, y - 40 as y, x - 100 as x from {value_px}
           where y >= 40 and y < 104 and x >= 100 and x < 228""",
        "frame_id, label_id, value",
    ),
    EXTRA,
)
def _(t):
    return R.crop_tile(R.normalize_runs(t.mask_runs_raw), 100, 40, 128, 64)


DISK = "(select dx, dy from (select unnest(range(-2, 3)) as dx) a, (select unnest(range(-2, 3)) as dy) b where dx * dx + dy * dy <= 4) d"


@query(
    "dilate",
    to_runs(
        f"""select distinct frame_id, label_id, y + dy as y, x + dx as x from {{label_px}}, {DISK}
            where y + dy >= 0 and y + dy < 128 and x + dx >= 0 and x + dx < 256""",
        "frame_id, label_id",
    ),
    EXTRA,
)
def _(t):
    return R.dilate(t.mask_runs_raw, t.frames, 5)


ERODED = f"""select frame_id, label_id, y, x from (
    select c.frame_id, c.label_id, c.y + d.dy as y, c.x + d.dx as x from {{label_px}} c, {DISK}) h
    group by all having count(*) = 13"""


@query("erode", to_runs(ERODED, "frame_id, label_id"), EXTRA)
def _(t):
    return R.erode(t.mask_runs_raw, 5)


@query(
    "close_mask",
    to_runs(
        f"""select frame_id, label_id, y, x from (
              select c.frame_id, c.label_id, c.y + d.dy as y, c.x + d.dx as x from {{grown_px}} c, {DISK}) h
            group by all having count(*) = 13""",
        "frame_id, label_id",
    ),
    {
        **EXTRA,
        "grown_px": f"""select distinct frame_id, label_id, y + dy as y, x + dx as x from {{label_px}}, {DISK}
            where y + dy >= 0 and y + dy < 128 and x + dx >= 0 and x + dx < 256""",
    },
)
def _(t):
    return R.close_mask(t.mask_runs_raw, t.frames, 2)


@query(
    "next_instance_id",
    """select frame_id, label_id, shape_id,
              cast(coalesce(used, 0) + row_number() over (partition by frame_id, label_id order by shape_id) as int)
                as instance_id
       from (select distinct frame_id, label_id, shape_id from {shape_nodes}) s
       left join (select frame_id, label_id, max(value) as used from {mask_runs_raw} group by all) m
         using (frame_id, label_id)""",
    EXTRA,
)
def _(t):
    return R.next_instance_id(t.mask_runs_raw, t.shapes)


@query(
    "individual_masks",
    to_runs(
        """select distinct frame_id, name as label_name,
                  cast(case when is_instance then value else 255 end as int) as value, y, x
           from {value_px} join {label_idx} using (label_id)""",
        "frame_id, label_name, value",
    ),
    EXTRA,
)
def _(t):
    return R.individual_masks(t.mask_runs_raw, t.label_defs.withColumnRenamed("id", "label_id"))
