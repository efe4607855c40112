"""Components and object export against recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from annotlake.operators import components as P
from annotlake.operators import runs as R
from annotlake.queries.mask_queries import EXTRA as MASKS
from annotlake.queries.mask_queries import held_runs, label_index, to_runs
from annotlake.queries.registry import query


def parts(runs: str, keys: str, near: str = "a.x0 <= b.x1 and b.x0 <= a.x1") -> dict[str, str]:
    """CTEs labelling the runs of table ``runs`` with their component (smallest run place)."""
    same = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    mine = " and ".join(f"c.{k} = r.{k}" for k in keys.split(", "))
    listed = ", ".join(f"r.{k}" for k in keys.split(", "))
    return {
        f"{runs}_placed": f"select *, y * 4294967296 + x0 as pos from {{{runs}}}",
        f"{runs}_down": f"select {', '.join('a.' + k for k in keys.split(', '))}, a.pos as p, b.pos as q from {{{runs}_placed}} a join {{{runs}_placed}} b on {same} and b.y = a.y + 1 and {near}",
        f"{runs}_touch": f"select {keys}, p, q from {{{runs}_down}} union all select {keys}, q, p from {{{runs}_down}}",
        f"{runs}_reach": f"""select {keys}, pos, pos as root from {{{runs}_placed}}
            union select {listed}, c.q, r.root from {runs}_reach r join {{{runs}_touch}} c on {mine} and c.p = r.pos and c.q > r.root""",
        f"{runs}_part": f"""select p.*, m.component from {{{runs}_placed}} p
            join (select {keys}, pos, min(root) as component from {{{runs}_reach}} group by all) m using ({keys}, pos)""",
    }


EXTRA = {
    **MASKS,
    "pres": to_runs("select * from {label_px}", "frame_id, label_id"),
    "vals": to_runs("select * from {held_px}", "frame_id, label_id, value"),
    "uni": to_runs("select distinct frame_id, y, x from {label_px}", "frame_id"),
    "coarse": to_runs("select distinct frame_id, label_id, y // 3 as y, x // 3 as x from {label_px}", "frame_id, label_id"),
    "fill_part_px": "select frame_id, label_id, component, y, unnest(range(x0, x1)) as x from {pres_part}",
}
EXTRA |= parts("pres", "frame_id, label_id")
EXTRA |= parts("vals", "frame_id, label_id, value")
EXTRA |= parts("uni", "frame_id")
EXTRA |= parts("coarse", "frame_id, label_id")

BOXED = """cast(sum(x1 - x0) as bigint) as area, min(x0) as bbox_x, min(y) as bbox_y,
           max(x1) - min(x0) as bbox_w, max(y) - min(y) + 1 as bbox_h"""


@query(
    "connected_components", "select frame_id, label_id, y, x0, x1, component from {pres_part}", EXTRA
)
def _(t):
    return P.connected_components(t.mask_runs_raw)


@query("component_regions", f"select frame_id, label_id, component, {BOXED} from {{pres_part}} group by all", EXTRA)
def _(t):
    return P.component_regions(P.connected_components(t.mask_runs_raw))


@query("value_components", "select frame_id, label_id, value, y, x0, x1, component from {vals_part}", EXTRA)
def _(t):
    return P.value_components(held_runs(t))


# Seeds: one pixel per order line's frame and label, wherever the part number points.
SEEDS = """select distinct 2 * l_suppkey as frame_id, ascii(l_returnflag) as label_id, l_partkey % 128 as y, l_orderkey % 224 as x
           from {lineitem}"""
SEEDED = {**EXTRA, "seeds": SEEDS}

SEED_PARTS = """select distinct v.frame_id, v.label_id, v.value, v.component from {vals_part} v join {seeds} s
    on s.frame_id = v.frame_id and s.label_id = v.label_id and s.y = v.y and v.x0 <= s.x and s.x < v.x1"""


@query(
    "component_at_seed",
    """select s.y * 1000 + s.x as seed, v.frame_id, v.label_id, v.value, v.component, v.y, v.x0, v.x1
       from {seeds} s join {vals_part} h on s.frame_id = h.frame_id and s.label_id = h.label_id and s.y = h.y and h.x0 <= s.x and s.x < h.x1
       join {vals_part} v on v.frame_id = h.frame_id and v.label_id = h.label_id and v.value = h.value and v.component = h.component""",
    SEEDED,
)
def _(t):
    seeds = t.sql(SEEDS).withColumn("seed", F.col("y") * 1000 + F.col("x"))
    return P.component_at_seed(held_runs(t), seeds)


@query(
    "clear_component",
    f"select frame_id, label_id, value, y, x0, x1 from {{vals_part}} anti join ({SEED_PARTS}) g using (frame_id, label_id, value, component)",
    SEEDED,
)
def _(t):
    return P.clear_component(held_runs(t), t.sql(SEEDS))


@query(
    "clear_component_presence",
    to_runs(
        """select h.* from {held_px} h anti join (
             select f.* from {fill_part_px} f join (
               select distinct v.frame_id, v.label_id, v.component from {pres_part} v join {seeds} s
                 on s.frame_id = v.frame_id and s.label_id = v.label_id and s.y = v.y and v.x0 <= s.x and s.x < v.x1) g
             using (frame_id, label_id, component)) d using (frame_id, label_id, y, x)""",
        "frame_id, label_id, value",
    ),
    SEEDED,
)
def _(t):
    return P.clear_component(held_runs(t), t.sql(SEEDS), by_value=False)


TOUCHED = """select distinct p.frame_id, p.component from {uni_part} p join {stroke_runs} s
             on s.frame_id = p.frame_id and s.y = p.y and s.x0 < p.x1 and p.x0 < s.x1"""


@query(
    "erase_touched_components",
    to_runs(
        f"""select h.* from {{held_px}} h anti join (
              select frame_id, y, unnest(range(x0, x1)) as x from {{uni_part}} semi join ({TOUCHED}) g using (frame_id, component)) d
            using (frame_id, y, x)""",
        "frame_id, label_id, value",
    ),
    EXTRA,
)
def _(t):
    return P.erase_touched_components(held_runs(t), t.stroke_runs, across_labels=True)


@query(
    "largest_component",
    """select frame_id, label_id, y, x0, x1, component from {pres_part} semi join (
         select frame_id, label_id, component from (
           select *, row_number() over (partition by frame_id, label_id order by area desc, ly desc, lx desc) as rn from (
             select frame_id, label_id, component, sum(x1 - x0) as area, max(y) as ly, arg_max(x1, (y, x1)) as lx
             from {pres_part} group by all) s) r where rn = 1) b using (frame_id, label_id, component)""",
    EXTRA,
)
def _(t):
    return P.largest_component(P.connected_components(t.mask_runs_raw))


@query(
    "approx_component_boxes",
    """select frame_id, label_id, 3 * min(x0) as bbox_x, 3 * min(y) as bbox_y, 3 * (max(x1) - min(x0)) as bbox_w,
              3 * (max(y) - min(y) + 1) as bbox_h from {coarse_part} group by frame_id, label_id, component""",
    EXTRA,
)
def _(t):
    return P.approx_component_boxes(t.mask_runs_raw, 3)


REGIONS = f"""
    select frame_id, label_id, label_index, component as part, {BOXED} from {{pres_part}} join {{label_idx}} using (label_id)
    where not is_instance group by all
    union all
    select frame_id, label_id, label_index, value, count(*), min(x), min(y), max(x) - min(x) + 1, max(y) - min(y) + 1
    from {{value_px}} join {{label_idx}} using (label_id) where is_instance group by all"""
EXTRA["regions"] = REGIONS


def labelled(t):
    """label_id, label_index, name, is_instance."""
    return label_index(t).join(t.label_defs.withColumnRenamed("id", "label_id"), "label_id")


@query("mask_regions", "select * from {regions}", EXTRA)
def _(t):
    return P.mask_regions(t.mask_runs_raw, labelled(t))
