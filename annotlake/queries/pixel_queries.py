"""Pixel statistics, colour and registration with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from annotlake.operators import pixels as X
from annotlake.operators import registration as G
from annotlake.queries.mask_queries import to_runs
from annotlake.queries.registry import query

HIST = """select frame_id, channel, v, count(*) as n from (
    select frame_id, 'r' as channel, r as v from {pixels} union all select frame_id, 'g', g from {pixels}
    union all select frame_id, 'b', b from {pixels}
    union all select frame_id, 'luma', (54 * r + 183 * g + 19 * b) >> 8 from {pixels}) t group by all"""
CUM = """select *, sum(n) over (partition by frame_id, channel order by v) as cum,
                sum(n) over (partition by frame_id, channel) as total from {hist}"""
ENDS = """select frame_id, channel, min(v) filter (cum >= total * 0.05::double) as lo,
                 min(v) filter (cum >= total * 0.95::double) as hi from {cum} group by all"""
NODES = """select frame_id, channel, (floor(y0 + 0.5))::double as y0, (floor(y1 + 0.5))::double as y1, (floor(y2 + 0.5))::double as y2, (floor(y3 + 0.5))::double as y3 from (
    select frame_id, channel, (c0 - f) / s * 255 as y0, (c85 - f) / s * 255 as y1, (c170 - f) / s * 255 as y2, (c255 - f) / s * 255 as y3
    from (select frame_id, channel, sum(n) filter (v <= 0) as c0_, coalesce(sum(n) filter (v <= 0), 0)::double as c0,
                 coalesce(sum(n) filter (v <= 85), 0)::double as c85, coalesce(sum(n) filter (v <= 170), 0)::double as c170,
                 sum(n)::double as c255, arg_min(n, v)::double as f, greatest(1, sum(n) - arg_min(n, v))::double as s
          from {hist} group by all) a) b"""
CLAMPED = """select frame_id, channel, """ + ", ".join(f"greatest(0, least(255, y{i})) as y{i}" for i in range(4)) + " from {nodes}"


def fix(i: int, j: int, d: str) -> str:
    """One settling step of the tangents m<i>, m<j> around slope d."""
    sq = f"(m{i} * m{i} + m{j} * m{j}) / ({d} * {d})"
    return (
        f"case when {d} = 0 then 0 when {sq} > 9 then 3 / sqrt({sq}) * m{i} else m{i} end as m{i}, "
        f"case when {d} = 0 then 0 when {sq} > 9 then 3 / sqrt({sq}) * m{j} else m{j} end as m{j}"
    )


def tangents() -> dict[str, str]:
    keep = "frame_id, channel, y0, y1, y2, y3, d0, d1, d2"
    return {
        "slopes": "select *, (y1 - y0) / 85.0::double as d0, (y2 - y1) / 85.0::double as d1, (y3 - y2) / 85.0::double as d2 from {clamped}",
        "t0": f"""select {keep}, d0 as m0, case when d0 * d1 <= 0 then 0::double else (d0 + d1) / 2 end as m1,
                  case when d1 * d2 <= 0 then 0::double else (d1 + d2) / 2 end as m2, d2 as m3 from {{slopes}}""",
        "t1": f"select {keep}, {fix(0, 1, 'd0')}, m2, m3 from {{t0}}",
        "t2": f"select {keep}, m0, {fix(1, 2, 'd1')}, m3 from {{t1}}",
        "t3": f"select {keep}, m0, m1, {fix(2, 3, 'd2')} from {{t2}}",
    }


SEGMENT = """select frame_id, channel, v, greatest(0, least(255, floor(y + 0.5)))::int as out from (
    select frame_id, channel, v, case when t = 0 then a when t = 1 then b else
        (2 * t * t * t - 3 * t * t + 1) * a + (t * t * t - 2 * t * t + t) * 85 * ma
        + (3 * t * t - 2 * t * t * t) * b + (t * t * t - t * t) * 85 * mb end as y
    from (select frame_id, channel, v::int as v, (v - 85 * k) / 85.0::double as t,
                 case k when 0 then y0 when 1 then y1 else y2 end as a, case k when 0 then y1 when 1 then y2 else y3 end as b,
                 case k when 0 then m0 when 1 then m1 else m2 end as ma, case k when 0 then m1 when 1 then m2 else m3 end as mb
          from (select *, case when v <= 85 then 0 when v <= 170 then 1 else 2 end as k
                from {t3}, (select unnest(range(0, 256)) as v) s) p) q) r"""

STRETCH = """select frame_id, channel, lo, hi,
    case when hi <= lo then 0 else greatest(-100, least(100, (128 - (lo + hi) / 2.0::double) / 2.55::double)) end as brightness,
    case when hi <= lo then 0 else greatest(-100, least(100, 255 * (259 * (255.0::double / (hi - lo)) - 259) / (259 * (255.0::double / (hi - lo)) + 255))) end as contrast
  from {ends}"""

LUT = """select b.frame_id, b.channel, b.v, c.out from (
    select frame_id, channel, v::int as v, greatest(0, least(255, floor(255 * power(greatest(0, least(255, g)) / 255, 1 / 1.2::double) + 0.5)))::int as mid from (
      select frame_id, channel, v, 259 * (contrast + 255) / (255 * (259 - contrast)) * (v + brightness * 2.55::double - 128) + 128 as g
      from {stretch}, (select unnest(range(0, 256)) as v) s) a) b
  join {curve} c on c.frame_id = b.frame_id and c.channel = b.channel and c.v = b.mid"""

EXTRA = {"hist": HIST, "cum": CUM, "ends": ENDS, "nodes": NODES, "clamped": CLAMPED, **tangents(), "curve": SEGMENT, "stretch": STRETCH, "lut": LUT}


def hist(t):
    return X.channel_histogram(t.pixels)


def lut(t):
    adjusted = X.auto_stretch(hist(t)).withColumn("gamma", F.lit(1.2))
    return X.channel_lut(adjusted, X.curve_table(X.equalize_curve(hist(t))))


@query("channel_histogram", "select * from {hist}", EXTRA)
def _(t):
    return hist(t)


@query(
    "hist_percentile", "select frame_id, channel, min(v) as value from {cum} where cum >= total * 0.05::double group by all", EXTRA
)
def _(t):
    return X.hist_percentile(hist(t), 0.05)


@query(
    "auto_stretch", "select frame_id, channel, lo, hi, round(brightness, 6) as brightness, round(contrast, 6) as contrast from {stretch}", EXTRA
)
def _(t):
    return X.auto_stretch(hist(t)).withColumns({c: F.round(c, 6) for c in ("brightness", "contrast")})


@query("equalize_curve", "select frame_id, channel, y0, y1, y2, y3 from {clamped}", EXTRA)
def _(t):
    curve = X.equalize_curve(hist(t))
    return curve.select("frame_id", "channel", *[F.col("nodes")[i]["y"].alias(f"y{i}") for i in range(4)])


@query("curve_table", "select * from {curve}", EXTRA)
def _(t):
    return X.curve_table(X.equalize_curve(hist(t)))


@query("channel_lut", "select * from {lut}", EXTRA)
def _(t):
    return lut(t)


@query(
    "apply_lut",
    """select frame_id, y, x, max(o) filter (channel = 'r') as r, max(o) filter (channel = 'g') as g, max(o) filter (channel = 'b') as b
       from (select p.frame_id, p.y, p.x, p.channel, m.o from {long_px} p join {pair_lut} m
               on m.frame_id = p.frame_id and m.channel = p.channel and m.v = p.v) t group by all""",
    {
        **EXTRA,
        "long_px": """select frame_id, y, x, 'r' as channel, r as v from {pixels} union all select frame_id, y, x, 'g', g from {pixels}
                      union all select frame_id, y, x, 'b', b from {pixels}""",
        "own": "select * from {lut} where channel <> 'luma'",
        "top": "select frame_id, v, out from {lut} where channel = 'luma'",
        "pair_lut": "select o.frame_id, o.channel, o.v, t.out as o from {own} o join {top} t on t.frame_id = o.frame_id and t.v = o.out",
    },
)
def _(t):
    return X.apply_lut(t.pixels, lut(t))


@query("mean_intensity", "select frame_id, round(avg((r + g + b) / 3.0::double), 6) as mean_intensity from {pixels} group by 1")
def _(t):
    return X.mean_intensity(t.pixels).withColumn("mean_intensity", F.round("mean_intensity", 6))


# A stroke over every image: the pixels whose red lies in the upper part of their image.
STROKE = """select p.frame_id, y, x as x0, x + 1 as x1 from {pixels} p
            join (select frame_id, avg(r) - 10 as m from {pixels} group by 1) a using (frame_id) where p.r >= m"""
OTSU = """select frame_id, coalesce(arg_max(v, (variance, -v)) filter (variance > 0), 0)::int as threshold from (
    select frame_id, v, case when total > w then ((av * w - lv * total)::double * (av * w - lv * total)::double) / (w::double * (total - w)::double) end as variance
    from (select frame_id, v, sum(n) over p as total, sum(n) over o as w, sum(v * n) over p as av, sum(v * n) over o as lv
          from (select frame_id, v, count(*)::bigint as n from {gray} group by all) h
          window p as (partition by frame_id), o as (partition by frame_id order by v)) s) t group by 1"""
GRAY = """select p.frame_id, p.y, p.x, (floor((2126 * p.r + 7152 * p.g + 722 * p.b) / 10000))::int as v
          from {pixels} p join {pen} s on s.frame_id = p.frame_id and s.y = p.y and s.x0 = p.x"""
OTSU_EXTRA = {"pen": STROKE, "gray": GRAY, "otsu": OTSU}


@query("otsu_threshold", "select * from {otsu}", OTSU_EXTRA)
def _(t):
    inside = X.masked_pixels(t.pixels, t.sql(STROKE))
    values = inside.select("frame_id", X.otsu_gray(inside).cast("int").alias("v"), F.lit(1).alias("n"))
    return X.otsu_threshold(values)


@query(
    "otsu_refine", to_runs("select frame_id, y, x from {gray} join {otsu} using (frame_id) where v > threshold", "frame_id"), OTSU_EXTRA
)
def _(t):
    return X.otsu_refine(t.pixels, t.sql(STROKE), t.frames)[0]


# The same mask closed with a disk of radius 2 and cut to its largest component, the last in raster order on ties.
DISK2 = "(select unnest(range(-2, 3)) as dy) cross join (select unnest(range(-2, 3)) as dx)"
CONNECTED = {
    **OTSU_EXTRA,
    "over": "select frame_id, y, x from {gray} join {otsu} using (frame_id) where v > threshold",
    "size": "select frame_id, max(x) + 1 as w, max(y) + 1 as h from {pixels} group by 1",
    "grown": f"""select distinct frame_id, y + dy as y, x + dx as x from {{over}} join {{size}} using (frame_id), {DISK2}
                 where dy * dy + dx * dx <= 4 and y + dy >= 0 and y + dy < h and x + dx >= 0 and x + dx < w""",
    "shut": f"""select frame_id, y, x from (select frame_id, y + dy as y, x + dx as x from {{grown}}, {DISK2} where dy * dy + dx * dx <= 4)
                group by all having count(*) = 13""",
    "near": """select frame_id, y, x, y * 4294967296 + x as root from {shut} union
               select s.frame_id, s.y, s.x, n.root from near n join {shut} s
               on s.frame_id = n.frame_id and abs(s.y - n.y) <= 1 and abs(s.x - n.x) <= 1 and s.y * 4294967296 + s.x > n.root""",
    "rooted": "select frame_id, y, x, min(root) as root from {near} group by all",
    "largest": """select frame_id, root from (select *, row_number() over (partition by frame_id order by n desc, last desc) as place from (
                  select frame_id, root, count(*) as n, max(y * 4294967296 + x) as last from {rooted} group by all)) where place = 1""",
}


@query("otsu_refine_connected", to_runs("select frame_id, y, x from {rooted} semi join {largest} using (frame_id, root)", "frame_id"), CONNECTED)
def _(t):
    """Closed with radius 2 and cut to the largest component."""
    sizes = t.pixels.groupBy(F.col("frame_id").alias("id")).agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")
    )
    return X.otsu_refine(t.pixels, t.sql(STROKE), sizes, False, True, 2, True)[0]


def lin(c):
    return f"case when {c} / 255.0::double > 0.04045 then power(({c} / 255.0::double + 0.055) / 1.055, 2.4) else {c} / 255.0::double / 12.92 end"


def resp(v):
    return f"case when {v} > 0.008856 then power({v}, 1.0::double / 3.0::double) else 7.787 * {v} + 0.137931 end"


LAB = f"""select frame_id, y, x, 116.0 * fy - 16.0 as l, 500.0 * (fx - fy) as a, 200.0 * (fy - fz) as lab_b from (
    select frame_id, y, x, {resp('cx')} as fx, {resp('cy')} as fy, {resp('cz')} as fz from (
      select frame_id, y, x, (lr * 0.4124564::double + lg * 0.3575761::double + lb * 0.1804375::double) / 0.95047::double as cx,
             lr * 0.2126729::double + lg * 0.7151522::double + lb * 0.0721750::double as cy,
             (lr * 0.0193339::double + lg * 0.1191920::double + lb * 0.9503041::double) / 1.08883::double as cz
      from (select frame_id, y, x, {lin('r')} as lr, {lin('g')} as lg, {lin('b')} as lb from {{pixels}}) p) q) s"""


def delta_sql(source: str) -> str:
    """CIEDE2000 in degrees with hue angles from dot and cross products; every step is kept as a table."""
    weight = lambda x: f"sqrt({x} ** 7 / ({x} ** 7 + 25.0::double ** 7))"
    return f"""with s0 as materialized ({source}),
      s1 as materialized (select *, 0.5::double * (3 - {weight('((sqrt(a1 ** 2 + b1 ** 2) + sqrt(a2 ** 2 + b2 ** 2)) / 2)')}) as stretch from s0),
      s2 as materialized (select *, a1 * stretch as u1, a2 * stretch as u2 from s1),
      s3 as materialized (select *, sqrt(u1 ** 2 + b1 ** 2) as k1, sqrt(u2 ** 2 + b2 ** 2) as k2,
                                 degrees(atan2(u1 * b2 - u2 * b1, u1 * u2 + b1 * b2)) as apart from s2),
      s4 as materialized (select *, (k1 + k2) / 2 as k, (l1 + l2) / 2 as lum,
                                 degrees(atan2(b1, u1)) + apart / 2 + case when degrees(atan2(b1, u1)) + apart / 2 < 0 then 360 else 0 end as m from s3),
      s5 as materialized (select *, case when m >= 360 then m - 360 else m end as mean_hue from s4),
      s6 as materialized (select *, (l2 - l1) / (1 + 0.015::double * (lum - 50) ** 2 / sqrt(20 + (lum - 50) ** 2)) as d_light,
          (k2 - k1) / (1 + 0.045::double * k) as d_chroma,
          2 * sqrt(k1 * k2) * sin(radians(apart / 2)) / (1 + 0.015::double * k * (1 - 0.17::double * cos(radians(mean_hue - 30))
            + 0.24::double * cos(radians(2 * mean_hue)) + 0.32::double * cos(radians(3 * mean_hue + 6)) - 0.2::double * cos(radians(4 * mean_hue - 63)))) as d_tone,
          -{weight('k')} * 2 * sin(radians(60 * exp(-(((mean_hue - 275) / 25) ** 2)))) as turn_back from s5)
      select * exclude (d_light, d_chroma, d_tone, stretch, u1, u2, k1, k2, apart, k, lum, m, mean_hue, turn_back), sqrt(greatest(d_light ** 2 + d_chroma ** 2 + d_tone ** 2 + turn_back * d_chroma * d_tone, 0)) as delta_e from s6"""


SEED = "select vec_id as frame_id, 0 as seed_id, label % 8 as x, vec_id % 8 as y from {embeddings}"
ALIKE = (
    "select frame_id, seed_id, y, x from ("
    + delta_sql(
        """select p.frame_id, s.seed_id, p.y, p.x, o.l as l1, o.a as a1, o.lab_b as b1, p.l as l2, p.a as a2, p.lab_b as b2
           from {lab} p join {seed} s on s.frame_id = p.frame_id join {lab} o on o.frame_id = s.frame_id and o.x = s.x and o.y = s.y"""
    )
    + ") where round(delta_e, 6) <= 14"
)
LAB_EXTRA = {"lab": LAB, "seed": SEED, "alike": ALIKE}


@query("rgb_to_lab", "select frame_id, y, x, round(l, 5) as l, round(a, 5) as a, round(lab_b, 5) as lab_b from {lab}", LAB_EXTRA)
def _(t):
    return X.with_lab(t.pixels).select(
        "frame_id", "y", "x", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("l", "a", "lab_b")]
    )


NEXT_LAB = """select a.frame_id, a.y, a.x, a.l as l1, a.a as a1, a.lab_b as b1, b.l as l2, b.a as a2, b.lab_b as b2
              from {lab} a join {lab} b on b.frame_id = a.frame_id and b.y = a.y and b.x = a.x + 1"""


@query("ciede2000", f"select frame_id, y, x, round(delta_e, 5) as delta_e from ({delta_sql(NEXT_LAB)})", LAB_EXTRA)
def _(t):
    from annotlake.functions.color import with_delta_e

    lab = X.with_lab(t.pixels)
    left = lab.select("frame_id", "y", "x", F.col("l").alias("l1"), F.col("a").alias("a1"), F.col("lab_b").alias("b1"))
    right = lab.select(
        "frame_id", "y", (F.col("x") - 1).alias("x"), F.col("l").alias("l2"), F.col("a").alias("a2"), F.col("lab_b").alias("b2")
    )
    return with_delta_e(left.join(right, ["frame_id", "y", "x"])).select(
        "frame_id", "y", "x", F.round("delta_e", 5).alias("delta_e")
    )


FILL_REACH = """select frame_id, seed_id, y, x from {seed} semi join {alike} using (frame_id, seed_id, y, x)
    union select a.frame_id, a.seed_id, a.y, a.x from reach r join {alike} a
      on a.frame_id = r.frame_id and a.seed_id = r.seed_id and abs(a.y - r.y) <= 1 and abs(a.x - r.x) <= 1"""


@query("color_fill", to_runs("select * from {reach}", "frame_id, seed_id"), {**LAB_EXTRA, "reach": FILL_REACH})
def _(t):
    return X.color_fill(t.pixels, t.sql(SEED), 14.0)


@query(
    "downsample_pixels",
    """select frame_id, y // 2 as y, x // 2 as x, floor(avg(r) + 0.5)::int as r, floor(avg(g) + 0.5)::int as g, floor(avg(b) + 0.5)::int as b
       from {pixels} group by 1, 2, 3""",
)
def _(t):
    sizes = t.pixels.groupBy(F.col("frame_id").alias("id")).agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")
    )
    return X.downsample_pixels(t.pixels, sizes, 4)


PYRAMID_FRAMES = "select doc_id as id, cast(n_chars as int) as width, cast(n_chars + 20 * (doc_id % 300) as int) as height from {documents}"


@query(
    "pyramid_levels",
    """select frame_id, level, width, height, scale from {lv}""",
    {
        "pf": PYRAMID_FRAMES,
        "lv": """select id as frame_id, 0 as level, width, height, 1.0::double as scale, false as stop from {pf} where width > 0 and height > 0
            union all select frame_id, level + 1, width // 2, height // 2, scale / 2, greatest(width // 2, height // 2) <= 4096
            from lv where not stop and level < 7 and least(width // 2, height // 2) >= 16""",
    },
)
def _(t):
    return X.pyramid_levels(t.sql(PYRAMID_FRAMES))


# ── registration ────────────────────────────────────────────────────────────

STATS = """select registration_id, n, c_ref_x, c_ref_y, case when dr >= 1e-12 then sqrt(2.0::double) / dr end as s_ref,
                  c_moving_x, c_moving_y, case when dm >= 1e-12 then sqrt(2.0::double) / dm end as s_moving
  from (select c.*, avg(sqrt((ref_x - c_ref_x) ** 2 + (ref_y - c_ref_y) ** 2)) as dr, avg(sqrt((moving_x - c_moving_x) ** 2 + (moving_y - c_moving_y) ** 2)) as dm
        from {keypoint_pairs} k join (select registration_id, count(*) as n, avg(ref_x) as c_ref_x, avg(ref_y) as c_ref_y,
             avg(moving_x) as c_moving_x, avg(moving_y) as c_moving_y from {keypoint_pairs} group by 1) c using (registration_id)
        group by all) t"""
NORMED = """select registration_id, s_moving * (moving_x - c_moving_x) as x, s_moving * (moving_y - c_moving_y) as y,
                   s_ref * (ref_x - c_ref_x) as u, s_ref * (ref_y - c_ref_y) as v
            from {keypoint_pairs} join {stats} using (registration_id) where n >= 4 and s_ref is not null and s_moving is not null"""
ROW_A = ["0", "0", "0", "-x", "-y", "-1", "v*x", "v*y", "v"]
ROW_B = ["x", "y", "1", "0", "0", "0", "-u*x", "-u*y", "-u"]
MATRIX = (
    "select registration_id, "
    + ", ".join(
        f"round(sum(({ROW_A[i]}) * ({ROW_A[j]}) + ({ROW_B[i]}) * ({ROW_B[j]})), 4)::double + 0 as m{i}{j}" for i in range(9) for j in range(i, 9)
    )
    + " from {normed} group by 1"
)
REG_EXTRA = {"stats": STATS, "normed": NORMED}
STAT_COLS = ("c_ref_x", "c_ref_y", "s_ref", "c_moving_x", "c_moving_y", "s_moving")


@query(
    "hartley_stats", f"select registration_id, n, {', '.join(f'round({c}, 8) as {c}' for c in STAT_COLS)} from {{stats}}", REG_EXTRA
)
def _(t):
    return G.hartley_stats(t.keypoint_pairs).withColumns({c: F.round(c, 8) for c in STAT_COLS})


@query("dlt_normal_matrix", MATRIX, REG_EXTRA)
def _(t):
    m = G.dlt_normal_matrix(t.keypoint_pairs, G.hartley_stats(t.keypoint_pairs))
    return m.select("registration_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in m.columns if c != "registration_id"])


FITTED = "select registration_id, n from {stats} where n >= 4 and s_ref is not null and s_moving is not null"


def shifted_rmse(t):
    """RMSE of the best plain shift of each registration's points, which a fitted matrix must not exceed."""
    mean = t.keypoint_pairs.groupBy("registration_id").agg(
        F.avg(F.col("ref_x") - F.col("moving_x")).alias("dx"), F.avg(F.col("ref_y") - F.col("moving_y")).alias("dy")
    )
    off = F.pow(F.col("ref_x") - F.col("moving_x") - F.col("dx"), 2) + F.pow(F.col("ref_y") - F.col("moving_y") - F.col("dy"), 2)
    return t.keypoint_pairs.join(mean, "registration_id").groupBy("registration_id").agg(F.sqrt(F.avg(off)).alias("shifted"))


@query("fit_homography", "select registration_id, true as scaled, true as finite from {fitted}", {**REG_EXTRA, "fitted": FITTED})
def _(t):
    """Fitted matrices have a last element of one and no element that is not a number."""
    fitted = G.fit_homography(t.keypoint_pairs)
    numbers = [F.abs(F.col(h)) < float("inf") for h in G.H]
    finite = numbers[0]
    for n in numbers[1:]:
        finite = finite & n
    return fitted.select("registration_id", (F.abs(F.col("h8") - 1) < 1e-9).alias("scaled"), finite.alias("finite"))


@query(
    "fitted_residuals",
    "select f.registration_id, f.n, true as ordered, true as better from {fitted} f join {registrations} r on r.id = f.registration_id",
    {**REG_EXTRA, "fitted": FITTED},
)
def _(t):
    """Residuals of the fitted matrices lie below those of the best plain shift."""
    found = G.fit_residuals(t.registrations, t.keypoint_pairs, G.fit_homography(t.keypoint_pairs)).join(shifted_rmse(t), "registration_id")
    return found.select(
        "registration_id", "n", (F.col("rmse") <= F.col("max_error") + 1e-9).alias("ordered"), (F.col("rmse") <= F.col("shifted") + 1e-6).alias("better")
    )


STORED = """select id as registration_id, string_split(substr(homography, 2, length(homography) - 2), ',')::double[] as h
            from {registrations} where homography is not null and homography <> 'null'"""
MAPPED = """select k.*, case when abs(w) < 1e-12 then moving_x else (h[1] * moving_x + h[2] * moving_y + h[3]) / w end as mapped_x,
                   case when abs(w) < 1e-12 then moving_y else (h[4] * moving_x + h[5] * moving_y + h[6]) / w end as mapped_y
            from (select k.*, h, h[7] * moving_x + h[8] * moving_y + h[9] as w from {keypoint_pairs} k join {stored} using (registration_id)) k"""
HOM_EXTRA = {"stored": STORED, "mapped": MAPPED}


@query(
    "apply_homography",
    """select registration_id, sort_order, ref_x, ref_y, moving_x, moving_y, round(mapped_x, 6) as mapped_x, round(mapped_y, 6) as mapped_y from {mapped}""",
    HOM_EXTRA,
)
def _(t):
    mapped = G.apply_homography(t.keypoint_pairs, G.parse_homography(t.registrations))
    return mapped.withColumns({c: F.round(c, 6) for c in ("mapped_x", "mapped_y")})


@query(
    "fit_residuals",
    """select r.registration_id, count(m.registration_id) as n, round(coalesce(sqrt(avg((mapped_x - ref_x) ** 2 + (mapped_y - ref_y) ** 2)), 0), 6) as rmse,
              round(coalesce(max(sqrt((mapped_x - ref_x) ** 2 + (mapped_y - ref_y) ** 2)), 0), 6) as max_error
       from {stored} r left join {mapped} m using (registration_id) group by 1""",
    HOM_EXTRA,
)
def _(t):
    found = G.fit_residuals(t.registrations, t.keypoint_pairs, G.parse_homography(t.registrations))
    return found.withColumns({c: F.round(c, 6) for c in ("rmse", "max_error")})


@query(
    "invert_homography",
    "select registration_id, "
    + ", ".join(f"round(({e}) / d / (l / d), 6) + 0 as h{i}" for i, e in enumerate(
        ["e*i-f*h", "c*h-b*i", "b*f-c*e", "f*g-d_*i", "a*i-c*g", "c*d_-a*f", "d_*h-e*g", "b*g-a*h", "a*e-b*d_"]))
    + """ from (select *, a*(e*i-f*h) - b*(d_*i-f*g) + c*(d_*h-e*g) as d, a*e-b*d_ as l from (
            select registration_id, h[1] as a, h[2] as b, h[3] as c, h[4] as d_, h[5] as e, h[6] as f, h[7] as g, h[8] as h, h[9] as i from {stored}) s) t""",
    HOM_EXTRA,
)
def _(t):
    inverse = G.invert_homography(G.parse_homography(t.registrations))
    return inverse.select("registration_id", *[(F.round(h, 6) + F.lit(0.0)).alias(h) for h in G.H])


@query(
    "fit_readiness",
    """select r.id as registration_id, transform_type, count(k.registration_id) as pairs, case when transform_type = 'tps' then 6 else 4 end as needed,
              count(k.registration_id) >= case when transform_type = 'tps' then 6 else 4 end as can_fit
       from {registrations} r left join {keypoint_pairs} k on k.registration_id = r.id group by r.id, transform_type""",
)
def _(t):
    return G.fit_readiness(t.registrations, t.keypoint_pairs)
