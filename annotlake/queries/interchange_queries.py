"""Sources and sinks: mask encodings, folder scans, COCO, YOLO, dataset merge."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from annotlake.functions.color import IMPORT_PALETTE
from annotlake.formats import ring_rows
from annotlake.operators import components as P
from annotlake.operators import geometry as G
from annotlake.operators import merge as M
from annotlake.plans.durable import shared_folder
from annotlake.plans.spread import join_shares
from annotlake.queries.component_queries import EXTRA as PARTS
from annotlake.queries.component_queries import labelled
from annotlake.queries.mask_queries import held_runs, to_runs
from annotlake.queries.registry import query
from annotlake.queries.shape_queries import EXTRA as SHAPES
from annotlake.queries.shape_queries import flat
from annotlake.sinks import coco as CO
from annotlake.sinks import yolo as YO
from annotlake.sinks.files import write_files
from annotlake.sources import coco as CI
from annotlake.sources import images as I
from annotlake.sources import rle as L
from annotlake.sources import yolo as YI

EXTRA = {**PARTS, **SHAPES}
LE = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)"

# ── encodings ───────────────────────────────────────────────────────────────


def encoded(order: str, area: int, pixels: str, value: str) -> dict[str, str]:
    """Linear ranges of a mask, background gaps included."""
    return {
        "lin": f"""select frame_id, label_id, {value} as value, min(p) as p0, max(p) + 1 as p1 from (
            select *, p - row_number() over (partition by frame_id, label_id, {value} order by p) as island
            from (select *, {order} as p from {{{pixels}}}) a) b group by frame_id, label_id, {value}, island""",
        "gaps": f"""select frame_id, label_id, 0 as value, p1 as p0, next as p1 from (
              select frame_id, label_id, p1, coalesce(lead(p0) over (partition by frame_id, label_id order by p0), {area}) as next from {{lin}}) t
              where next > p1
            union all select frame_id, label_id, 0, 0, min(p0) from {{lin}} group by all having min(p0) > 0""",
        "segs_all": "select * from {lin} union all select * from {gaps}",
    }


RLE8 = encoded("y * 256 + x", 32768, "held_px", "value")
RLE = encoded("x * 128 + y", 32768, "label_px", "1")


@query(
    "write_runs_rle8",
    f"""select frame_id, label_id, 'rle8' as encoding, string_agg(lpad(hex(value::int), 2, '0') || {LE}, '' order by p0) as mask_data
        from (select *, lpad(hex(p1 - p0), 8, '0') as h from {{segs_all}}) t group by frame_id, label_id""",
    {**EXTRA, **RLE8},
)
def _(t):
    return L.write_runs_rle8(held_runs(t), t.frames).withColumn("mask_data", F.hex("mask_data"))


@query(
    "write_runs_rle",
    f"""select frame_id, label_id, 'rle' as encoding, case when min(p0) filter (value = 1) = 0 then '00000000' else '' end
               || string_agg({LE}, '' order by p0) as mask_data
        from (select *, lpad(hex(p1 - p0), 8, '0') as h from {{segs_all}}) t group by frame_id, label_id""",
    {**EXTRA, **RLE},
)
def _(t):
    return L.write_runs_rle(t.mask_runs_raw, t.frames).withColumn("mask_data", F.hex("mask_data"))


@query("rle8_round_trip", to_runs("select * from {held_px}", "frame_id, label_id, value"), EXTRA)
def _(t):
    return L.read_runs_rle8(L.write_runs_rle8(held_runs(t), t.frames), t.frames)


@query("read_runs_rle", to_runs("select frame_id, label_id, 1 as value, y, x from {label_px}", "frame_id, label_id, value"), EXTRA)
def _(t):
    return L.read_runs_rle(L.write_runs_rle(t.mask_runs_raw, t.frames), t.frames)


def stored(t):
    """Masks in mixed encodings: A as rle8, N as rle, R under an unknown name."""
    held = held_runs(t)
    new = L.write_runs_rle8(held.where("label_id = 65"), t.frames)
    old = L.write_runs_rle(held.where("label_id <> 65"), t.frames)
    return new.unionByName(
        old.withColumn("encoding", F.when(F.col("label_id") == 82, "mask").otherwise(F.col("encoding")))
    )


MIXED_PX = "select frame_id, label_id, case when label_id = 65 then value else 1 end as value, y, x from {held_px}"


@query("decode_any", to_runs(MIXED_PX, "frame_id, label_id, value"), EXTRA)
def _(t):
    return L.decode_any(stored(t), t.frames)


@query(
    "upgrade_encoding",
    f"""select frame_id, label_id, 'rle8' as encoding, string_agg(lpad(hex(value::int), 2, '0') || {LE}, '' order by p0) as mask_data
        from (select *, lpad(hex(p1 - p0), 8, '0') as h from {{segs_all}}) t group by frame_id, label_id""",
    {**EXTRA, "mixed_px": MIXED_PX, **encoded("y * 256 + x", 32768, "mixed_px", "value")},
)
def _(t):
    return L.upgrade_encoding(stored(t), t.frames).withColumn("mask_data", F.hex("mask_data"))


# A legacy mask image: colours coarsened to a few, dark pixels transparent.
LEGACY = """select frame_id, 1 as label_id, y, x, cast(floor(r / 32) as int) as r, cast(floor(g / 64) as int) as g,
                   cast(floor(b / 64) as int) as b, case when r > 110 then 255 else 0 end as a from {pixels}"""


@query(
    "read_instances_png",
    to_runs(
        """select p.frame_id, p.label_id, c.value, p.y, p.x from {legacy} p join (
             select frame_id, r, g, b, row_number() over (partition by frame_id order by min(y * 8 + x))::int as value
             from {legacy} where a > 0 group by frame_id, r, g, b) c using (frame_id, r, g, b) where p.a > 0""",
        "frame_id, label_id, value",
    ),
    {**EXTRA, "legacy": LEGACY},
)
def _(t):
    return L.read_instances_png(t.sql(LEGACY))


# ── folder scans ────────────────────────────────────────────────────────────

SCANNED = r"select * from {files} where regexp_matches(regexp_extract(path, '([^/]*)$', 1), '\.(png|jpg|jpeg|bmp|tiff?)$')"
SEQ = """select path, case when contains(path, '/') then regexp_extract(path, '^(.*)/[^/]*$', 1)
                           else regexp_replace(path, '\\.[^.]*$', '') end as sequence_name from {scanned}"""
FILES = {"scanned": SCANNED, "seq": SEQ}


def scanned(t):
    return I.scan_images(t.files)


@query("scan_images", "select path, octet_length(content)::int as bytes from {scanned}", FILES)
def _(t):
    return scanned(t).select("path", F.length("content").alias("bytes"))


@query(
    "assign_sequences",
    """select path, sequence_name, dense_rank() over (order by sequence_name) - 1 as sort_order,
              row_number() over (partition by sequence_name order by path) - 1 as frame_index from {seq}""",
    FILES,
)
def _(t):
    return I.assign_sequences(scanned(t))


MIME = """case when octet_length(content) < 8 then 'application/octet-stream' when starts_with(hex(content), '89504E470D0A1A0A') then 'image/png'
    when starts_with(hex(content), 'FFD8FF') then 'image/jpeg' when starts_with(hex(content), '424D') then 'image/bmp'
    else 'application/octet-stream' end"""


@query(
    "import_frames",
    f"""select path as relative_path, sha256(content) as content_hash, width, height, octet_length(content) as bytes,
               octet_length(content) // 1024 < 1 as is_embedded, {MIME} as mime, false as reviewed from {{scanned}}""",
    FILES,
)
def _(t):
    return I.import_frames(scanned(t), False, 1)


@query("sniff_mime", f"select path, {MIME} as mime from {{files}}")
def _(t):
    from annotlake.functions.paths import sniff_mime

    return t.files.select("path", sniff_mime(F.col("content")).alias("mime"))


@query(
    "scan_summary",
    """select count(distinct sequence_name) as sequences_created, count(*) as frames_imported,
              count(*) filter (octet_length(content) // 1024 < 1) as frames_embedded, 0::bigint as errors
       from {scanned} join {seq} using (path)""",
    FILES,
)
def _(t):
    return I.scan_summary(I.assign_sequences(scanned(t)), I.import_frames(scanned(t), False, 1))


@query(
    "resolve_image_source",
    """select id, case when id in (select frame_id from {texts}) then 'embedded' when relative_path is not null then 'referenced' else 'missing' end as state,
              case when id not in (select frame_id from {texts}) then '/data/images/' || relative_path end as full_path from {frames}""",
)
def _(t):
    blobs = t.texts.select("frame_id", F.encode("content", "UTF-8").alias("embedded_data"))
    return I.resolve_image_source(t.frames, blobs, "/data/images")


COLOR = f"list_extract({IMPORT_PALETTE!r}, (i % 10 + 1)::int)"


@query("default_label_color", f"select p_partkey as i, {COLOR.replace('i %', 'p_partkey %')} as color from {{part}}")
def _(t):
    from annotlake.functions.color import default_label_color

    return t.part.select(F.col("p_partkey").alias("i"), default_label_color(F.col("p_partkey")).alias("color"))


# ── COCO ────────────────────────────────────────────────────────────────────


def regions(t):
    return P.mask_regions(t.mask_runs_raw, labelled(t))


def annotations(t, segmentation=True):
    return CO.coco_annotations(CO.coco_images(t.frames), regions(t), flat(t), labelled(t), None, segmentation)


COCO_IMAGES = """select row_number() over (order by id) as id, id as frame_id, coalesce(relative_path, concat('frame_', id)) as file_name, width, height from {frames}"""
COCO_ROWS = """select row_number() over (order by image_id, kind, category_id, part) as id, image_id, kind, category_id, bbox_x, bbox_y, bbox_w, bbox_h, area, 0 as iscrowd from (
    select i.id as image_id, 0 as kind, label_index as category_id, part, bbox_x::double as bbox_x, bbox_y::double as bbox_y,
           bbox_w::double as bbox_w, bbox_h::double as bbox_h, area::double as area
    from {regions} r join {coco_images_t} i on i.frame_id = r.frame_id
    union all
    select i.id, 1, l.label_index, b.shape_id, bbox_x, bbox_y, bbox_w, bbox_h, s.area
    from {boxes} b join {coco_images_t} i on i.frame_id = b.frame_id join {label_idx} l on l.label_id = b.label_id
    join (select shape_id, abs(sum(x1 * y2 - x2 * y1)) / 2 as area from {ring} group by 1) s on s.shape_id = b.shape_id
    where b.n >= 3) t"""
COCO = {**EXTRA, "coco_images_t": COCO_IMAGES, "coco_rows": COCO_ROWS}
BOXES = ("bbox_x", "bbox_y", "bbox_w", "bbox_h", "area")


@query("coco_images", "select id, file_name, width, height from {coco_images_t}", COCO)
def _(t):
    return CO.coco_images(t.frames).drop("frame_id")


@query("coco_categories", "select label_index as id, name, '' as supercategory from {label_idx}", COCO)
def _(t):
    return CO.coco_categories(labelled(t))


@query(
    "coco_annotations", f"select id, image_id, kind, category_id, {', '.join(f'round({c}, 3) as {c}' for c in BOXES)}, iscrowd from {{coco_rows}}", COCO
)
def _(t):
    return annotations(t).withColumns({c: F.round(c, 3) for c in BOXES}).drop("segmentation")


def coco_docs(t):
    """The exported corpus as documents of 64 images each."""
    images = CO.coco_images(t.frames)
    keyed = images.select(F.floor(F.col("id") / 64).alias("doc_id"), F.col("id").alias("image_id"))
    anns = CO.coco_annotations(images, regions(t), flat(t), labelled(t))
    docs = CO.coco_documents(keyed, images.drop("frame_id"), CO.coco_categories(labelled(t)), anns)
    text = docs.select("doc_id", F.to_json(F.struct("images", "categories", "annotations")).alias("text"))
    from annotlake.schema import COCO_FILE

    # Labels, frames and annotations are read from the documents each for themselves: they are made once and kept, compressed.
    folder = scratch(t, "documents")
    text.select("doc_id", F.from_json("text", COCO_FILE).alias("d")).select("doc_id", "d.*").write.parquet(folder)
    return t.spark.read.parquet(folder)


READ_COCO = """select i.id // 64 as doc_id, i.file_name as relative_path, category_id as label_index, false as filled,
              count(*) as shapes, 4 * count(*) as points
       from {coco_rows} r join {coco_images_t} i on i.id = r.image_id where kind = 0 group by all
       union all
       select i.id // 64, i.file_name, l.label_index, true, count(*), sum(b.n)::bigint
       from {boxes} b join {coco_images_t} i on i.frame_id = b.frame_id join {label_idx} l on l.label_id = b.label_id
       where b.n >= 3 group by all"""


@query("read_coco", READ_COCO, COCO)
def _(t):
    docs = coco_docs(t)
    shapes = CI.coco_shapes(CI.coco_annotation_rows(docs), CI.coco_frames(docs), CI.coco_labels(docs))
    return shapes.groupBy("doc_id", "relative_path", F.col("label_index").cast("long").alias("label_index"), "filled").agg(
        F.count(F.lit(1)).alias("shapes"), F.sum(F.size("points")).alias("points")
    )


# ── YOLO ────────────────────────────────────────────────────────────────────


def yolo_shapes(t):
    # Labels are met before the outlines are made: nodes are a fraction of their points.
    drawn = join_shares(t.shapes, labelled(t).select("label_id", "label_index"), "label_id")
    return G.flatten_shapes(drawn).select("frame_id", "label_index", "shape_id", "points")


DETECT = """select frame_id, path as relative_path, kind, label_index, part,
    printf('%d %.6f %.6f %.6f %.6f', label_index - 1, (bbox_x + bbox_w / 2.0) / 256, (bbox_y + bbox_h / 2.0) / 128, bbox_w / 256.0, bbox_h / 128.0) as line
  from (select r.frame_id, 0 as kind, label_index, part, bbox_x::double as bbox_x, bbox_y::double as bbox_y, bbox_w::double as bbox_w, bbox_h::double as bbox_h from {regions} r
        union all select frame_id, 1, label_index, shape_id, bbox_x, bbox_y, bbox_w, bbox_h from {boxes} join {label_idx} using (label_id) where n >= 3) b
  join (select id, coalesce(relative_path, concat('frame_', id)) as path from {frames}) f on f.id = b.frame_id"""
YOLO = {**EXTRA, "detect": DETECT}


def detect_lines(t):
    return YO.yolo_detect_lines(regions(t), yolo_shapes(t), t.frames)


@query("yolo_detect_lines", "select relative_path, kind, label_index, part, line from {detect}", YOLO)
def _(t):
    return detect_lines(t).drop("frame_id", "ring")


@query(
    "yolo_shape_lines",
    """select relative_path, part, c || ' ' || coords as line from (
         select coalesce(relative_path, concat('frame_', f.id)) as relative_path, s.shape_id as part,
                (l.label_index - 1)::varchar as c, string_agg(printf('%.6f %.6f', s.x / 256, s.y / 128), ' ' order by s.p) as coords
         from {flat} s join {label_idx} l using (label_id) join {frames} f on f.id = s.frame_id
         where s.shape_id in (select shape_id from {boxes} where n >= 3) group by 1, 2, 3) t""",
    YOLO,
)
def _(t):
    return YO.yolo_shape_lines(yolo_shapes(t), t.frames).select("relative_path", "part", "line")


@query("yolo_segment_lines")
@query("yolo_segment_all_lines")
def _(t):
    """Lines of every mask region ring and every shape; ``yolo_shape_lines`` has the lines of shapes with their check SQL."""
    rings = ring_rows({"mask_runs": t.mask_runs_raw, "labels": labelled(t)})
    return YO.yolo_segment_lines(rings, yolo_shapes(t), t.frames).drop("frame_id")


@query(
    "yolo_label_files",
    r"""select regexp_replace(relative_path, '\.[^./]*$', '') || '.txt' as file,
               row_number() over (partition by relative_path order by kind, label_index, part) - 1 as line_no, line from {detect}""",
    YOLO,
)
def _(t):
    return YO.yolo_label_files(detect_lines(t))


@query(
    "yolo_data_yaml",
    """select * from (values (0::bigint, 'path: .'), (1, 'train: images'), (2, 'val: images'), (3, 'names:')) v(line_no, line)
       union all select label_index + 3, concat('  ', label_index - 1, ': ', name) from {label_idx}
       union all select count(*) + 4, concat('nc: ', count(*)) from {label_idx}""",
    YOLO,
)
def _(t):
    return YO.data_yaml_lines(labelled(t))


READ_YOLO = """select relative_path, label_index::int as label_index, false as filled, count(*) as shapes, 4 * count(*) as points from {detect} group by all"""


@query("read_yolo", READ_YOLO, YOLO)
def _(t):
    """Exported detection lines read back."""
    lines = detect_lines(t).select(F.col("relative_path").alias("stem"), "line")
    images = t.frames.select(
        F.coalesce("relative_path", F.concat(F.lit("frame_"), F.col("id").cast("string"))).alias("relative_path"), "width", "height"
    ).withColumn("stem", F.col("relative_path"))
    shapes = YI.parse_label_lines(lines, images)
    return shapes.groupBy("relative_path", "label_index", "filled").agg(
        F.count(F.lit(1)).alias("shapes"), F.sum(F.size("points")).alias("points")
    )


@query(
    "read_yolo_names",
    "select label_index::int as label_index, name, list_extract(" + repr(IMPORT_PALETTE) + ", ((label_index - 1) % 10 + 1)::int) as color, false as is_instance from {label_idx}",
    EXTRA,
)
def _(t):
    return YI.read_yolo_names(YO.data_yaml_lines(labelled(t)))


# ── folders ─────────────────────────────────────────────────────────────────


def scratch(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("coco_folder_round_trip", READ_COCO, COCO)
def _(t):
    """The exported corpus written as JSON files and read back."""
    images = CO.coco_images(t.frames)
    keyed = images.select(F.floor(F.col("id") / 64).alias("doc_id"), F.col("id").alias("image_id"))
    anns = CO.coco_annotations(images, regions(t), flat(t), labelled(t))
    folder = scratch(t, "coco")
    CO.write_coco(folder, CO.coco_documents(keyed, images.drop("frame_id"), CO.coco_categories(labelled(t)), anns))
    docs = CI.read_coco(t.spark, folder).withColumn("doc_id", F.regexp_extract("doc_id", r"^(\d+)", 1).cast("long"))
    shapes = CI.coco_shapes(CI.coco_annotation_rows(docs), CI.coco_frames(docs), CI.coco_labels(docs))
    return shapes.groupBy("doc_id", "relative_path", F.col("label_index").cast("long").alias("label_index"), "filled").agg(
        F.count(F.lit(1)).alias("shapes"), F.sum(F.size("points")).alias("points")
    )


@query("yolo_folder_round_trip", READ_YOLO, YOLO)
def _(t):
    """Label files of mask regions and shapes written one per image and read back."""
    folder = scratch(t, "yolo")
    YO.write_label_files(YO.yolo_label_files(detect_lines(t)), folder)
    images = t.frames.select(
        F.coalesce("relative_path", F.concat(F.lit("frame_"), F.col("id").cast("string"))).alias("relative_path"), "width", "height"
    ).withColumn("stem", YI.bare_path(F.col("relative_path")))
    shapes = YI.parse_label_lines(YI.read_label_lines(t.spark, folder), images)
    return shapes.groupBy("relative_path", "label_index", "filled").agg(
        F.count(F.lit(1)).alias("shapes"), F.sum(F.size("points")).alias("points")
    )


@query(
    "scan_folder",
    """select lang || '/' || source || '/d' || doc_id || '.png' as relative_path, n_chars::int as width, (doc_id % 977 + 1)::int as height,
              'image/png' as mime, false as reviewed from {documents}""",
)
def _(t):
    """Files that begin with a PNG header, one a document, written below two levels of folders and scanned."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))
    content = F.concat(head, number(F.col("n_chars")), number(F.col("doc_id") % 977 + 1))
    path = F.concat("lang", F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".png"))
    folder = scratch(t, "scan")
    write_files(t.documents.select(path.alias("path"), content.alias("content")), folder)
    return I.scan_folder(t.spark, folder).select("relative_path", "width", "height", "mime", "reviewed")


# ── merge ───────────────────────────────────────────────────────────────────


def import_of(t):
    """The project's own shapes and classes coming back from another tool, with one label renamed."""
    labels = labelled(t).select(
        "label_index", F.when(F.col("name") == "R", "rust").otherwise(F.col("name")).alias("name"), F.lit("#123456").alias("color"), "is_instance"
    )
    named = t.frames.where(F.col("relative_path").isNotNull()).select(F.col("id").alias("frame_id"), "relative_path")
    shapes = t.shapes.join(named, "frame_id").join(labelled(t).select("label_id", "label_index"), "label_id")
    return {
        "labels": labels,
        "frames": named.select("relative_path"),
        "shapes": shapes.select("relative_path", "label_index", "shape_id", "closed", "filled", "nodes"),
        "classifications": t.classifications.join(named, "frame_id").select("relative_path", "task_name", "selected_classes"),
    }


def merged(t):
    labels = t.label_defs.withColumn("id", F.col("id").cast("long")).withColumn("sort_order", F.col("sort_order").cast("long"))
    shapes = t.shapes.withColumn("label_id", F.col("label_id").cast("long"))
    return M.merge_dataset(labels, t.frames, shapes, t.mask_runs_raw, t.classifications, import_of(t))


@query(
    "merge_dataset",
    """select (select count(*) from {frames} where relative_path is not null) as frames_matched, 0::bigint as frames_unmatched,
              (select count(distinct shape_id) from {shape_nodes} join {frames} on id = frame_id where relative_path is not null) as annotations_imported,
              1::bigint as labels_created""",
)
def _(t):
    return merged(t)["counts"]


@query(
    "merged_shapes",
    """select frame_id, label_id, count(*) as shapes from (
         select distinct shape_id, frame_id, label_id::bigint as label_id from {shape_nodes}
         union all select distinct shape_id, frame_id, case when label_id = 82 then 83 else label_id end
         from {shape_nodes} join {frames} on id = frame_id where relative_path is not null) t group by all""",
)
def _(t):
    return merged(t)["shapes"].groupBy("frame_id", "label_id").agg(F.count(F.lit(1)).alias("shapes"))
