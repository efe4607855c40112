"""Stored mask encodings to runs and back, many masks at a time in numpy.

A stored mask is one value per (frame, label); its record list, and so every group below,
is bounded by the pixel count of one image.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotlake.operators.runs import FRAME_LABEL, normalize_runs
from annotlake.plans.durable import cut
from annotlake.plans.spread import spread
from annotlake.plans.strips import both, cover, laid, starts, whole_groups


RUNS = "value int, y bigint, x0 bigint, x1 bigint"
AT_ONCE = 1 << 21  # bytes of masks decoded together; a mask is one value, so one may be more
ROWS, COLUMNS = 0, 1  # rle8, in rows; rle, in columns


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in FRAME_LABEL)


def _decoded(masks: DataFrame, frames: DataFrame, kind: Column) -> DataFrame:
    """Runs of the masks whose ``kind`` is not null; masks of one frame, label and kind are read as one, record by record."""
    size = F.col("width").cast("long"), F.col("height").cast("long")
    sizes = frames.select(F.col("id").alias("frame_id"), *size)
    chosen = masks.select(*FRAME_LABEL, kind.alias("kind"), "mask_data").where("kind is not null and mask_data is not null")
    line = F.when(F.col("kind") == ROWS, F.col("width")).otherwise(F.col("height"))
    total = F.coalesce(F.col("width") * F.col("height"), F.lit(1 << 62))
    sized = chosen.join(sizes, "frame_id").select(*FRAME_LABEL, "kind", "mask_data", line.alias("line"), total.alias("total")).where("line is not null")
    groups = [*FRAME_LABEL, "kind"]
    dealt = spread(sized, *FRAME_LABEL).sortWithinPartitions(*groups)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(parts, groups):
            first = starts(part, groups)
            upto = np.cumsum(pc.binary_length(part.column("mask_data")).to_numpy(zero_copy_only=False).astype(np.int64))
            begun = np.append(0, upto)[first] // AT_ONCE
            cuts = np.append(first[np.append(True, begun[1:] != begun[:-1])], part.num_rows)
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                yield _runs_of(part.slice(int(low), int(high - low)), groups)

    return dealt.mapInArrow(batches, f"{_kinds(dealt)}, {RUNS}")


def _runs_of(part: pa.RecordBatch, groups: Sequence[str]) -> pa.RecordBatch:
    first = starts(part, groups)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, part.num_rows)))
    kind, line, total = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "line", "total"))
    data = part.column("mask_data")
    length = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8).astype(np.int64)
    width = np.where(kind == ROWS, 5, 4)
    n = length // width  # a torn last record is ignored
    of = np.repeat(np.arange(part.num_rows), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(length) - length)[of] + i * width[of]
    value = np.where(kind[of] == ROWS, raw[at], i % 2) if len(at) else at
    at = at + (kind[of] == ROWS)
    count = raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16 | raw[at + 3] << 24
    order = np.lexsort((i, group[of]))
    of, value, count = of[order], value[order], count[order]
    end = np.cumsum(count)
    fresh = np.append(True, group[of][1:] != group[of][:-1]) if len(of) else np.zeros(0, bool)
    end = end - np.maximum.accumulate(np.where(fresh, end - count, 0))
    low, high = np.minimum(end - count, total[of]), np.minimum(end, total[of])
    on = (value != 0) & (high > low)
    of, value, low, high = of[on], value[on], low[on], high[on]
    line = line[of]
    y0 = low // line
    pieces = (high - 1) // line - y0 + 1
    each = np.repeat(np.arange(len(of)), pieces)
    y = y0[each] + np.arange(len(each)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    top = y * line[each]
    x0, x1 = np.maximum(low[each] - top, 0), np.minimum(high[each] - top, line[each])
    owner, value = group[of][each], value[each]
    upright = kind[first[owner]] == COLUMNS
    turned = _turned(owner[upright], y[upright], x0[upright], x1[upright])
    owner, y, x0, x1 = (np.concatenate([a[~upright], b]) for a, b in zip((owner, y, x0, x1), turned, strict=True))
    value = np.concatenate([value[~upright], np.ones(len(turned[0]), np.int64)])
    place = pa.array(first[owner])
    cols = [part.column(c).take(place) for c in FRAME_LABEL]
    return pa.RecordBatch.from_arrays([*cols, pa.array(value, pa.int32()), pa.array(y), pa.array(x0), pa.array(x1)], names=[*FRAME_LABEL, "value", "y", "x0", "x1"])


def _edges(owner: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, column and row of the places at which columns of each owner's pixels begin (sign 1) and of those past their end (-1)."""
    if not len(owner):
        return owner, y, x0, x1
    low, high = np.full(owner.max() + 1, 1 << 62), np.full(owner.max() + 1, -(1 << 62))
    np.minimum.at(low, owner, y)
    np.maximum.at(high, owner, y)
    tall = np.maximum(high - low + 3, 0)  # an empty line below each, and one for the shift
    base = np.cumsum(tall) - tall
    runs = cover((base[owner] + y - low[owner], x0, x1))
    below = laid(runs, [(1, 0)])
    same = cover(both(runs, below), lambda n: n == 2)
    begin, stop = cover(both(runs, same), lambda n: n == 1), cover(both(below, same), lambda n: n == 1)
    line, left, right = both(begin, stop)
    sign = np.repeat(np.array([1, -1]), [len(begin[0]), len(stop[0])])
    wide = right - left
    each = np.repeat(np.arange(len(line)), wide)
    column = left[each] + np.arange(len(each)) - np.repeat(np.cumsum(wide) - wide, wide)
    known = np.unique(owner)
    of = known[np.searchsorted(base[known], line, "right") - 1]
    return of[each], column, (line - base[of] + low[of])[each], sign[each]


def _turned(owner: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs after rows and columns have changed places."""
    of, column, row, sign = _edges(owner, y, x0, x1)
    order = np.lexsort((row, column, of))
    of, column, row, sign = of[order], column[order], row[order], sign[order]
    # Along a column, beginnings and ends take turns.
    begin = np.flatnonzero(sign > 0)
    return of[begin], column[begin], row[begin], row[np.flatnonzero(sign < 0)]


def _is(encoding: str | None, kind: int) -> Column:
    return F.lit(kind) if encoding is None else F.when(F.col("encoding") == encoding, F.lit(kind))


def read_runs_rle8(masks: DataFrame, frames: DataFrame, encoding: str | None = "rle8") -> DataFrame:
    """Records [value u8][count u32], row-major."""
    return _decoded(masks, frames, _is(encoding, ROWS))


def read_runs_rle(masks: DataFrame, frames: DataFrame, encoding: str | None = "rle") -> DataFrame:
    """u32 counts alternating from background, column-major; every foreground value is 1."""
    return _decoded(masks, frames, _is(encoding, COLUMNS))


def read_instances_png(pixels: DataFrame) -> DataFrame:
    """Legacy colour masks: each opaque colour becomes an id from 1 in order of first appearance.

    ``pixels``: frame_id, label_id, y, x, r, g, b, a. Colours are first reduced to one row
    each, so the ranking sees colours, not pixels.
    """
    shown = pixels.where(F.col("a") > 0)
    color = ["r", "g", "b"]
    # Row-major order as a pair, so that no image width is needed.
    first = shown.groupBy(*FRAME_LABEL, *color).agg(F.min(F.struct("y", "x")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*FRAME_LABEL).orderBy("first"))
    ids = first.select(*FRAME_LABEL, *color, rank.cast("int").alias("value"))
    valued = shown.join(ids, [*FRAME_LABEL, *color]).select(
        *FRAME_LABEL, "value", "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1")
    )
    return normalize_runs(valued)


def decode_any(masks: DataFrame, frames: DataFrame, png_pixels: DataFrame | None = None) -> DataFrame:
    """Runs of masks in mixed encodings; an unknown encoding name means ``rle``.

    ``png`` masks are decoded from ``png_pixels``; ``undecoded`` lists those it lacks.
    """
    cols = [*FRAME_LABEL, "value", "y", "x0", "x1"]
    kind = F.when(F.col("encoding") == "rle8", F.lit(ROWS)).when(F.col("encoding") == "png", F.lit(None)).otherwise(F.lit(COLUMNS))
    runs = _decoded(masks, frames, kind)
    return runs if png_pixels is None else runs.unionByName(read_instances_png(png_pixels).select(*cols))


def undecoded(masks: DataFrame, png_pixels: DataFrame | None = None) -> DataFrame:
    """``frame_id, label_id, error`` of every ``png`` mask whose pixels are not given."""
    png = masks.where(F.col("encoding") == "png").select(*FRAME_LABEL)
    if png_pixels is not None:
        png = png.join(png_pixels.select(*FRAME_LABEL).distinct(), list(FRAME_LABEL), "left_anti")
    return png.withColumn("error", F.lit("png mask without pixels"))


# ── encoding ────────────────────────────────────────────────────────────────


def _with_size(df: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows with the size of their frame and the number of rows, ``copies``, that say so."""
    sizes = frames.groupBy(F.col("id").alias("frame_id"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    return df.join(sizes.agg(F.count(F.lit(1)).alias("copies")), "frame_id")


def _packed(runs: DataFrame, frames: DataFrame, encoding: str) -> DataFrame:
    """Masks of the runs (y, x0, x1, ``held``): maximal ranges of one sum of ``held``, background included, as records."""
    whole = F.col("y").isNotNull() & F.col("x0").isNotNull() & F.col("x1").isNotNull()
    place = [F.when(whole, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("y", "x0", "x1")]
    laid_ = _with_size(runs.select(*FRAME_LABEL, *place, "held"), frames)
    laid_ = laid_.withColumn("held", (F.col("held") * F.col("copies")).cast("long")).drop("copies").where("width * height > 0")
    groups = [*FRAME_LABEL, "width", "height"]
    dealt = spread(laid_, *FRAME_LABEL).sortWithinPartitions(*groups)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(parts, FRAME_LABEL):
            first = starts(part, FRAME_LABEL)
            data = _records_of(part, first, starts(part, groups), encoding)
            cols = [part.column(c).take(pa.array(first)) for c in FRAME_LABEL]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([encoding] * len(first)), data], names=[*FRAME_LABEL, "encoding", "mask_data"])

    return dealt.mapInArrow(batches, f"{_kinds(dealt)}, encoding string, mask_data binary")


def _records_of(part: pa.RecordBatch, first: np.ndarray, sized: np.ndarray, encoding: str) -> pa.Array:
    """The masks of a batch; ``first``: the first row of each, ``sized``: of each size that a mask's frame has."""
    y, x0, x1, held = (pc.fill_null(part.column(c), 0).to_numpy(zero_copy_only=False) for c in ("y", "x0", "x1", "held"))
    width, height = (part.column(c).to_numpy(zero_copy_only=False) for c in ("width", "height"))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, part.num_rows)))
    on = np.flatnonzero(x1 > x0)
    if encoding == "rle":
        size = np.repeat(np.arange(len(sized)), np.diff(np.append(sized, part.num_rows)))
        owner, column, row, sign = _edges(size[on], y[on], x0[on], x1[on])
        at = sized[owner]
        group, place, change = of[at], column * height[at] + row, sign * held[at]
    else:
        group = np.tile(of[on], 2)
        offset = y[on] * width[on]
        place, change = np.concatenate([x0[on] + offset, x1[on] + offset]), np.concatenate([held[on], -held[on]])
    area = np.maximum.reduceat(width * height, first)
    masks = np.arange(len(first))
    group, place, change = np.concatenate([group, masks, masks]), np.concatenate([place, 0 * area, area]), np.concatenate([change, 0 * area, 0 * area])
    order = np.lexsort((place, group))
    group, place, state = group[order], place[order], np.cumsum(change[order])  # every mask's changes come to 0
    last = np.append((group[1:] != group[:-1]) | (place[1:] != place[:-1]), True)
    group, place, state = group[last], place[last], state[last]
    inside = (place >= 0) & (place < area[group])
    turn = inside & np.append(True, (group[1:] != group[:-1]) | (state[1:] != state[:-1]) | ~inside[:-1])
    group, place, state = group[turn], place[turn], state[turn]
    end = np.where(np.append(group[1:] != group[:-1], True), area[group], np.append(place[1:], 0))
    n = np.bincount(group, minlength=len(first))
    if encoding == "rle8":
        records = np.zeros(len(group), np.dtype([("value", "u1"), ("count", "<u4")]))
        records["value"], records["count"] = np.minimum(state, 255), end - place
    else:
        opens = np.append(True, group[1:] != group[:-1]) & (state == 1)
        records = np.zeros(len(group) + opens.sum(), "<u4")
        records[np.arange(len(group)) + np.cumsum(opens)] = end - place
        n = n + np.bincount(group[opens], minlength=len(first))
    offsets = np.append(0, np.cumsum(n)) * records.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(records.tobytes())])


def write_runs_rle8(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Disjoint valued runs to rle8 masks; runs continue across row ends where values agree.

    A record holds one byte of value, so values over 255 are written as 255; ``saturated`` lists them.
    """
    return _packed(runs.withColumn("held", F.col("value")), frames, "rle8")


def saturated(runs: DataFrame) -> DataFrame:
    """``frame_id, label_id, value`` of the values that one byte cannot hold."""
    return runs.where(F.col("value") > 255).select(*FRAME_LABEL, "value").distinct()


def write_runs_rle(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Presence to binary column-major masks; a leading 0 when the first pixel is set."""
    return _packed(runs.where((F.col("value") != 0) & (F.col("x1") > F.col("x0"))).withColumn("held", F.lit(1)), frames, "rle")


def upgrade_encoding(masks: DataFrame, frames: DataFrame, png_pixels: DataFrame | None = None) -> DataFrame:
    """Rewrite every stored mask as rle8.

    A mask without foreground is one record of background over its frame; a ``png`` mask
    whose pixels are not given stays as it is.
    """
    masks = cut(masks.select(*FRAME_LABEL, "encoding", "mask_data"))
    written = cut(write_runs_rle8(decode_any(masks, frames, png_pixels), frames))
    digits = F.lpad(F.hex("_area"), 8, "0")
    le32 = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in (3, 2, 1, 0)])
    lost = undecoded(masks, png_pixels).withColumnRenamed("error", "_error")
    sizes = frames.select(F.col("id").alias("frame_id"), (F.col("width").cast("long") * F.col("height")).alias("_area"))
    rest = masks.join(written.select(*FRAME_LABEL), list(FRAME_LABEL), "left_anti").join(lost, list(FRAME_LABEL), "left")
    rest = rest.join(sizes, "frame_id").select(
        *FRAME_LABEL,
        F.when(F.col("_error").isNull(), F.lit("rle8")).otherwise(F.col("encoding")).alias("encoding"),
        F.when(F.col("_error").isNull(), F.unhex(F.concat(F.lit("00"), le32))).otherwise(F.col("mask_data")).alias("mask_data"),
    )
    return written.unionByName(rest)
