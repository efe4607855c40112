"""Words, hashes and joins shared by the training-data operators."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 1_000_000
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_in(text: Column) -> Column:
    """Number of words of a text, null counting as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def body(text: str = "text") -> Column:
    """UTF-8 bytes of a text, null as the empty text."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")


def packed(docs: DataFrame, *derived: Column) -> DataFrame:
    """Each row of ``docs`` as the struct ``row`` beside derived columns, so that no helper column meets a name of theirs; ``row.*`` unpacks it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *derived)


def text_key() -> list[Column]:
    """A pair of hashes of a row's text, by which rows are judged whatever their ids."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of ids for broadcasting only if it has at most ``limit`` rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of 8 MB, unless the session asks for less.

    Both sides hold a batch and its result at once for every running task; at the usual 64 MB
    that is more than an executor of a few GB has beside its heap.
    """
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    now = re.fullmatch(r"(-?\d+)b", spark.conf.get(key))
    if now is None or not 0 < int(now[1]) <= most:
        spark.conf.set(key, f"{most}b")


def release(spark: SparkSession) -> None:
    """Let go of what finished work left behind: plans, broadcasts, shuffles and checkpoints.

    Spark removes those from executors and the shared folder once the driver's collectors find
    that nothing refers to them, which left alone may be long after the next stage began.
    """
    gc.collect()
    spark._jvm.System.gc()
    pa.default_memory_pool().release_unused()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that ``path`` names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse, as far as any text so far needed them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = max(n + 1, 2 * len(cls.up))
            inverse = pow(_BASE, -1, 1 << 64)
            grown = []
            for base in (_BASE, inverse):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                grown.append(np.multiply.accumulate(steps))
            cls.up, cls.down = grown
        return cls.up, cls.down


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow binary column without copying it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows of about ``size`` bytes at a time: first row, row after the last, bytes, offsets from 0."""
    raw, offsets = binary_parts(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of several texts, and where each text's words begin among them."""
    solid = ~gap[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial."""
    up, down = _Powers.upto(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_values(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the spans, which follow each other without overlap, as an Arrow column."""
    if not len(starts):
        return pa.array([], pa.large_binary())
    edges = np.empty(2 * len(starts), np.int64)
    edges[::2], edges[1::2] = starts, ends
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)])
    return pieces.take(pa.array(np.arange(0, len(edges) - 1, 2)))


def lower(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words inside a text; a shorter text is one run of all its words.

    Returns the hashes and where each text's hashes begin.
    """
    counts = np.diff(at)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    first = np.repeat(at[:-1] - out[:-1], made) + np.arange(out[-1])
    length = np.repeat(np.minimum(counts, width), made)
    h = np.full(len(first), 0x51ED270B, np.uint64) + length.astype(np.uint64)
    whole = bool(len(length)) and bool((length == width).all())
    for i in range(width):
        if whole:
            h = mix(h * _STEP + words[first + i])
        else:
            on = length > i
            h[on] = mix(h[on] * _STEP + words[first[on] + i])
    return h, out


def lists(values: np.ndarray, counts: list[int] | np.ndarray, kind=pa.int64()) -> pa.Array:
    """One Arrow list a row out of flat values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
