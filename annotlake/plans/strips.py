"""Covers of runs by strips of rows: what a run reaches above and below is worked out in one place.

Runs are dealt by their keys and strips of ``STRIP`` rows once, and to every strip that they reach;
the strips of a sorted partition then pass through numpy in batches, many at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotlake.plans.spread import spread

STRIP = 64
MOST = 1 << 16  # rows held of one strip before they are merged
LIMIT = 1 << 30  # columns left and right of 0

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # line, x0, x1


def cover(runs: Runs, held: Callable[[np.ndarray], np.ndarray] = lambda n: n >= 1) -> Runs:
    """Maximal runs of the places at which ``held`` says yes to the number of runs over them, in order; not of those that no run covers."""
    line, x0, x1 = (a[runs[2] > runs[1]] for a in runs)
    if len(x0) and (x0.min() <= -LIMIT or x1.max() >= LIMIT):
        raise ValueError(f"columns have to lie within {LIMIT} of 0")
    ends = np.concatenate([(line << 31 | x0 + LIMIT) << 1 | 1, (line << 31 | x1 + LIMIT) << 1])
    ends.sort()
    place = ends >> 1
    last = np.ones(len(ends), bool)
    last[:-1] = place[1:] != place[:-1]
    inside = held(np.cumsum((ends & 1) * 2 - 1)[last])
    place, before = place[last], np.concatenate([[False], inside[:-1]])
    low, high = place[inside & ~before], place[~inside & before]
    return low >> 31, (low & (1 << 31) - 1) - LIMIT, (high & (1 << 31) - 1) - LIMIT


def laid(runs: Runs, rows: Sequence[tuple[int, int]]) -> Runs:
    """Every run once for each (dy, by): ``dy`` lines lower and ``by`` wider at both ends."""
    moved = [(runs[0] + dy, runs[1] - by, runs[2] + by) for dy, by in rows]
    return tuple(np.concatenate(a) for a in zip(*moved))


def both(a: Runs, b: Runs) -> Runs:
    return tuple(np.concatenate(p) for p in zip(a, b))


def strip_runs(runs: DataFrame, keys: Sequence[str], reach: int = 0, work: Callable[[Runs], Runs] = lambda r: r) -> DataFrame:
    """``keys, y, x0, x1``: what ``work`` makes of the merged runs of each key, as far as ``reach`` rows count.

    ``work`` gets disjoint maximal runs of many strips at once, each with ``reach`` rows of its
    neighbours on either side, numbered by lines that no two strips share.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    strip = F.floor(F.col("y") / F.lit(STRIP))
    if reach:
        strip = F.explode(F.sequence(F.floor((F.col("y") - reach) / F.lit(STRIP)), F.floor((F.col("y") + reach) / F.lit(STRIP))))
    place = [F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")]
    dealt = runs.where(F.col("x1") > F.col("x0")).select(*[F.col(k).alias(n) for k, n in zip(keys, named)], strip.alias("strip"), *place)
    dealt = spread(dealt, *named, "strip").sortWithinPartitions(*named, "strip")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name in named)
    made = dealt.mapInArrow(_worked(named, reach, work), f"{kinds}, y bigint, x0 bigint, x1 bigint")
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, named)], "y", "x0", "x1")


def starts(part: pa.RecordBatch, named: Sequence[str]) -> np.ndarray:
    """The first row of every group of a sorted batch."""
    new = np.zeros(part.num_rows, bool)
    new[:1] = True
    for c in named:
        col = part.column(c)
        here, ahead = col.slice(1), col.slice(0, part.num_rows - 1)
        gone = pc.xor(pc.is_null(here), pc.is_null(ahead))
        other = pc.or_(pc.fill_null(pc.not_equal(here, ahead), False), gone)
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(parts: Iterator[pa.RecordBatch], named: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition in batches that hold all rows of their groups."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        if held:
            # A group may go on over many batches; they are put together once it ends.
            edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), part.cast(held[-1].schema)]).combine_chunks().to_batches()[0]
            if len(starts(edge, named)) == 1:
                held.append(part)
                continue
        part = pa.Table.from_batches([p.cast(part.schema) for p in [*held, part]]).combine_chunks().to_batches()[0]
        last = int(starts(part, named)[-1])
        if last:
            yield part.slice(0, last)
        held = [part.slice(last)]
    if held:
        yield pa.Table.from_batches([p.cast(held[0].schema) for p in held]).combine_chunks().to_batches()[0]


def sized_groups(parts: Iterator[pa.RecordBatch], named: Sequence[str], most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The rows of a sorted partition, and whether their groups are of more than ``most`` rows; the others come whole in one batch."""
    held, passing = None, False
    for part in parts:
        if not part.num_rows:
            continue
        if held is not None:
            part = pa.Table.from_batches([held, part.cast(held.schema)]).combine_chunks().to_batches()[0]
        first = starts(part, named)
        if passing:
            # The one row that was held has been passed on already.
            end = int(first[1]) if len(first) > 1 else part.num_rows
            if end > 1:
                yield part.slice(1, end - 1), True
            if end == part.num_rows:
                held = part.slice(end - 1)
                continue
            part, first, passing = part.slice(end), first[1:] - end, False
        last = int(first[-1])
        if last:
            large = np.repeat(np.diff(first) > most, np.diff(first))
            if large.any():
                yield part.slice(0, last).filter(pa.array(large)), True
            if not large.all():
                yield part.slice(0, last).filter(pa.array(~large)), False
        held = part.slice(last)
        if held.num_rows > most:
            yield held, True
            held, passing = held.slice(held.num_rows - 1), True
    if held is not None and not passing:
        yield held, False


def strip_parts(runs: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Add ``part`` to disjoint runs: ``y * 2^32 + x`` of the first pixel that is connected with them inside their strip of rows.

    Runs of neighbouring rows touch within ``reach`` columns; those with a null key touch none.
    """
    grouped = [*keys, "_strip"]
    dealt = spread(runs.withColumn("_strip", F.floor(F.col("y") / F.lit(STRIP))), *grouped).sortWithinPartitions(*grouped)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(parts, grouped):
            yield pa.RecordBatch.from_arrays([*part.columns, placed(part)], names=[*part.schema.names, "part"])

    def placed(part: pa.RecordBatch) -> pa.Array:
        first = starts(part, grouped)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, part.num_rows)))
        y, strip, x0, x1 = (pc.fill_null(part.column(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in ("y", "_strip", "x0", "x1"))
        known = np.ones(part.num_rows, bool)
        for c in grouped:
            known &= part.column(c).is_valid().to_numpy(zero_copy_only=False)
        line = of * (STRIP + 1) + np.where(known, y - strip * STRIP, 0)  # an empty line between groups
        order = np.lexsort((x0, line))
        line, low, high, known = line[order], x0[order], x1[order], known[order]
        here, below = (line << 32) + (1 << 31), (line + 1 << 32) + (1 << 31)
        begin = np.searchsorted(here + high, below + low - reach, "right")
        count = np.maximum(np.searchsorted(here + low, below + high + reach, "left") - begin, 0) * known
        u = np.repeat(np.arange(len(line)), count)
        v = np.arange(len(u)) - np.repeat(np.cumsum(count) - count, count) + begin[u]
        root = joined(len(line), u[known[v]], v[known[v]])
        places = np.empty(len(line), np.int64)
        places[order] = ((y[order] << 32) + low)[root]
        return pa.array(places, mask=part.column("y").is_null().to_numpy(zero_copy_only=False))

    return dealt.mapInArrow(batches, f"{kinds}, part bigint").drop("_strip")


def joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each vertex's component, of vertices 0 to ``n`` - 1 and edges ``u`` to ``v``."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            ahead = root[root]
            if (ahead == root).all():
                break
            root = ahead


def _worked(named: Sequence[str], reach: int, work: Callable[[Runs], Runs]):
    high, grouped = STRIP + 2 * reach, [*named, "strip"]

    def lines(part: pa.RecordBatch, first: np.ndarray) -> Runs:
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, part.num_rows)))
        y, strip = (pc.fill_null(part.column(c), 0).to_numpy(zero_copy_only=False) for c in ("y", "strip"))
        # A line is as high as two strips' reach, so that lines moved out of one strip meet no other's.
        return of * (high + 2 * reach) + y - strip * STRIP + 2 * reach, *(part.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "x1"))

    def batch(part: pa.RecordBatch, first: np.ndarray, runs: Runs, whole: bool) -> pa.RecordBatch:
        """Runs with the keys of their strip; of a strip that is done its own rows alone."""
        of, row = np.divmod(runs[0], high + 2 * reach)
        row = row - 2 * reach
        if whole:
            own = (row >= 0) & (row < STRIP)
            of, row, runs = of[own], row[own], tuple(a[own] for a in runs)
        at = pa.array(first[of])
        strip = part.column("strip").take(at)
        y = pc.add(pc.multiply(strip, STRIP), pa.array(row, pa.int64()))
        cols = {n: part.column(n).take(at) for n in named} | ({} if whole else {"strip": strip})
        cols |= {"y": y, "x0": pa.array(runs[1], pa.int64()), "x1": pa.array(runs[2], pa.int64())}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def done(part: pa.RecordBatch) -> pa.RecordBatch:
        first = starts(part, grouped)
        return batch(part, first, work(cover(lines(part, first))), True)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in parts:
            if held is not None:
                part = pa.Table.from_batches([held, part.cast(held.schema)]).combine_chunks().to_batches()[0]
            if not part.num_rows:
                continue
            last = int(starts(part, grouped)[-1])
            if last:
                yield done(part.slice(0, last))
            held = part.slice(last)
            if held.num_rows > MOST:
                first = np.zeros(1, np.int64)
                held = batch(held, first, cover(lines(held, first)), False).cast(held.schema)
        if held is not None:
            yield done(held)

    return batches
