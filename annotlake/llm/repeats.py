"""Exact removal of long repeated byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.llm.common import _Powers, body, mix, sized_broadcast, small_batches, text_slices
from annotlake.plans.durable import cut

LENGTH = 400
GRAM = 128
RANGE = 16

_K = [np.uint64(0xA0761D6478BD642F + 2 * i) for i in range(6)]


class _Sums:
    """Prefix sums of a polynomial over some bytes, for hashes of any of their spans."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _Powers.upto(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window of ``width`` values, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def sampled(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The sample of some texts: every window of ``length`` bytes elects the first of its grams with the smallest hash.

    Equal windows elect the same place in them, so two equal windows always meet at a sampled
    place: the sample is a difference cover that the content chooses. Neighbouring windows
    mostly elect the same place; returned is a row for each stretch of windows that do:
    text, first and last window start, elected place, hash of its gram, hash of all bytes of
    the stretch.
    """
    none = {k: np.zeros(0, np.int64) for k in ("row", "lo", "hi", "at")} | {k: np.zeros(0, np.uint64) for k in ("key", "ctx")}
    if len(raw) < length:
        return none
    sums = _Sums(raw)
    places = np.arange(len(raw) - gram + 1)
    hashes = mix(sums.of(places, places + gram))
    tagged = (hashes & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    elected = (_window_minima(tagged, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(elected)]
    starts = np.flatnonzero(np.arange(len(elected)) + length <= offsets[1:][row])
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (elected[starts[1:]] != elected[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    at = elected[lo]
    return {
        "row": row[lo],
        "lo": lo,
        "hi": hi,
        "at": at,
        "key": hashes[at],
        "ctx": mix(sums.of(lo, hi + length) + _K[0] * (at - lo).astype(np.uint64) + _K[1] * (hi - lo).astype(np.uint64)),
    }


def _stretches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for first, last, raw, offsets in text_slices(part.column("body")):
            s = sampled(raw, offsets)
            lo = s["lo"] - offsets[s["row"]]
            span = (lo << 24) | ((s["hi"] - s["lo"]) << 12) | (s["at"] - s["lo"])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").slice(first, last - first).take(pa.array(s["row"])),
                    "h": part.column("h").slice(first, last - first).take(pa.array(s["row"])),
                    "span": span,
                    "key": s["key"].view(np.int64),
                    "ctx": s["ctx"].view(np.int64),
                }
            )


def _pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of chosen stretches."""
    for part in parts:
        for i in range(part.num_rows):
            raw = part.column("body")[i].as_py()
            rows = part.column("chosen")[i].as_py()
            out = {"doc_id": [part.column("doc_id")[i].as_py()] * len(rows), "h": [part.column("h")[i].as_py()] * len(rows)}
            out |= {c: [r[c] for r in rows] for c in ("span", "key", "multi")}
            out["piece"] = [raw[r["span"] >> 24 : (r["span"] >> 24) + (r["span"] >> 12 & 0xFFF) + LENGTH] for r in rows]
            kinds = {"doc_id": pa.int64(), "h": pa.int64(), "span": pa.int64(), "key": pa.int64(), "multi": pa.bool_(), "piece": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array(out[c], k) for c, k in kinds.items()})


def _blocks_of(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The aligned ranges of window offsets of stretches: stretch, block, first and last offset from the elected place (raised by 4096)."""
    width, off = span >> 12 & 0xFFF, span & 0xFFF
    low, high = 4096 - off, 4096 - off + width
    counts = high // RANGE - low // RANGE + 1
    which = np.repeat(np.arange(len(span)), counts)
    block = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low // RANGE, counts)
    return which, block, np.maximum(low[which], block * RANGE), np.minimum(high[which], block * RANGE + RANGE - 1)


def _ranges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each aligned range of windows of a stretch: a name of the bytes that all its windows share, and of all its bytes."""
    for part in parts:
        rid, multi = part.column("rid").to_numpy(), part.column("multi").to_numpy(zero_copy_only=False)
        key, spans = part.column("key").to_numpy().view(np.uint64), part.column("span").to_numpy()
        for first, last, raw, offsets in text_slices(part.column("piece")):
            sums, span = _Sums(raw), spans[first:last]
            which, block, o1, o2 = _blocks_of(span)
            place = offsets[which] + (span & 0xFFF)[which] - 4096
            core = mix(sums.of(place + block * RANGE + RANGE - 1, place + block * RANGE + LENGTH) + _K[2] * block.astype(np.uint64) + mix(key[first:last][which]))
            full = mix(sums.of(place + o1, place + o2 + LENGTH) + core + _K[3] * o1.astype(np.uint64) + _K[4] * o2.astype(np.uint64))
            yield pa.RecordBatch.from_pydict(
                {
                    "core": core.view(np.int64),
                    "full": full.view(np.int64),
                    "rid": rid[first:last][which],
                    "multi": multi[first:last][which],
                    "o1": o1,
                    "o2": o2,
                }
            )


def _windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A name for every single window of the chosen ranges."""
    for part in parts:
        rid, key, spans = part.column("rid").to_numpy(), part.column("key").to_numpy().view(np.uint64), part.column("span").to_numpy()
        chosen = part.column("chosen").to_pylist()
        for first, last, raw, offsets in text_slices(part.column("piece")):
            sums = _Sums(raw)
            which, o, need = [], [], []
            for i in range(first, last):
                for c in chosen[i]:
                    n = c["o2"] - c["o1"] + 1
                    which += [i - first] * n
                    o += range(c["o1"], c["o2"] + 1)
                    need += [c["need"]] * n
            which, o = np.array(which, np.int64), np.array(o, np.int64)
            place = offsets[which] + (spans[first:last] & 0xFFF)[which] - 4096 + o
            name = mix(sums.of(place, place + LENGTH) + mix(key[first:last][which]) + _K[5] * o.astype(np.uint64))
            yield pa.RecordBatch.from_pydict({"name": name.view(np.int64), "rid": rid[first:last][which], "o": o, "need": pa.array(need, pa.bool_())})


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, body, h) whose doc_id and text hash are among ``ids``."""
    wanted = cut(ids.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h")).distinct())
    return docs.join(sized_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left_semi")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """``doc_id, h, p1, p2``: ranges of window starts whose window of ``LENGTH`` bytes also starts elsewhere.

    ``texts`` has doc_id, body and h, a hash of body. Sampled stretches are named by their
    bytes. Stretches with a twin are repeated as wholes; stretches whose elected gram occurs
    once hold no repeat. For the rest, which lie at the ends of repeats, aligned ranges of
    windows are named next: a range with a twin is repeated as a whole, one whose shared
    bytes occur once holds no repeat, and the windows of the others are named one by one.
    Names are sums before shuffles; a group of equal stretches of any size is only counted.
    """
    found = cut(texts.select("doc_id", "h", "body").mapInArrow(_stretches, "doc_id long, h long, span long, key long, ctx long"))
    keys = cut(
        found.groupBy("key")
        .agg(F.count(F.lit(1)).alias("m"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
        .where("m > 1")
        .select("key", (F.col("c0") != F.col("c1")).alias("mixed"))
    )
    met = cut(found.join(keys, "key"))
    lo, width = F.shiftright("span", 24), F.shiftright("span", 12).bitwiseAND(F.lit(0xFFF))
    whole = [F.col("doc_id"), F.col("h"), lo.alias("p1"), (lo + width).alias("p2")]
    named = met.where("mixed").groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "span")).alias("one"))
    named = cut(named)
    twins = met.where("mixed").join(named.where("n > 1").select("key", "ctx"), ["key", "ctx"]).select(*whole)
    ranges = met.where("not mixed").select(*whole).unionByName(twins)

    chosen = named.select("one.doc_id", "one.h", F.struct("one.span", "key", (F.col("n") > 1).alias("multi")).alias("c"))
    chosen = chosen.groupBy("doc_id", "h").agg(F.collect_list("c").alias("chosen"))
    wanted = chosen.withColumnRenamed("doc_id", "_doc").withColumnRenamed("h", "_h")
    met_texts = _texts_of(texts, chosen).join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")))
    pieces = met_texts.select("doc_id", "h", "body", "chosen").mapInArrow(_pieces, "doc_id long, h long, span long, key long, multi boolean, piece binary")
    pieces = cut(pieces.dropDuplicates(["doc_id", "h", "span"]).withColumn("rid", F.monotonically_increasing_id()))

    named_ranges = pieces.select("rid", "key", "span", "multi", "piece").mapInArrow(_ranges, "core long, full long, rid long, multi boolean, o1 long, o2 long")
    by_full = cut(
        named_ranges.groupBy("core", "full").agg(
            F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"), F.min("multi").alias("multi"), F.min("o1").alias("o1"), F.min("o2").alias("o2")
        )
    )
    twin_ranges = named_ranges.where("not multi").join(by_full.where("n > 1").select("core", "full"), ["core", "full"]).select("rid", "o1", "o2")
    need = (F.col("n") == 1) & ~F.col("multi")
    unsure = cut(by_full.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.max(need).alias("any")).where("m > 1 and any").select("core"))
    asked = by_full.join(unsure, "core").select("rid", F.struct("o1", "o2", need.alias("need")).alias("c"))
    asked = asked.groupBy("rid").agg(F.collect_list("c").alias("chosen"))
    windows = cut(
        pieces.join(asked, "rid").select("rid", "key", "span", "piece", "chosen").mapInArrow(_windows, "name long, rid long, o long, need boolean")
    )
    again = cut(windows.groupBy("name").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("name"))
    single = windows.where("need").join(again, "name").select("rid", F.col("o").alias("o1"), F.col("o").alias("o2"))
    place = lo + F.col("span").bitwiseAND(F.lit(0xFFF)) - F.lit(4096)
    partial = twin_ranges.unionByName(single).join(pieces.select("rid", "doc_id", "h", "span"), "rid")
    return ranges.unionByName(partial.select("doc_id", "h", (place + F.col("o1")).alias("p1"), (place + F.col("o2")).alias("p2")))


def _kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for i in range(part.num_rows):
            raw = part.column("body")[i].as_py()
            depth = np.zeros(len(raw) + 1, np.int64)
            flat = np.array([(x["p1"], x["p2"]) for x in part.column("ranges")[i].as_py()], np.int64).reshape(-1, 2)
            np.add.at(depth, flat[:, 0], 1)
            np.add.at(depth, flat[:, 1] + LENGTH, -1)
            gone = np.cumsum(depth[:-1]) > 0
            rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((part.column("doc_id")[i].as_py(), len(raw), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), rest))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs``; ``kept`` holds the bytes that remain.

    A byte is removed when a string of ``LENGTH`` bytes that covers it also starts anywhere
    else, in the same row or another; overlaps count, and strings are judged before anything
    is removed. Matches don't cross rows. A null text is empty; texts shorter than
    ``LENGTH`` stay; repeated rows repeat each other; a null doc_id is carried; an empty
    table gives an empty result. ``kept`` may cut a character in two.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body()).withColumn("h", F.xxhash64("body"))
    ranges = repeated_windows(texts.where(F.octet_length("body") >= LENGTH))
    by_doc = cut(ranges.groupBy("doc_id", "h").agg(F.collect_list(F.struct("p1", "p2")).alias("ranges")))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))
    keyed = by_doc.withColumnRenamed("doc_id", "_doc").withColumnRenamed("h", "_h")
    cut_texts = _texts_of(texts, by_doc).join(keyed, same).select("doc_id", "body", "ranges")
    changed = cut_texts.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    untouched = texts.join(sized_broadcast(cut(keyed.select("_doc", "_h"))), same, "left_anti")
    none = F.lit(0).cast("long")
    return changed.unionByName(
        untouched.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("body").alias("kept"))
    )


def kept_digest() -> Column:
    return F.sha2("kept", 256).alias("kept_sha256")
