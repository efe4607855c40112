"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotlake.llm.common import (
    body,
    lower,
    mix,
    packed,
    shingle_hashes,
    sized_broadcast,
    small_batches,
    span_hashes,
    text_key,
    text_slices,
    word_spans,
    words_in,
)
from annotlake.plans.durable import cut

WIDTH = 5
PERCENT = 80
RADIUS = 20
BLOCKS = 7  # 20 = 7 * 2 + 6: codes within the radius lie within 2 in one of the blocks
BLOCK_WORDS = 2_000_000
FILTER_BITS = 22

_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)
FOUND = "item_id long, start_word long, n_words long, similarity double"


def simhash(shingles: np.ndarray) -> np.uint64:
    """Signs of the bit sums of shingle hashes, repeated shingles weighing as often as they occur."""
    return simhashes(bit_sums(shingles), np.zeros(1, np.int64), np.full(1, len(shingles), np.int64))[0]


def bit_sums(shingles: np.ndarray) -> np.ndarray:
    """Running sums of +1 and -1 for each of the 64 bits."""
    bits = np.unpackbits(np.ascontiguousarray(shingles, np.uint64).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(2 * bits - 1, axis=0, out=sums[1:])
    return sums


def simhashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprints of the shingles from ``first`` up to ``last``."""
    return np.packbits(sums[last] - sums[first] > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def block_values(codes: np.ndarray) -> np.ndarray:
    """Each code's blocks, one column a block."""
    return np.stack([codes >> np.uint64(a) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True)], axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles: sum of smaller over sum of larger counts."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / max(1, len(a) + len(b) - both)


class Index:
    """The items of one block of the benchmark, filed by size and by every block value within two bits of theirs."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.bags, self.sizes, codes = [], [], [], []
        self.table: dict[tuple[int, int, int], list[int]] = {}
        for item_id, text in items:
            words = _words(text)
            if not len(words):
                continue
            bag, _ = shingle_hashes(words, np.array([0, len(words)]), WIDTH)
            k = len(self.ids)
            self.ids.append(item_id)
            self.bags.append(bag)
            self.sizes.append(len(words))
            codes.append(simhash(bag))
            for b, value in enumerate(block_values(np.array(codes[-1:], np.uint64))[0]):
                for near in self._near(int(value), int(_EDGES[b + 1] - _EDGES[b])):
                    self.table.setdefault((len(words), b, near), []).append(k)
        self.codes = np.array(codes, np.uint64)
        known = np.unique(np.concatenate([*self.bags, np.zeros(0, np.uint64)]))
        self.known = known
        self.sieve = np.zeros(1 << FILTER_BITS, bool)
        self.sieve[known >> np.uint64(64 - FILTER_BITS)] = True
        self.windows = sorted({n for n in self.sizes if n >= WIDTH})
        self.short = sorted({n for n in self.sizes if n < WIDTH})

    @staticmethod
    def _near(value: int, width: int) -> list[int]:
        ones = [1 << i for i in range(width)]
        return [value, *[value ^ x for x in ones], *[value ^ x ^ y for i, x in enumerate(ones) for y in ones[:i]]]

    def held(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles occur in any item."""
        hit = self.sieve[shingles >> np.uint64(64 - FILTER_BITS)]
        at = np.flatnonzero(hit)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
            hit[at] = self.known[place] == shingles[at]
        return hit

    def matches(self, shingles: np.ndarray, n_words: int, percent: int) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window of every stretch that an item meets.

        A window can only reach the similarity if enough of its shingles occur in the
        benchmark at all, so the others are left out before their fingerprints are made.
        """
        hits = np.concatenate([[0], np.cumsum(self.held(shingles))])
        if not hits[-1]:
            return []
        found, sums = [], None
        for size in self.windows:
            q = size - WIDTH + 1
            need = -(-2 * q * percent // (100 + percent))  # shared shingles of two bags of q
            if n_words < size:
                q = len(shingles)
                need = -(-percent * (size - WIDTH + 1) // 100)
            if n_words < WIDTH or hits[-1] < need or q < need:
                continue
            first = np.flatnonzero(hits[q:] - hits[:-q] >= need)
            if not len(first):
                continue
            if sums is None:
                sums = bit_sums(shingles)
            codes = simhashes(sums, first, first + q)
            values = block_values(codes)
            for at, code, blocks in zip(first, codes, values, strict=True):
                near = {k for b, v in enumerate(blocks) for k in self.table.get((size, b, int(v)), ())}
                for k in near:
                    if int(code ^ self.codes[k]).bit_count() <= RADIUS:
                        s = similarity(shingles[at : at + q], self.bags[k])
                        if s * 100 >= percent - 1e-9:
                            found.append((k, int(at), min(size, n_words), s))
        return found

    def short_matches(self, words: np.ndarray, size: int) -> list[tuple[int, int, int, float]]:
        """Items of fewer words than a shingle: their one shingle is the whole sequence."""
        if len(words) < size:
            return []
        h, _ = shingle_hashes(words, np.array([0, len(words)]), size)
        of_size = [k for k, n in enumerate(self.sizes) if n == size]
        return [(k, int(i), size, 1.0) for k in of_size for i in np.flatnonzero(h == self.bags[k][0])]


def _words(text: bytes) -> np.ndarray:
    raw = lower(np.frombuffer(text, np.uint8))
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
    return span_hashes(raw, starts, ends)


def best_of_stretches(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of each item's windows the most similar, then the most similar that overlaps none taken, and so on; the first among equals."""
    best: list[tuple[int, int, int, float]] = []
    taken: dict[int, list[int]] = {}
    for k, at, n, s in sorted(found, key=lambda f: (f[0], -f[3], f[1])):
        starts = taken.setdefault(k, [])
        i = bisect.bisect_left(starts, at)
        if (i == 0 or starts[i - 1] + n <= at) and (i == len(starts) or at + n <= starts[i]):
            starts.insert(i, at)
            best.append((k, at, n, s))
    return sorted(best)


def _finder(items: list[tuple[int, bytes]], percent: int, keys: list[str]):
    index: list[Index] = []

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not index:
            index.append(Index(items))
        ix = index[0]
        for part in parts:
            rows = []
            for first, last, raw, offsets in text_slices(part.column("body")):
                raw = lower(raw)
                starts, ends, at = word_spans(raw, offsets)
                words = span_hashes(raw, starts, ends)
                shingles, edge = shingle_hashes(words, at, WIDTH)
                any_hit = np.concatenate([[0], np.cumsum(ix.held(shingles))])
                for i in range(last - first):
                    found = []
                    if any_hit[edge[i + 1]] > any_hit[edge[i]]:
                        found += ix.matches(shingles[edge[i] : edge[i + 1]], int(at[i + 1] - at[i]), percent)
                    for size in ix.short:
                        found += ix.short_matches(words[at[i] : at[i + 1]], size)
                    if found:
                        doc = [part.column(c)[first + i].as_py() for c in keys]
                        rows += [(*doc, ix.ids[k], p, n, s) for k, p, n, s in best_of_stretches(found)]
            names = [*keys, "item_id", "start_word", "n_words", "similarity"]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int64()] * (len(names) - 1) + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return batches


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity``: where documents hold benchmark items.

    Every window of an item's number of words (the whole text where it is shorter) is
    compared with the item as bags of five-word shingles; of overlapping windows
    the best one counts. Fingerprints within ``RADIUS`` bits are certain to meet in a block;
    the bags of those pairs decide.

    The benchmark is a query set: it goes to the tasks in blocks of at most about
    ``BLOCK_WORDS`` words, and each block is matched against all documents, which stay in
    place. Null or empty texts on either side match nothing; an item of fewer than five words
    must occur word by word; equal items all match; a null item_id or doc_id is carried.
    """
    return _matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), body()), ["doc_id"], benchmark, percent)


def _matches(texts: DataFrame, keys: list[str], benchmark: DataFrame, percent: int) -> DataFrame:
    """The matches of ``texts``: ``keys`` (numbers) and body."""
    small_batches(texts.sparkSession)
    sized = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), body(), words_in(F.col("text")).alias("n")).where("n > 0"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    schema = ", ".join([*[f"{c} long" for c in keys], FOUND])
    found = None
    for b in range(blocks):
        block = sized.where(F.pmod(F.xxhash64("body"), F.lit(blocks)) == b) if blocks > 1 else sized
        items = [(r["item_id"], bytes(r["body"])) for r in block.select("item_id", "body").orderBy("item_id", "body").collect()]
        got = texts.mapInArrow(_finder(items, percent, keys), schema)
        found = got if found is None else found.unionByName(got)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Every row is judged by its text, whatever its doc_id: null and repeated ones too.
    """
    texts = docs.where(F.col("text").isNotNull()).select(*text_key(), body())
    found = cut(_matches(texts, ["t1", "t2"], benchmark, percent).select("t1", "t2").distinct())
    return packed(docs, *text_key()).join(sized_broadcast(found), ["t1", "t2"], "left_anti").select("row.*")
