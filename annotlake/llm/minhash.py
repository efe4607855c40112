"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.llm.common import (
    body,
    lists,
    lower,
    mix,
    packed,
    release,
    shingle_hashes,
    sized_broadcast,
    small_batches,
    span_hashes,
    text_key,
    text_slices,
    word_spans,
)
from annotlake.plans.durable import cut
from annotlake.plans.graph import star_components

BANDS = 32
ROWS = 5
BITS = 2
LONGS = -(-BANDS * ROWS // 64)
PLANES = [f"p{b}_{i}" for b in range(BITS) for i in range(LONGS)]
CENTRES = 3

_rng = np.random.default_rng(20240229)
_TIMES = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_FLIP = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_FOLD = _rng.integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

_FEATURES = ", ".join(["n long", "hi long", "lo long", *[f"{p} long" for p in PLANES], "bands array<long>"])


def _shingles(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per slice of texts: its first row and each text's distinct shingle hashes, ascending."""
    for first, _, raw, offsets in text_slices(column):
        raw = lower(raw)
        starts, ends, at = word_spans(raw, offsets)
        hashes, at = shingle_hashes(span_hashes(raw, starts, ends), at, width)
        yield first, [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def _minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function, in blocks so that long texts need no more memory than short ones."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(low), 2048):
        h = (low[i : i + 2048, None] ^ _FLIP) * _TIMES
        np.minimum(least, h.min(axis=0), out=least)
    return least


def _features(width: int, keys: list[str]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, sets in _shingles(part.column("body"), width):
                n = np.array([len(s) for s in sets], np.int64)
                least = np.zeros((len(sets), BANDS * ROWS), np.uint32)
                hi, lo = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        least[i] = _minima(s)
                        hi[i], lo[i] = mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(7)))
                folded = (least.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _FOLD
                bands = mix(folded.sum(axis=2, dtype=np.uint64) + _BAND)
                planes = {}
                for b in range(BITS):
                    bits = np.zeros((len(sets), LONGS * 64), np.uint8)
                    bits[:, : BANDS * ROWS] = mix(least.astype(np.uint64)).astype(np.uint8) >> b & 1
                    packed = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
                    planes |= {f"p{b}_{i}": packed[:, i] for i in range(LONGS)}
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: part.column(c).slice(first, len(sets)) for c in keys},
                        "n": n,
                        "hi": hi.view(np.int64),
                        "lo": lo.view(np.int64),
                        **planes,
                        "bands": lists(bands.reshape(-1).view(np.int64), np.full(len(sets), BANDS)),
                    }
                )

    return batches


def _sets(width: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, sets in _shingles(part.column("body"), width):
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                ids = part.column("id").slice(first, len(sets))
                yield pa.RecordBatch.from_pydict({"id": ids, "shingles": lists(flat, [len(s) for s in sets])})

    return batches


def features(docs: DataFrame, width: int = 5, by_text: bool = False) -> DataFrame:
    """``doc_id`` (and the hashes of the text), set size ``n``, a 128-bit fingerprint of the set (hi, lo), packed low bits of the minima, band keys."""
    keys = ["doc_id", *(["t1", "t2"] if by_text else [])]
    schema = ", ".join([*[f"{c} long" for c in keys], _FEATURES])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(text_key() if by_text else []), body()).mapInArrow(_features(width, keys), schema)


def estimate(a: str, b: str) -> Column:
    """Similarity from the packed bits of two signatures, corrected for bits that agree by chance."""
    differ = None
    for i in range(LONGS):
        any_bit = None
        for bit in range(BITS):
            x = F.col(f"{a}.p{bit}_{i}").bitwiseXOR(F.col(f"{b}.p{bit}_{i}"))
            any_bit = x if any_bit is None else any_bit.bitwiseOR(x)
        differ = F.bit_count(any_bit) if differ is None else differ + F.bit_count(any_bit)
    chance = 0.5**BITS
    return (F.lit(1.0) - differ / F.lit(float(BANDS * ROWS)) - F.lit(chance)) / F.lit(1 - chance)


def slack(percent: int, sigmas: float = 6.0) -> float:
    """Estimate below which a pair of the given similarity falls with negligible probability."""
    chance, s = 0.5**BITS, percent / 100
    p = s + chance * (1 - s)
    return s - sigmas * (p * (1 - p) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) with signatures, the ids that may reach the similarity by set size and estimate."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    close = (small * 100 >= large * percent) & (estimate("x", "y") >= slack(percent))
    return pairs.where(close).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets meet ``100 * intersection >= percent * union``."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _mixed(rest: DataFrame) -> DataFrame:
    """Members of buckets in which more than one component is left."""
    keys = rest.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    return rest.join(cut(keys), "key")


def _peeled(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of bucket members ``key, s, comp``, those that may still have a partner, with ``own``: shingles no other member holds.

    A set of n shingles, ``own`` of them its own, shares at most ``n - own`` with any other;
    against the smallest set of its bucket that bounds its similarity. Members that can't
    reach it leave, which may leave others more shingles of their own, so this is done twice.
    """
    for _ in range(2):
        ids = rest.select(F.col("s.id").alias("id")).distinct()
        token = sets.join(ids, "id", "left_semi").select("id", F.explode("shingles").alias("token"))
        alone = token.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("_id")).where("m = 1")
        own = cut(alone.groupBy("_id").agg(F.count(F.lit(1)).alias("own")))
        members = rest.drop("own").join(own, F.col("s.id") == F.col("_id"), "left").select("key", "s", "comp", F.coalesce("own", F.lit(0)).alias("own"))
        members = cut(members)
        smallest = cut(members.groupBy("key").agg(F.min("s.n").alias("least")))
        shared = F.col("s.n") - F.col("own")
        may = shared * 100 >= (F.col("s.n") + F.greatest(F.col("least"), shared) - shared) * percent
        rest = cut(_mixed(cut(members.join(smallest, "key").where(may).select("key", "s", "comp", "own"))))
    return rest


def _joined(roots: DataFrame, late: DataFrame) -> DataFrame:
    """Components after more links: those there are shrink to one vertex each before the links join them."""
    if late.isEmpty():
        return roots
    short = lambda side: roots.select(F.col("u").alias(side), F.col("root").alias(f"_{side}"))
    linked = late.join(short("u"), "u", "left").join(short("v"), "v", "left")
    linked = star_components(linked.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")), [])
    above = linked.select(F.col("u").alias("root"), F.col("root").alias("top"))
    moved = roots.join(above, "root", "left").select("u", F.coalesce("top", "root").alias("root"))
    return cut(moved.unionByName(linked))


def _roots(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int, width: int) -> DataFrame:
    """``u, root`` of the linked classes among ``id, n``, signatures and bands; ``texts_of`` gives ``id, body`` of a table of ``_id``."""
    sketch = F.struct("id", "n", *PLANES)
    shared = cut(classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"))
    live = cut(classes.select(F.explode("bands").alias("key"), sketch.alias("s")).join(shared, "key").select("key", "s", F.col("s.id").alias("comp")))

    needed = cut(live.select(F.col("s.id").alias("_id")).distinct())
    sets = cut(texts_of(needed).mapInArrow(_sets(width), "id long, shingles array<long>"))

    chosen = [F.min_by("s", F.xxhash64(F.lit(k), F.col("s.id"))) for k in range(CENTRES)]
    mixed = live.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.array(*chosen).alias("centres"))
    mixed = cut(mixed.where("c0 <> c1").select("key", "centres"))
    met = cut(live.join(mixed, "key").select("key", "s", "centres"))
    pairs = met.select(F.col("s").alias("x"), F.explode("centres").alias("y")).where("x.id <> y.id")
    links = cut(_confirmed(cut(_candidates(pairs, percent)), sets, percent))
    release(classes.sparkSession)
    roots = star_components(links, [])
    release(classes.sparkSession)

    rest = met.where(~F.exists("centres", lambda c: c["id"] == F.col("s.id"))).select("key", "s")
    rest = rest.join(roots.withColumnRenamed("u", "_u"), F.col("s.id") == F.col("_u"), "left").select("key", "s", F.coalesce("root", "s.id").alias("comp"))
    rest = cut(_mixed(cut(rest)))
    if rest.isEmpty():
        return roots
    rest = _peeled(rest, sets, percent)
    if rest.isEmpty():
        return roots
    hub = cut(rest.groupBy("key").agg(F.min_by(F.struct("s", "comp"), F.struct("own", "s.id")).alias("hub")))
    met = cut(rest.join(hub, "key"))
    pairs = met.where("comp <> hub.comp").select(F.col("s").alias("x"), F.col("hub.s").alias("y"))
    roots = _joined(roots, cut(_confirmed(cut(_candidates(pairs, percent)), sets, percent)))
    release(classes.sparkSession)

    left = met.where("s.id <> hub.s.id").select("key", "s", "comp", "own").join(
        roots.select(F.col("u").alias("comp"), F.col("root").alias("_root")), "comp", "left"
    )
    left = cut(_mixed(cut(left.select("key", "s", F.coalesce("_root", "comp").alias("comp"), "own"))))
    if left.isEmpty():
        return roots
    left = cut(left.join(classes.select(F.col("id").alias("_id"), "bands"), F.col("s.id") == F.col("_id")).drop("_id"))
    other = left.select("key", F.col("s").alias("y"), F.col("comp").alias("other"), F.col("own").alias("own_y"), F.col("bands").alias("bands_y"))
    most = F.least(F.col("x.n") - F.col("own"), F.col("y.n") - F.col("own_y"))
    may = (F.col("comp") < F.col("other")) & (most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent)
    once = F.array_intersect("bands", "bands_y")[0] == F.col("key")  # a pair that shares several bands meets in the first
    pairs = left.select("key", F.col("s").alias("x"), "comp", "own", "bands").join(other, "key").where(may & once).select("x", "y")
    return _joined(roots, cut(_confirmed(cut(_candidates(pairs, percent)), sets, percent)))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words at white space; a document's set holds its
    distinct runs of ``width`` words, or the whole sequence where it has fewer. Two documents
    are linked when ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    doc_id that links reach, ``kept`` marks it.

    Equal sets are folded into one class first, so copies are never paired. Classes that share
    a band of minima are compared inside their band bucket: first against a few centres, which
    settles every pair with a centre, then, where components still meet, against the member
    with the fewest shingles of its own, and what then still lies in different components and
    has room for a link, against each other. A bucket
    whose members lie in one component is finished, so groups of any size cost a few rows a
    member. Aggregates are written before they meet hot keys, so that both sides of such joins
    are plain shuffles that adaptive execution can split. Estimates from packed bits thin the pairs; whole sets decide.

    No words or a null text: the empty set, linked with nothing. A null doc_id: its row comes
    back with a null component, kept. Rows that share a doc_id are one document. An empty
    table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    found = cut(features(docs, width))
    full = found.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("hi", "lo", "n").agg(F.min(F.struct(F.col("doc_id").alias("id"), *PLANES, "bands")).alias("r"))
    classes = cut(classes.select("hi", "lo", F.col("r.id").alias("id"), "n", *[f"r.{p}" for p in PLANES], "r.bands"))

    def texts_of(needed: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
        return texts.join(sized_broadcast(needed), F.col("id") == F.col("_id"), "left_semi").select("id", body())

    roots = _roots(classes, texts_of, percent, width)
    result = classes.select("hi", "lo", "id").join(roots.withColumnRenamed("u", "id"), "id", "left")
    result = cut(result.groupBy("hi", "lo").agg(F.min(F.coalesce("root", "id")).alias("root")))
    out = found.select("doc_id", "n", "hi", "lo").join(result, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _doomed(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """By ``doc_id, t1, t2``: the rows that go, and those that stay but occur more than once."""
    found = cut(features(docs, width, by_text=True))
    full = found.where(F.col("n") > 0)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    classes = full.groupBy("hi", "lo", "n").agg(F.min(F.struct(row.alias("row"), *PLANES, "bands")).alias("r"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "hi", "lo", "n", "r.row", *[f"r.{p}" for p in PLANES], "r.bands"))

    def texts_of(needed: DataFrame) -> DataFrame:
        chosen = needed.join(classes.select(F.col("id").alias("_id"), "row.t1", "row.t2"), "_id")
        texts = docs.select("text", F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2"))
        met = texts.join(sized_broadcast(cut(chosen)), (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")))
        return met.groupBy(F.col("_id").alias("id")).agg(F.first("text").alias("text")).select("id", body())

    roots = _roots(classes, texts_of, percent, width)
    named = cut(classes.select("id", "hi", "lo", "row").join(roots.withColumnRenamed("u", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    best = cut(named.groupBy("root").agg(F.min("row").alias("best")))
    best = cut(named.join(best, "root").select("hi", "lo", "best"))
    judged = full.select("doc_id", "t1", "t2", "hi", "lo", row.alias("row")).join(best, ["hi", "lo"]).withColumn("stays", F.col("row") == F.col("best"))
    judged = cut(judged.groupBy("doc_id", "t1", "t2", "stays").agg(F.count(F.lit(1)).alias("m")).where("not stays or m > 1"))
    return judged.where("not stays").drop("stays", "m"), judged.where("stays").drop("stays", "m")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One row of each group of near duplicates, with all its columns, and every row without words.

    Rows are judged by their text, whatever their doc_id: of a group the row with the smallest
    doc_id stays, nulls last, then by a hash of the text; of rows equal in both, one, chosen
    by a hash of all columns. Texts are read whole; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    gone, many = _doomed(docs, percent, width)
    rows = packed(docs, F.col("doc_id").cast("long").alias("id"), *text_key())
    line = lambda df, name: sized_broadcast(df.select(F.struct("doc_id", "t1", "t2").alias(name)))
    on = lambda name: F.col("id").eqNullSafe(F.col(f"{name}.doc_id")) & (F.col("t1") == F.col(f"{name}.t1")) & (F.col("t2") == F.col(f"{name}.t2"))
    kept = rows.join(line(gone, "gone"), on("gone"), "left_anti")
    if many.isEmpty():
        return kept.select("row.*")
    repeated = kept.join(line(many, "many"), on("many"), "left_semi")
    one = repeated.groupBy("id", "t1", "t2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.join(line(many, "many"), on("many"), "left_anti").select("row.*").unionByName(one.select("row.*"))
