"""Ranked lexical search: bundles of items pass from one owner of terms to the next, which add whole-number contributions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotlake.llm.common import body, lists, lower, remove_folder, small_batches, span_values, text_slices, word_spans
from annotlake.plans.durable import cut, shared_folder

TOP = 10
OWNERS = 4
GROWTH = 3  # each owner holds about so many times the postings of the one before
BLOCK_TERMS = 50_000  # of items searched in one go: their terms, and their number
BLOCK_ITEMS = 1_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = np.zeros(256, bool)
_GAP[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

POSTINGS = "block long, doc_ids array<long>, lengths array<long>, terms array<int>, ends array<int>, docs array<int>, tfs array<int>"
OWNED = "block long, doc_ids array<long>, n_docs int, terms array<int>, ends array<int>, docs array<int>, impacts array<int>"
BUNDLE = "block long, item int, docs array<int>, scores array<long>, best array<long>"


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, times``; rows that share an item_id are one item."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _row(part: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [part.column(c)[i].values.to_numpy(zero_copy_only=False) for c in names]


def _one(values: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    return lists(values, [len(values)], kind)


def _indexer(vocabulary: Broadcast):
    """Postings of each batch of texts for the terms of the vocabulary: a block, its terms in order, each term's documents by place in the block."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.large_binary())
        task = TaskContext.get().partitionId()
        for k, part in enumerate(parts):
            n = part.num_rows
            lengths, keys, counts = np.zeros(n, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for first, last, raw, offsets in text_slices(part.column("body")):
                raw = lower(raw)
                starts, ends, at = word_spans(raw, offsets, _GAP)
                lengths[first:last] = np.diff(at)
                place = pc.fill_null(pc.index_in(span_values(raw, starts, ends), value_set=known), -1).to_numpy().astype(np.int64)
                docs = np.repeat(np.arange(first, last), np.diff(at))
                found, times = np.unique((place * n + docs)[place >= 0], return_counts=True)
                keys.append(found)
                counts.append(times)
            key, tfs = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, tfs = key[order], tfs[order]
            terms, begin = np.unique(key // max(n, 1), return_index=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | k], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column("doc_id")),
                    _one(lengths, pa.int64()),
                    _one(terms),
                    _one(np.append(begin, len(key))[1:]),
                    _one(key % max(n, 1)),
                    _one(tfs),
                ],
                names=["block", "doc_ids", "lengths", "terms", "ends", "docs", "tfs"],
            )

    return batches


def impacts(tfs: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """How much an occurrence count adds to a score, in millionths of the term's weight, at each document's length."""
    m = 100 - 75 + 75 * lengths * n_docs // n_terms
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def _statistics(size: int, n_docs: int, n_terms: int):
    """Of each term the documents that hold it and its highest impact."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for part in parts:
            for i in range(part.num_rows):
                terms, ends, docs, tfs, lengths = _row(part, i, "terms", "ends", "docs", "tfs", "lengths")
                if len(terms):
                    begin = np.append(0, ends[:-1])
                    df[terms] += ends - begin
                    gain = impacts(tfs.astype(np.int64), lengths[docs], n_docs, n_terms)
                    most[terms] = np.maximum(most[terms], np.maximum.reduceat(gain, begin))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": held.astype(np.int32), "df": df[held], "most": most[held]})

    return batches


def _owned(owner_of: Broadcast, owner: int, n_docs: int, n_terms: int):
    """The part of each block's postings that an owner holds, as impacts."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                terms, ends, docs, tfs, lengths = _row(part, i, "terms", "ends", "docs", "tfs", "lengths")
                mine = owner_of.value[terms] == owner
                size = np.diff(ends, prepend=0)
                on = np.repeat(mine, size)
                gain = impacts(tfs[on].astype(np.int64), lengths[docs[on]], n_docs, n_terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("block").slice(i, 1),
                        part.column("doc_ids").slice(i, 1),
                        pa.array([len(lengths)], pa.int32()),
                        _one(terms[mine]),
                        _one(np.cumsum(size[mine])),
                        _one(docs[on]),
                        _one(gain),
                    ],
                    names=["block", "doc_ids", "n_docs", "terms", "ends", "docs", "impacts"],
                )

    return batches


def _stage(routes: Broadcast, owner: int, last: bool):
    """What an owner does with the bundles of a block: adds its terms' contributions, and lets go of documents out of reach.

    ``routes``: for each item its terms' owners, numbers and weights, what the owners after each can
    still add at most, and the least score that its ``TOP`` best documents are known to reach.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("item", "docs", "scores", "best")}
        block, doc_ids = None, None
        if right.num_rows:
            part = right.combine_chunks().to_batches()[0]
            block, n = part.column("block")[0].as_py(), part.column("n_docs")[0].as_py()
            doc_ids = part.column("doc_ids")[0].values
            terms, ends, docs, gains = _row(part, 0, "terms", "ends", "docs", "impacts")
            held = {int(left.column("item")[i].as_py()): i for i in range(left.num_rows)}
            for item, route in enumerate(routes.value):
                mine = route["owner"] == owner
                names, weights = route["term"][mine], route["weight"][mine]
                place = np.searchsorted(terms, names)
                on = place < len(terms)
                on[on] = terms[place[on]] == names[on]
                if item not in held and not on.any():
                    continue
                score = np.zeros(n, np.int64)
                if item in held:
                    i = held[item]
                    score[left.column("docs")[i].values.to_numpy()] = left.column("scores")[i].values.to_numpy()
                for p, w in zip(place[on], weights[on], strict=True):
                    span = slice(ends[p - 1] if p else 0, ends[p])
                    score[docs[span]] += w * gains[span].astype(np.int64)
                alive = np.flatnonzero(score > 0)
                if not len(alive):
                    continue
                score = score[alive]
                best = np.sort(score)[::-1][:TOP]
                least = max(route["least"], best[-1] if len(best) == TOP else 0)
                near = score + route["rest"][owner] >= least
                if near.any():
                    for c, v in (("item", item), ("docs", alive[near]), ("scores", score[near]), ("best", best)):
                        out[c].append(v)
        counts = [len(d) for d in out["docs"]]
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *out[c]]).astype(kind)
        items, docs_, scores = pa.array(out["item"], pa.int32()), flat("docs", np.int64), flat("scores", np.int64)
        if last:
            rows = [items.take(pa.array(np.repeat(np.arange(len(counts)), counts))), doc_ids.take(pa.array(docs_)) if len(docs_) else pa.array([], pa.int64()), pa.array(scores)]
            return pa.table(rows, names=["item", "doc_id", "score"])
        blocks = pa.array([block] * len(counts), pa.int64())
        best = lists(flat("best", np.int64), [len(b) for b in out["best"]])
        return pa.table([blocks, items, lists(docs_, counts, pa.int32()), lists(scores, counts), best], names=["block", "item", "docs", "scores", "best"])

    return work


def _best(rows: DataFrame, *order) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= TOP)


def _owners(df: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each term: rare terms first, each owner about ``GROWTH`` times the postings of the one before."""
    order = np.argsort(df, kind="stable")
    upto = np.cumsum(df[order]) / max(1, df.sum())
    shares = np.cumsum([float(GROWTH) ** k for k in range(owners)])
    out = np.empty(len(df), np.int32)
    out[order] = np.minimum(np.searchsorted(shares / shares[-1], upto), owners - 1)
    return out


def _search(texts: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """The best documents of one block of items; ``wanted``: item_id, term, times."""
    spark, sc = texts.sparkSession, texts.sparkSession.sparkContext
    rows = wanted.orderBy(F.col("item_id").asc_nulls_last(), "term").collect()
    vocabulary = sorted({r["term"].encode() for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    named: dict[int | None, list[tuple[int, int]]] = {}
    for r in rows:
        named.setdefault(r["item_id"], []).append((number[r["term"].encode()], r["times"]))
    texts.mapInArrow(_indexer(sc.broadcast(vocabulary)), POSTINGS).write.parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    long = F.lit(0).cast("long")
    n_docs, n_terms = postings.agg(F.sum(F.aggregate("lengths", long, lambda s, x: s + (x > 0).cast("long"))), F.sum(F.aggregate("lengths", long, lambda s, x: s + x))).first()
    df, most = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    if n_terms:
        read = postings.select("terms", "ends", "docs", "tfs", "lengths")
        for r in read.mapInArrow(_statistics(len(vocabulary), n_docs, n_terms), "term int, df long, most long").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).collect():
            df[r["term"]], most[r["term"]] = r["df"], r["most"]
    weight = np.floor(1000 * np.log((2 * (n_docs or 0) + 2) / (2 * df + 1))).astype(np.int64)
    owner = _owners(df, OWNERS)
    routes = []
    for mine in named.values():
        term = np.array([t for t, _ in mine])
        w = weight[term] * np.array([c for _, c in mine])
        rest = [int((w * most[term])[owner[term] > k].sum()) for k in range(OWNERS)]
        routes.append({"owner": owner[term], "term": term, "weight": w, "rest": rest, "least": 0})
    owner_of, bundles = sc.broadcast(owner), spark.createDataFrame([], BUNDLE)
    for k in range(OWNERS):
        last = k == OWNERS - 1
        held = postings.mapInArrow(_owned(owner_of, k, n_docs, n_terms), OWNED)
        met = bundles.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(_stage(sc.broadcast(routes), k, last), "item int, doc_id long, score long" if last else BUNDLE)
        if last:
            break
        met.write.parquet(f"{folder}/bundles-{k}")
        bundles = spark.read.parquet(f"{folder}/bundles-{k}")
        top = _best(bundles.select("item", F.explode("best").alias("score")), F.col("score").desc())
        for r in top.where(F.col("rank") == TOP).collect():
            routes[r["item"]]["least"] = r["score"]
    ranked = _best(met, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ids = spark.createDataFrame(list(enumerate(named)), "item int, item_id long")
    found = cut(ranked.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    remove_folder(spark, folder)
    return found


def ranked_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ten best documents of each item, by whole-number weights of shared terms.

    A term is a run of letters, digits and characters beyond ASCII, A-Z lower-cased. With N
    documents that hold a term, df of them this one, tf times in a document of n terms, L terms in all:
    w = floor(1000 ln((2N+2)/(2df+1))), m = 25 + 75nN div L, and the document gains
    w * (10^9 tf div (1000 tf + 8m)) for each time the item names the term. Documents without gain
    have no rank; equal scores rank by doc_id, nulls last.

    Postings of the items' terms stay in the blocks (batches of at most 8 MB of text) in which the
    texts were read. Terms are dealt to ``OWNERS`` by the number of documents that hold them, rare ones
    first. An item's bundle carries its documents' scores, a row for each block, from owner to owner:
    a cogroup by block, so no term or item gathers in one task. After each owner the tenth best score
    so far is a bound that documents must still be able to reach with what the later owners can
    add at most; the others are let go, which changes no result.

    Items are searched in blocks of about ``BLOCK_TERMS`` terms and ``BLOCK_ITEMS`` items, which the
    driver holds; every block reads all documents. Rows that share an item_id are one item; rows
    that share a doc_id are documents of their own; null ids are ids. Null or empty texts have no
    terms; very long ones are read whole, as a block of their own. Empty tables give an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body())
    wanted = cut(item_terms(items))
    terms, n_items = wanted.count(), wanted.select("item_id").distinct().count()
    blocks = max(1, -(-terms // BLOCK_TERMS), -(-n_items // BLOCK_ITEMS))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks if terms else 0):
        block = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else wanted
        found = found.unionByName(_search(texts, block, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"))
    return found
