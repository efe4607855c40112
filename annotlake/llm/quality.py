"""Quality classifier: supervised subword embeddings averaged per document, softmax output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.llm.common import body, lists, release, small_batches, span_hashes, text_slices, word_spans
from annotlake.llm.labelled import remainder, training_rows

BUCKET_BITS = 16
DIM = 8
GRAMS = (3, 4)
PER_CLASS = 1500
EPOCHS = 12
RATE = 4.0
FOLD = (4, 2)
CUT = 0.7
SEED = 11

_TIMES = [np.uint64(0x9FB21C651E98DF25 + 2 * n) for n in range(8)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def buckets(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of several texts: for whole words and each n-gram width, bucket and place of every occurrence.

    n-grams are runs of bytes inside a word, so they don't cross texts.
    """
    shift = np.uint64(64 - BUCKET_BITS)
    starts, ends, _ = word_spans(raw, offsets)
    found = [((span_hashes(raw, starts, ends) >> shift).astype(np.int32), starts)]
    inside = ~_SPACE[raw]
    same = np.ones(len(raw) + 1, bool)
    same[offsets] = False  # a text begins here
    wide = raw.astype(np.uint64)
    for n in GRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        packed = np.zeros(m, np.uint64)
        valid = inside[:m].copy()
        for i in range(n):
            packed |= wide[i : i + m] << np.uint64(8 * i)
            if i:
                valid &= inside[i : i + m] & same[i : i + m]
        at = np.flatnonzero(valid)
        h = (packed[at] + np.uint64(1)) * _TIMES[n]
        h ^= h >> np.uint64(29)
        found.append(((h * _TIMES[0] >> shift).astype(np.int32), at))
    return found


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of each training text."""
    for part in parts:
        for first, last, raw, offsets in text_slices(part.column("body")):
            flat = buckets(raw, offsets)
            ids, at = np.concatenate([b for b, _ in flat]), np.concatenate([p for _, p in flat])
            row = np.searchsorted(offsets, at, "right") - 1
            keys, counts = np.unique((row.astype(np.int64) << BUCKET_BITS) | ids, return_counts=True)
            each = np.bincount(keys >> BUCKET_BITS, minlength=last - first)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").slice(first, last - first),
                    "y": part.column("y").slice(first, last - first),
                    "ids": lists((keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32), each, pa.int32()),
                    "counts": lists(counts.astype(np.int32), each, pa.int32()),
                }
            )


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket vectors, output matrix and bias by stochastic gradient descent over ``(ids, counts, label)``."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM))
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    share = [(ids, counts / max(1, counts.sum()), y) for ids, counts, y in rows]
    steps, done = max(1, EPOCHS * len(share)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(share)):
            ids, w, y = share[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = w @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = out @ g
            out -= rate * np.outer(hidden, g)
            bias -= 0.05 * rate * g
            vectors[ids] -= rate * w[:, None] * back
    return vectors, out, bias


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log odds of label 1, and the bias.

    Averaging and the output layer are linear, so a bucket's vector and the output matrix
    fold into one number a bucket. Fitted on at most ``PER_CLASS`` documents of each label;
    without labels of both kinds every score is 0.5.
    """
    sample = training_rows(docs, labels, "quality", FOLD, PER_CLASS).select("doc_id", "y", "body")
    counted = sample.mapInArrow(_counted, "doc_id long, y int, ids array<int>, counts array<int>").toArrow().sort_by("doc_id")
    rows = [
        (counted["ids"][i].values.to_numpy(), counted["counts"][i].values.to_numpy(), counted["y"][i].as_py()) for i in range(counted.num_rows)
    ]
    if len({y for *_, y in rows}) < 2:
        return np.zeros(1 << BUCKET_BITS), 0.0
    vectors, out, bias = fit(rows)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def score_of(text: str, odds: np.ndarray, bias: float) -> Column:
    """The score of a text column; only the text travels to Python, only the score comes back."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        found = [np.zeros(0)]
        for first, last, raw, offsets in text_slices(column):
            sums, counts = np.zeros(last - first), np.zeros(last - first)
            for ids, at in buckets(raw, offsets):
                run = np.concatenate([[0.0], np.cumsum(odds[ids])])
                edge = np.searchsorted(at, offsets)
                sums += np.diff(run[edge])
                counts += np.diff(edge)
            found.append(1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + bias, -500, 500))))
        return pa.array(np.concatenate(found))

    return score(body(text))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; a null doc_id counts as held out.

    ``score`` says how likely label 1 is, from 0 to 1. A null or empty text has no features
    and gets the score of the bias alone. Only the text is read for a score.
    """
    small_batches(docs.sparkSession)
    scored = docs.select("doc_id", score_of("text", *train(docs, labels)).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(FOLD[0]) == FOLD[1], F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns, in one pass over the texts.

    Without labels of both kinds outside the held-out fold no classifier can be fitted, and all rows stay.
    """
    small_batches(docs.sparkSession)
    odds, bias = train(docs, labels)
    release(docs.sparkSession)
    if not odds.any():
        return docs
    return docs.where(score_of("text", odds, bias) >= CUT)
