"""Toxicity: a convolutional text classifier over hashed word embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotlake.llm.common import body, lists, lower, sized_broadcast, small_batches, span_hashes, text_slices, word_spans
from annotlake.llm.labelled import known_labels, remainder, training_rows
from annotlake.plans.durable import cut

BUCKET_BITS = 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
PER_CLASS = 3000
EPOCHS = 8
RATE = 0.1
MIN_SHARE = 0.01
SIGMAS = 4.0
FOLD = (3, 1)
CUT = 0.7
BINS = 64
SEED = 5

PAD, RARE = 0, 1
_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_ids(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word (letters only, A-Z lowered), each text followed by pads; where each text begins."""
    raw = lower(raw)
    starts, ends, at = word_spans(raw, offsets, _GAP)
    ids = (span_hashes(raw, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    pads = max(WIDTHS)
    begin = at + pads * np.arange(len(at))
    out = np.zeros(begin[-1], np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[np.arange(len(ids)) + pads * row] = np.maximum(ids, RARE + 1)
    return out, begin


def _sequences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for first, last, raw, offsets in text_slices(part.column("body")):
            ids, begin = word_ids(raw, offsets)
            keep = [part.column(c).slice(first, last - first) for c in ("doc_id", "y")]
            yield pa.RecordBatch.from_arrays([*keep, lists(ids.astype(np.int32), np.diff(begin), pa.int32())], names=["doc_id", "y", "ids"])


class Network:
    """Embeddings, one bank of filters a width, max pooling over the text and a logistic output."""

    def __init__(self, rng: np.random.Generator):
        self.words = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
        self.words[PAD] = 0
        self.banks = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS]
        self.lift = [np.zeros(FILTERS) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS)
        self.bias = 0.0

    def forward(self, ids: np.ndarray, shift: np.ndarray):
        n = max(1, len(ids) - max(WIDTHS))
        x = self.words[ids]
        x[:, 0] += shift
        tops, peaks = [], []
        for w, bank, lift in zip(WIDTHS, self.banks, self.lift, strict=True):
            z = sum(x[j : j + n] @ bank[j] for j in range(w)) + lift
            peak = z.argmax(axis=0)
            peaks.append(peak)
            tops.append(z[peak, np.arange(FILTERS)])
        pooled = np.maximum(np.concatenate(tops), 0)
        return pooled, peaks, x

    def step(self, ids: np.ndarray, shift: np.ndarray, y: int, rate: float) -> None:
        """One descent step; ``shift`` is added to the first place of each word's embedding and isn't learned."""
        pooled, peaks, x = self.forward(ids, shift)
        g = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30))) - y
        back = g * self.out * (pooled > 0)
        self.out -= rate * g * pooled
        self.bias -= rate * g
        for k, (w, bank, peak) in enumerate(zip(WIDTHS, self.banks, peaks, strict=True)):
            gz = back[k * FILTERS : (k + 1) * FILTERS]
            on = np.flatnonzero(gz)
            if not len(on):
                continue
            self.lift[k][on] -= rate * gz[on]
            for j in range(w):
                at = peak[on] + j
                gx = bank[j][:, on].T * gz[on, None]
                bank[j][:, on] -= rate * (x[at] * gz[on, None]).T
                np.subtract.at(self.words, ids[at], rate * gx)
        self.words[PAD] = 0


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts of each label, how many hold each bucket; bucket ``PAD`` counts the texts."""
    seen = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for part in parts:
        y = part.column("y").to_numpy()
        for first, _, raw, offsets in text_slices(part.column("body")):
            ids, begin = word_ids(raw, offsets)
            for i in range(len(begin) - 1):
                seen[y[first + i], np.unique(ids[begin[i] : begin[i + 1]])] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(seen.ravel()[at], pa.int64())})


def texts_with_words(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Texts of each label outside the held-out fold that hold each bucket, over all labelled rows; bucket ``PAD`` has all texts."""
    known = cut(known_labels(labels, "toxic", FOLD))
    rows = docs.select("doc_id", body()).join(sized_broadcast(known), "doc_id").select("y", "body")
    got = rows.mapInArrow(_counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(2 << BUCKET_BITS)
    seen[got["at"].to_numpy()] = got["n"].to_numpy()
    return seen.reshape(2, -1)


def evidence(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """From 0 to 1, how far each word's texts lean to label 1: the signed root of the deviance over ``SIGMAS``."""
    clean, toxic = np.maximum(seen, 0)
    both, share = clean + toxic, n[1] / n.sum()
    part = lambda k, mean: k * np.log(np.maximum(k, 1) / np.maximum(mean, 1e-300))
    deviance = 2 * (part(toxic, both * share) + part(clean, both * (1 - share)))
    return np.where((toxic > both * share) & (both >= 2), np.clip(np.sqrt(np.maximum(deviance, 0)) / SIGMAS, 0, 1), 0.0)


def fit(rows: list[tuple[np.ndarray, int]], seen: np.ndarray) -> tuple[Network, np.ndarray, np.ndarray]:
    """The trained network, the map from buckets to learned embeddings, and what each bucket adds to the first place of its one.

    ``seen`` counts the texts of each label, the fitted ones among them, that hold each bucket.
    Words of at least ``MIN_SHARE`` of the texts, or clearly commoner in texts of label 1, learn an embedding
    each; its first place starts from how many standard errors a word is commoner there. The
    others share one that is learned and differ by their evidence, however rare they are.
    While a text is fitted its own count is left out of that evidence, so that texts can't be learned by heart.
    """
    n = seen[:, PAD]
    both = seen.sum(axis=0)
    share = both / n.sum()
    gap = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    telling = np.clip((gap - SIGMAS) / SIGMAS, 0, 1) * (seen[1] >= 2)
    firm = (both >= max(2.0, MIN_SHARE * n.sum())) | (telling > 0)
    known = np.where(firm, np.arange(1 << BUCKET_BITS), RARE)
    known[PAD] = PAD
    own = np.eye(2)[:, :, None]
    shift, *others = [np.where(known == RARE, evidence(s, n), 0.0) for s in (seen, seen - own[0], seen - own[1])]
    rng = np.random.default_rng(SEED)
    net = Network(rng)
    net.words[:, 0] = telling
    net.words[[PAD, RARE], 0] = 0
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, y = rows[i]
            net.step(known[ids], others[y][ids], y, RATE * (1 - done / steps))
            done += 1
    return net, known, shift


def thresholds(rows: DataFrame) -> DataFrame:
    """``lang, cut``: per language the cut with the best F1 over all of ``lang, score, y``, halfway to the next lower score.

    Languages that lack either label, and rows without a language, give none; of equal F1 the
    highest cut counts. Equal scores are counted together. Scores are laid into at most 3,600
    bins of log odds a language: sums over the bins lead to running sums inside each of them,
    so no language is ordered in one task.
    """
    score = F.round("score", 12)
    odds = F.log((score + F.lit(1e-12)) / (F.lit(1 + 1e-12) - score))
    counted = rows.where(F.col("lang").isNotNull()).groupBy("lang", score.alias("score"), F.floor(odds * F.lit(BINS)).alias("bin"))
    counted = cut(counted.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")))
    above = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("lang")
    bins = counted.groupBy("lang", "bin").agg(F.sum("n").alias("_n"), F.sum("hits").alias("_hits"))
    bins = cut(
        bins.select(
            "lang",
            "bin",
            F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("n_above"),
            F.coalesce(F.sum("_hits").over(above), F.lit(0)).alias("hits_above"),
            F.sum("_n").over(whole).alias("rows"),
            F.sum("_hits").over(whole).alias("toxic"),
        ).where("toxic > 0 and toxic < rows")
    )
    inside = Window.partitionBy("lang", "bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(bins, ["lang", "bin"]).select(
        "lang",
        "score",
        (F.lit(2) * (F.sum("hits").over(inside) + F.col("hits_above")) / (F.sum("n").over(inside) + F.col("n_above") + F.col("toxic"))).alias("f1"),
    )
    ranked = cut(ranked)
    best = cut(ranked.groupBy("lang").agg(F.max(F.struct("f1", "score"))["score"].alias("best")))
    lower = ranked.join(sized_broadcast(best), "lang").where(F.col("score") < F.col("best")).groupBy("lang").agg(F.max("score").alias("next"))
    return cut(best.join(lower, "lang", "left").select("lang", F.coalesce((F.col("best") + F.col("next")) / 2, F.col("best") - F.lit(1e-9)).alias("cut")))


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[list[np.ndarray]], list[np.ndarray], np.ndarray, float]:
    """Per width and place in it the filters' answer to every bucket, their offsets, output weights and bias.

    Fitted on at most ``PER_CLASS`` documents of each label, words judged by all labelled ones outside the held-out fold; without labels of both kinds
    every score is 0.5.
    """
    sample = training_rows(docs, labels, "toxic", FOLD, PER_CLASS).select("doc_id", "y", "body")
    got = sample.mapInArrow(_sequences, "doc_id long, y int, ids array<int>").toArrow().sort_by("doc_id")
    ids = [got["ids"][i].values.to_numpy().astype(np.int64) for i in range(got.num_rows)]
    y = got["y"].to_pylist()
    if len(set(y)) < 2:
        net, known, shift = Network(np.random.default_rng(SEED)), np.zeros(1 << BUCKET_BITS, np.int64), 0.0
        net.out[:] = 0
    else:
        net, known, shift = fit(list(zip(ids, y, strict=True)), texts_with_words(docs, labels))
    words = net.words[known]
    words[:, 0] += shift
    answers = [[(words @ bank[j]).astype(np.float32) for j in range(len(bank))] for bank in net.banks]
    return answers, net.lift, net.out, net.bias


def score_of(text: str, answers: list[list[np.ndarray]], lift: list[np.ndarray], out: np.ndarray, bias: float) -> Column:
    """The score of a text column; only the text travels to Python, only the score comes back."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        found = [np.zeros(0)]
        for _, _, raw, offsets in text_slices(column, 1 << 18):
            ids, begin = word_ids(raw, offsets)
            n = max(1, len(ids) - max(WIDTHS) + 1)
            pooled = []
            for bank, up in zip(answers, lift, strict=True):
                z = bank[0][ids[:n]]
                for j in range(1, len(bank)):
                    z += bank[j][ids[j : j + n]]
                # windows that start in the pads of a text see only pads or the next text; stop before them
                z = np.concatenate([z, np.zeros((len(ids) - n, FILTERS), np.float32)])
                edges = np.stack([begin[:-1], np.maximum(begin[1:] - max(WIDTHS), begin[:-1] + 1)], 1).ravel()
                pooled.append(np.maximum.reduceat(z, edges, axis=0)[::2] + up)
            logit = np.maximum(np.concatenate(pooled, axis=1), 0) @ out + bias
            found.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
        return pa.array(np.concatenate(found))

    return score(body(text))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, flagged`` for every row of ``docs``.

    ``score`` (0 to 1) sees the text alone; ``predicted`` cuts it at 0.7, ``flagged`` at the
    threshold of the row's language, calibrated on all its labelled rows outside the held-out
    fold, 0.7 for a null language and one without both labels there. A null or
    empty text is scored as pads alone. A null doc_id counts as held out.
    """
    small_batches(docs.sparkSession)
    net = train(docs, labels)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = cut(docs.select("doc_id", lang.alias("lang"), score_of("text", *net).alias("score")))
    known = cut(known_labels(labels, "toxic", FOLD))
    cuts = thresholds(rows.join(sized_broadcast(known), "doc_id").select("lang", "score", "y")).withColumnRenamed("lang", "_lang")
    rows = rows.join(sized_broadcast(cuts), F.col("lang") == F.col("_lang"), "left")
    threshold = F.coalesce("cut", F.lit(CUT))
    return rows.select(
        "doc_id",
        F.coalesce(remainder(FOLD[0]) == FOLD[1], F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("flagged"),
    )
