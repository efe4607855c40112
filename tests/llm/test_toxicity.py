"""Language thresholds of the toxicity classifier against plain Python."""

import random
import zlib

import numpy as np
import pytest

from annotlake.llm import toxicity


def best_cut(rows):
    """Highest of the cuts with the best F1, halfway to the next lower score."""
    scores = sorted({s for s, _ in rows}, reverse=True)
    f1 = [2 * sum(y for s, y in rows if s >= c) / (sum(s >= c for s, _ in rows) + sum(y for _, y in rows)) for c in scores]
    k = f1.index(max(f1))
    return (scores[k] + scores[k + 1]) / 2 if k + 1 < len(scores) else scores[k]


def test_thresholds_of_many_languages(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        for i in range(12):
            y = int(rng.random() < 0.4) if i > 1 else i
            rows.append((f"l{k:03}", min(1.0, max(0.0, round(rng.gauss(0.3 + 0.3 * y, 0.2), 2))), y))
    rows += [("one", 0.4, 1), ("one", 0.5, 1), ("none", 0.4, 0), (None, 0.4, 0), (None, 0.8, 1), ("end", 0.0, 0), ("end", 1.0, 1)]
    got = {r["lang"]: r["cut"] for r in toxicity.thresholds(spark.createDataFrame(rows, "lang string, score double, y int")).collect()}
    want = {c: best_cut([(s, y) for x, s, y in rows if x == c]) for c in {x for x, *_ in rows} - {None, "one", "none"}}
    assert got == pytest.approx(want, abs=1e-8) and len(got) == 301


def test_thresholds_use_rows_outside_the_sample(spark, monkeypatch):
    """Labelled documents beyond the bound of the fit still calibrate their language."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 20)
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices("abcdefgh", k=20)) + (" vile" if k % 2 else ""), f"l{k % 40}") for k in range(1200)]
    labels = spark.createDataFrame([(k, k % 2 if k % 40 < 20 else (k // 40) % 2) for k, *_ in docs], "doc_id long, toxic int")
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = toxicity.toxicity_scores(table, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    lang = {k: c for k, _, c in docs}
    by = {}
    for r in got:
        if not r["held_out"]:
            by.setdefault(lang[r["doc_id"]], []).append((r["score"], truth[r["doc_id"]]))
    cuts = {lang[r["doc_id"]]: r["threshold"] for r in got}
    both = {c for c, rows in by.items() if len({y for _, y in rows}) == 2}
    assert len(both) >= 18
    for c, rows in by.items():
        flat = [(round(s, 12), y) for s, y in rows]
        assert cuts[c] == pytest.approx(best_cut(flat) if c in both else 0.7, abs=1e-8)
    assert all(r["flagged"] == (r["score"] >= r["threshold"]) for r in got)


def test_rare_words_tell_labels_apart():
    """Every toxic word occurs in ten texts of 1,200, as does every word of the clean texts' own."""
    rng = np.random.default_rng(1)

    def text(word):
        w = rng.integers(2, 402, rng.integers(20, 80))
        w[rng.integers(len(w))] = word
        return np.concatenate([w, [0, 0, 0]])

    make = lambda n: [(text((1000, 5000)[k % 2] + k // 2 % 60), 1 - k % 2) for k in range(n)]
    rows, fresh = make(1200), make(400)
    seen = np.zeros((2, 1 << toxicity.BUCKET_BITS))
    for ids, y in rows:
        seen[y, np.unique(ids)] += 1
    net, known, shift = toxicity.fit(rows, seen)
    right = 0
    for ids, y in fresh:
        pooled, *_ = net.forward(known[ids], shift[ids])
        right += (pooled @ net.out + net.bias >= 0) == y
    assert right >= 0.97 * len(fresh)


def test_words_are_counted_over_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_CLASS", 5)
    docs = spark.createDataFrame([(k, "vile word word" if k % 2 else "word") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(280)], "doc_id long, toxic int")
    seen = toxicity.texts_with_words(docs, labels)
    fit = [k for k in range(280) if zlib.crc32(str(k).encode()) % 3 != 1]
    odd = sum(k % 2 for k in fit)
    vile, word = (toxicity.word_ids(np.frombuffer(w, np.uint8), np.array([0, 4]))[0][0] for w in (b"vile", b"word"))
    assert seen[:, vile].tolist() == [0, odd]
    assert seen[:, word].tolist() == seen[:, toxicity.PAD].tolist() == [len(fit) - odd, odd]
