"""Repetition rules against counting in plain Python."""

import collections
import random

import numpy as np
from brute import SPACES

from annotlake.llm import repetition

DOCS = "doc_id long, text string, rules string, n_words int, kept boolean"


def covered(w, width):
    windows = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    times = collections.Counter(windows)
    return {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(width)}


def brute(text, most=repetition.MOST_IN_NGRAMS):
    text = text or ""
    w = SPACES.findall(text)
    lines = [x for x in text.split("\n") if SPACES.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = sum(map(len, w))
    inside = [sum(len(w[i]) for i in covered(w, n)) for n in most]
    in_lines = sum(len("".join(SPACES.findall(x))) for x in again)
    repeated = len(covered(w, 3))
    failed = len(w) < 50 or 100 * repeated > 50 * len(w)
    kept = not failed and 100 * in_lines <= 20 * chars and all(100 * x <= p * chars for x, p in zip(inside, most.values(), strict=True))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(w), chars, symbols, len(lines), len(again), in_lines, repeated, inside, failed, kept)


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "\n", "\n\n", "a", "a a a", "é# €%\t𝄞\x0bz", "x\r\nx\r\nx", "x \nx\nx ", "b\n\nb\n", "\x1c \xa0 y", "a b c " * 40, "w" * 5000]
    for size in (3, 40, 60, 200, 900):
        for names in (2, 5, 30, 4000):
            out.append("".join(f"{rng.randrange(names)}é" + rng.choice([" ", " ", "\n", "\t\n", "  "]) for _ in range(size)))
    line = " ".join(f"q{k}" for k in range(12))
    body = " ".join(f"u{k}" for k in range(200))
    return [*out, *out[-3:], f"{line}\n{body}\n{line}", f"{line}\n" * 6 + body, body + " " + body, body + f" {line} {line}"]


def test_counts_and_verdicts(spark):
    rows = [(i if i % 5 else None, t, "r", 1, False) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    out = repetition.with_rules(docs, "Rules")
    assert out.columns == ["doc_id", "text", "n_words", "kept", "Rules"]
    for r in out.collect():
        assert tuple(r["Rules"]) == brute(r["text"]), (r["text"] or "")[:80]
    kept = repetition.drop_repetitive(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.select("text").collect())) == sorted(f"Row(text={t!r})" for t in texts() if brute(t)[-1])
    assert repetition.drop_repetitive(docs.where("false")).count() == repetition.with_rules(docs.where("false"), "x").count() == 0


def test_other_lengths(spark):
    docs = spark.createDataFrame([(1, t, "r", 1, False) for t in texts()], DOCS)
    most = {2: 50, 12: 10}
    for r in repetition.with_rules(docs, "m", most).collect():
        assert tuple(r["m"]) == brute(r["text"], most)


def test_long_text():
    text = " ".join(f"t{k % 90000}" for k in range(150_000)) + "\nend\nend"
    raw = np.frombuffer(text.encode(), np.uint8)
    m = repetition.measure(raw, np.array([0, len(raw)]), [5])
    assert m["n_words"][0] == 150_002 and m["n_dup_lines"][0] == 1 and m["n_repeat_words"][0] == 120_000


def test_windows_that_share_a_hash_are_told_apart():
    names = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    first = np.arange(7)
    got = repetition._found_twice(names, np.zeros(9, np.int64), first, 3, np.zeros(7, np.uint64))
    assert got.tolist() == [True, False, False, False, False, False, True]
    apart = repetition._found_twice(names, np.array([0] * 5 + [1] * 4), np.array([0, 6]), 3, np.zeros(2, np.uint64))
    assert not apart.any()
