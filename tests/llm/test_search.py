"""Ranked search against scoring every document in plain Python."""

import collections
import math
import random
import re

import pytest

from annotlake.llm import search

DOCS = "doc_id long, text string, item long, score long, block int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    N, L = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    wanted = collections.defaultdict(list)
    for i, t in items:
        wanted[i] += terms(t)
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c, n in held:
            m = 100 - 75 + 75 * n * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")


def corpus(n, seed=4):
    rng = random.Random(seed)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}é" for k in range(400)]
    word = lambda: rng.choice(common if rng.random() < 0.7 else rare)
    docs = [(k, " ".join(word() for _ in range(rng.randrange(1, 60)))) for k in range(n)]
    docs += [(k, docs[0][1]) for k in (7, 7, 9000, None, None)]
    docs += [(9001, None), (9002, ""), (9003, " .,; "), (9004, "C1,r5É c1\x7fC2 日本 𝄞 ²"), (9005, "c3 " * 3000)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 20)))) for k in range(25)]
    items += [(3, "r1é"), (None, "c1 r2é C1"), (50, None), (51, "..."), (52, "nowhere"), (53, "日本 𝄞 ²"), (54, "c3 c3 c3"), (55, items[0][1])]
    return docs, items


@pytest.mark.parametrize("parts", [1, 6])
def test_ranks(spark, parts):
    docs, items = corpus(700)
    a, b = tables(spark, docs, items)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        got = [tuple(r) for r in search.ranked_documents(a.repartition(parts), b).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ITEMS", 9)
    docs, items = corpus(80, 9)
    got = [tuple(r) for r in search.ranked_documents(*tables(spark, docs, items)).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_a_term_of_every_document_and_empty_tables(spark):
    docs, items = [(k, "same") for k in range(30)], [(1, "same"), (2, "other")]
    a, b = tables(spark, docs, items)
    got = [tuple(r) for r in search.ranked_documents(a, b).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    for x, y in ((a.where("false"), b), (a, b.where("false")), (a.withColumn("text", a["text"].substr(1, 0)), b)):
        assert search.ranked_documents(x, y).collect() == []
