"""Near duplicates, repeated spans and decontamination against plain Python."""

import random

import pytest
from brute import contaminated, near_duplicates, removed
from pyspark.sql import functions as F

from annotlake.llm import decontamination, minhash, mixing, pii, repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stock=400):
    return [f"w{rng.randrange(stock)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, chains of edits, short, empty, null and very long texts."""
    rng = random.Random(2)
    out, base = [], prose(rng, 160)
    for k in range(14):
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    step = prose(rng, 120)
    for _ in range(8):
        out.append("\n".join(step))
        step = step[2:] + prose(rng, 2)
    out += [None, "", "  \t\n", "one two", "ONE two", "one  two", "one two three four five", "a b c d e f", "\x85 \x0b\x0c é", " ".join(prose(rng, 30_000))]
    out += [" ".join(prose(rng, 60)) for _ in range(10)]
    return list(enumerate(out, 10))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, rows, percent):
    got = minhash.near_duplicates(table(spark, rows), percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_duplicates(rows, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edge_rows(spark):
    docs = table(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")]).withColumn("n", F.lit(1)).withColumn("hi", F.lit("x"))
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    assert [r["doc_id"] for r in minhash.drop_near_duplicates(docs).collect()] == [1]
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_near_duplicate_rows_are_judged_by_their_text(spark):
    long = " ".join(f"w{k}" for k in range(200))
    near = long.replace("w7 ", "x ")
    rows = [(None, long), (None, long), (None, near), (5, "other words that stand here alone"), (5, long), (5, near), (4, "p q"), (4, "p q"), (4, "r s"), (None, None), (None, None), (9, ""), (9, "")]
    rows += [(None, "six words without any id here")] * 3 + [(k, "copy of one text many times over") for k in range(30, 60)]
    docs = table(spark, rows).withColumns({c: F.lit(1) for c in ("_gone", "row", "gone", "many", "id", "t1", "t2", "_id", "_t1", "_put", "_plan", "_repeats", "_hit")})
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect())
    (winner,) = [t for i, t in got if i == "5" and t in (long, near)]
    want = [("5", winner), ("5", "other words that stand here alone"), ("4", "p q"), ("4", "r s"), ("None", "None"), ("None", "None"), ("9", ""), ("9", "")]
    want += [("None", "six words without any id here"), ("30", "copy of one text many times over")]
    assert got == sorted(want)
    again = sorted((str(r["doc_id"]), str(r["text"])) for r in minhash.drop_near_duplicates(docs.repartition(5)).collect())
    assert again == got


def test_columns_of_any_name_pass_through(spark):
    names = ("_gone", "row", "gone", "many", "id", "t1", "t2", "_id", "_put", "_plan", "_repeats", "_hit", "place", "put", "n", "target", "whole", "body")
    docs = table(spark, [(k, f"Mrs Anna Smith wrote {k} {k + 1} {k + 2}") for k in range(8)]).withColumns({c: F.lit(c) for c in names})
    bench = spark.createDataFrame([(1, "wrote 3 4 5")], "item_id long, text string").withColumns({c: F.lit(c) for c in names})
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [0, 1, 2, 4, 5, 6, 7]
    made = pii.replace_entities(docs)
    assert made.columns == docs.columns and all("Smith" not in r["text"] and r["_put"] == "_put" and r["row"] == "row" for r in made.collect())
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "epoch"] and {r["_plan"] for r in mixed.collect()} == {"_plan"}


def test_members_without_room_leave_before_pairing(spark):
    """A group whose members mostly miss the threshold still gives every link."""
    rng = random.Random(7)
    base = prose(rng, 150, 10**6)
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = minhash.near_duplicates(table(spark, rows), 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_duplicates(rows, 85)


def test_estimate_follows_similarity(spark):
    rng = random.Random(3)
    a, b = prose(rng, 900, 10**6), prose(rng, 100, 10**6)
    docs = table(spark, [(1, " ".join(a)), (2, " ".join(a[:800] + b))])
    f = minhash.features(docs)
    x, y = f.where("doc_id = 1").alias("x"), f.where("doc_id = 2").alias("y")
    pair = x.join(y, F.col("x.doc_id") < F.col("y.doc_id")).select(minhash.estimate("x", "y").alias("e")).first()["e"]
    true = len(set(zip(a, a[1:])) & set(zip(a[:800], a[1:800]))) / 1000
    assert abs(pair - true) < 0.15


def test_repeated_spans(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    rows = [(1, base), (2, base[500:1200] + "zz" + base[1300:2000]), (3, "x" * 1000), (4, "y" * 400), (5, "y" * 401), (6, None), (7, "")]
    rows += [(8, base[:399]), (None, base[10:900]), (None, base[10:900]), (10, "ab" * 700), (11, "q" + base[2000:2400]), (12, "w" + base[2000:2400] + "w")]
    got = repeats.remove_repeats(table(spark, rows).withColumn("h", F.lit(1)).withColumn("body", F.lit(2)))
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", repeats.kept_digest()).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, removed(rows, 400)))
    assert repeats.remove_repeats(table(spark, rows).where("false")).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, " ".join(prose(rng, n, 5000))) for k, n in enumerate((20, 33, 60, 20, 7, 3))] + [(6, None), (7, ""), (8, "one two")]
    edited = items[2][1].split()
    edited[30] = "changed"
    rows = [
        (1, " ".join(prose(rng, 50) + items[0][1].split() + prose(rng, 40))),
        (2, items[1][1].upper()),
        (3, " ".join(prose(rng, 10) + edited + prose(rng, 10))),
        (4, " ".join(items[3][1].split()[:18])),
        (5, " ".join(prose(rng, 5) + items[4][1].split() + items[5][1].split())),
        (6, None), (7, ""), (8, "so one two"), (9, " ".join(prose(rng, 3000, 5000))), (10, items[0][1] + " " + items[0][1]),
        (11, " ".join(items[2][1].split()[:30])),
    ]
    docs = table(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = decontamination.benchmark_matches(docs, bench).collect()
    want = contaminated(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert sum(r["doc_id"] == 10 and r["item_id"] == 0 for r in got) == 2
    kept = {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert decontamination.benchmark_matches(docs, bench.where("false")).count() == 0
    assert decontamination.decontaminate(docs.where("false"), bench).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 30)
    rng = random.Random(9)
    items = [(k, " ".join(prose(rng, 20, 5000))) for k in range(6)]
    docs = table(spark, [(k, " ".join(prose(rng, 9) + t.split())) for k, t in items])
    got = decontamination.benchmark_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k, _ in items}


def test_codes_within_the_radius_share_a_block():
    import numpy as np

    rng = random.Random(1)
    ix = decontamination.Index([(1, " ".join(prose(rng, 20)).encode())])
    code = int(ix.codes[0])
    for _ in range(300):
        far = code
        for bit in rng.sample(range(64), decontamination.RADIUS):
            far ^= 1 << bit
        blocks = decontamination.block_values(np.array([far], np.uint64))[0]
        assert any(0 in ix.table.get((20, b, int(v)), ()) for b, v in enumerate(blocks))
