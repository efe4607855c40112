"""Lloyd rounds against plain Python."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from annotlake.llm import clustering

KIND = "vec_id long, embedding array<float>, label int, best string, cluster string, v int"


def single(x):
    return F.lit(x).cast("float")


def brute(rows, k, rounds, dims, scale=256, seed=2):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *place(v)) for i, v in kept]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), digest(j)) for i, d, j in found], key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_rounds_match_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.randrange(-64, 64) / 128 for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (400, rows[1][1]), (None, rows[2][1]), (-3, [0.0, -0.0, 0.5, -0.5])]
    rows += [(500, None), (501, []), (502, [1.0] * 3), (503, [1.0] * 5), (504, [1.0, None, 1.0, 1.0]), (505, [float("nan"), 1.0, 1.0, 1.0]), (506, [float("-inf"), 1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 1, "b", "c", 0) for i, v in rows], KIND)
    for k, rounds in ((6, 5), (1, 2), (400, 1)):
        got = rows_of(clustering.cluster_vectors(vectors, k=k, rounds=rounds, dims=4))
        assert got == brute(rows, k, rounds, 4), (k, rounds)
    again = clustering.cluster_vectors(vectors.repartition(5), k=6, dims=4)
    assert rows_of(again) == brute(rows, 6, 5, 4)


def test_equal_vectors_and_empty_clusters(spark):
    rows = [(i, [0.25] * 3) for i in range(20)] + [(30, [1.0] * 3)]
    vectors = spark.createDataFrame([(i, v, 1, "b", "c", 0) for i, v in rows], KIND)
    got = rows_of(clustering.cluster_vectors(vectors, k=8, rounds=3, dims=3))
    assert got == brute(rows, 8, 3, 3) and len({r[1] for r in got}) <= 2


def test_none_kept_and_huge_components(spark):
    vectors = spark.createDataFrame([(1, [1.0], 1, "b", "c", 0)], KIND)
    for df in (vectors, vectors.where("false")):
        out = clustering.cluster_vectors(df)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 64, 1, "b", "c", 0) for i in range(4)], KIND)
    out = clustering.cluster_vectors(huge, k=1, rounds=1).collect()
    assert len(out) == 4 and out[0]["inertia"] == sum(r["distance"] for r in out) == 4 * 64 * clustering.LARGEST**2


def test_one_row_a_cluster_reaches_the_driver(spark):
    rows = clustering.whole_vectors(spark.range(100).selectExpr("id as vec_id", "array_repeat(cast(id as float), 64) as embedding"))
    plan = clustering.nearest(rows, clustering.first_centroids(rows, 3))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
