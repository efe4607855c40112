"""Lloyd clustering of whole-number vectors in JVM expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.plans.durable import cut

CLUSTERS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED = 2
LARGEST = 1 << 26  # components are held within this, so that sums over up to 256 components fit 64 bits

Centroids = list[list[int]]


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, v, square``: floor(scale * component) of the vectors that have exactly ``dims`` finite components, and the sum of squares."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    most = F.lit(float(LARGEST))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * F.lit(float(scale)), most), -most)))
    return vectors.where((F.size(x) == dims) & finite).select(F.col(key), whole.alias("v")).withColumn("square", _dot(F.col("v"), F.col("v")))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED, key: str = "vec_id") -> Centroids:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:key``, in ascending hash order; at most ``k`` rows reach the driver."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return [list(r["v"]) for r in rows.orderBy(place.asc_nulls_last(), "v").select("v").limit(k).collect()]


def _literal(centroids: Centroids) -> Column:
    """The centroids and the squares of their lengths as one literal, which the optimizer folds from JSON: a call for every component would take longer than the job."""
    rows = [{"square": sum(x * x for x in c), "c": c} for c in centroids]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<square: bigint, c: array<bigint>>>")


def _dot(a: Column, b: Column) -> Column:
    """Sum of the products of two arrays of whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, p: s + p)


def nearest(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """``rows`` with ``best``, the struct (distance, cluster) of the nearest centroid; of equally near ones the smaller number.

    The squared distance of x and c is |x|^2 + |c|^2 - 2 x.c: one product and one sum a component.
    """
    distance = lambda c: F.col("square") + c["square"] - F.lit(2).cast("long") * _dot(F.col("v"), c["c"])
    each = F.transform(_literal(centroids), lambda c, j: F.struct(distance(c).alias("distance"), j.alias("cluster")))
    return rows.withColumn("best", F.array_min(each))


def moved(rows: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round: the floor of each cluster's mean, empty ones where they were.

    Sums of columns, combined before the shuffle; what reaches the driver is one row a cluster.
    """
    sums = F.expr("array(%s)" % ", ".join(f"sum(v[{i}])" for i in range(len(centroids[0]))))
    found = nearest(rows, centroids).groupBy(F.col("best.cluster").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), sums.alias("sums"))
    out = list(centroids)
    for r in found.collect():
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def fit(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, key: str = "vec_id") -> Centroids:
    centroids = first_centroids(rows, k, seed, key)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    return centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    seed: int = SEED,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; the others have no
    row. Each is turned into whole numbers, floor(scale * component), so that every sum is exact
    and reruns agree; numbers beyond 2^26 in size are held there. All rounds read all vectors: a
    round's only shuffle is one row of sums a cluster and task, and only the ``k`` centroids pass
    through the driver.

    Equal vectors are rows of their own and may be centroids several times, whereupon the one
    with the smaller number takes all of theirs. Rows that share a key start in the order of their
    components; null keys come last. With fewer than ``k`` kept vectors there are as many
    centroids; without any the result is empty. Other columns are not read.
    """
    rows = whole_vectors(vectors, dims, scale, key, vector)
    centroids = fit(rows, k, rounds, seed, key)
    kind = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        none = vectors.sparkSession.createDataFrame([], kind)
        empty = rows.where(F.lit(False)).select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.join(F.broadcast(none), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    placed = cut(nearest(rows, centroids).select(key, F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance")))
    spent = {r["cluster"]: int(r["spent"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("spent")).collect()}
    held = [(j, n, sum(spent.values()), digest(centroids[j])) for j, n in spent.items()]
    known = vectors.sparkSession.createDataFrame(held, kind)
    return placed.join(F.broadcast(known), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
