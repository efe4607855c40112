"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and an exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.llm.common import lists, mix
from annotlake.plans.durable import cut
from annotlake.plans.graph import star_components

BITS = 64
BLOCKS = 4
RADIUS = 4 * 2 + 3  # a pair this close lies within 2 in one of the blocks, and both sides probe within 1
SAMPLE = 10_000
ROUNDS = 40
SEED = 3


def usable(vector: str) -> Column:
    """Whether a vector has a direction: no null, no component that is null or not finite, not all zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_rotation(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of iterative quantisation: principal directions, then the rotation that brings them nearest to signs."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[: min(bits, x.shape[1])].T
    low = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(SEED).normal(size=(axes.shape[1], axes.shape[1])))
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    return mean, axes @ turn


def train(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A rotation for each vector length, each fitted on at most ``sample`` vectors in the order of a hash."""
    models = {}
    for (dim,) in vectors.select("dim").distinct().collect():
        rows = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("id", "label"), "id", "label").limit(sample).select("v").toArrow()
        x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        models[dim] = fit_rotation(_unit(x))
    return models


def _coder(models: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Binary code of each vector and the keys under which it is filed: every block, and every block with one bit turned."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for first in range(0, whole.num_rows, 2048):
                part = whole.slice(first, 2048)
                dims = part.column("dim").to_numpy()
                codes, keys = np.zeros(len(dims), np.uint64), [None] * len(dims)
                ends = np.concatenate([[0], np.cumsum(dims)])
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    mean, turn = models[int(dim)]
                    x = _unit(flat[ends[at][:, None] + np.arange(dim)])
                    signs = (x - mean) @ turn >= 0
                    n = signs.shape[1]
                    weights = np.uint64(1) << np.arange(n, dtype=np.uint64)
                    codes[at] = (signs * weights).sum(axis=1, dtype=np.uint64)
                    edges = np.linspace(0, n, BLOCKS + 1).astype(int)
                    found = []
                    for b in range(BLOCKS):
                        width = int(edges[b + 1] - edges[b])
                        value = codes[at] >> np.uint64(edges[b]) & np.uint64((1 << width) - 1)
                        turned = value[:, None] ^ np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(width, dtype=np.uint64)])[None, :]
                        found.append(mix(turned + (np.uint64(b + 1) << np.uint64(40)) + (np.uint64(dim) << np.uint64(48))))
                    for i, row in zip(at, np.concatenate(found, axis=1), strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id"),
                        "label": part.column("label"),
                        "code": codes.view(np.int64),
                        "keys": lists(np.concatenate(keys).view(np.int64), [len(k) for k in keys]),
                    }
                )

    return batches


def _cosines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        a, b = (part.column(c) for c in ("va", "vb"))
        ends = np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (a, b))
        sums = lambda z: np.add.reduceat(z, ends[:-1]) if len(ends) > 1 else np.zeros(0)
        cosine = sums(x * y) / (np.sqrt(sums(x * x)) * np.sqrt(sums(y * y)))
        yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "cosine": pa.array(cosine)})


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label, not null, and of one length are linked when the cosine of their
    angle, in double precision, is at least ``least``. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest vec_id that links reach.

    Equal vectors are folded into one class first. Each class gets a code of the signs of a
    learned rotation and is filed under every block of the code and every block with one bit
    turned; any two codes within ``RADIUS`` meet under one key. The original vectors of pairs
    that are that close decide.

    Vectors that are null, zero or hold null or non-finite components, and rows without label
    or vec_id, link with nothing: no links, own component, kept. An empty table gives an
    empty result.
    """
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), wide.alias("v"))
    fit = usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("fit", fit).withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(1), "v", "label"))
    classes = cut(
        rows.where("fit")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("id", F.col("h1"))
    )
    coded = classes.select("id", "label", "dim", "v").mapInArrow(_coder(train(classes)), "id long, label long, code long, keys array<long>")
    filed = cut(coded.select("id", "label", "code", F.explode("keys").alias("key")))
    other = filed.select(F.col("id").alias("b"), F.col("label"), F.col("code").alias("other"), "key")
    close = F.bit_count(F.col("code").bitwiseXOR(F.col("other"))) <= RADIUS
    pairs = cut(filed.join(other, ["key", "label"]).where((F.col("id") < F.col("b")) & close).select(F.col("id").alias("a"), "b").distinct())
    left = classes.select(F.col("id").alias("a"), F.col("v").alias("va"))
    right = classes.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    met = pairs.join(left, "a").join(right, "b").where(F.size("va") == F.size("vb")).select("a", "b", "va", "vb")
    links = cut(met.mapInArrow(_cosines, "a long, b long, cosine double").where(F.col("cosine") >= least).select("a", "b"))
    roots = star_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), [])
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("id").alias("b"), F.col("n").alias("m"))
    outside = both.join(sizes, "b").groupBy(F.col("a").alias("id")).agg(F.sum("m").alias("outside"))
    linked = cut(
        classes.select("h1", "h2", "id", "n", "least")
        .join(outside, "id", "left")
        .join(roots.withColumnRenamed("u", "id"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    named = cut(linked.groupBy("root").agg(F.min("least").alias("component")))
    result = linked.join(named, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "component")
    out = rows.select("vec_id", F.when(F.col("fit"), F.col("h1")).alias("h1"), "h2").join(result, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
