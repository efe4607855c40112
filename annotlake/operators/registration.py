"""Homography fits over keypoint pairs: heavy sums in Spark, only the 9 x 9 solve in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

H = tuple(f"h{i}" for i in range(9))


def hartley_stats(pairs: DataFrame) -> DataFrame:
    """Centroid and scale per registration and side; null scale when all points coincide."""
    centres = pairs.groupBy("registration_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias("c_" + c) for c in ("ref_x", "ref_y", "moving_x", "moving_y")],
    )
    spread = pairs.join(centres, "registration_id")

    def mean_distance(side: str) -> Column:
        return F.avg(
            F.hypot(F.col(f"{side}_x") - F.col(f"c_{side}_x"), F.col(f"{side}_y") - F.col(f"c_{side}_y"))
        ).alias(f"d_{side}")

    distances = spread.groupBy("registration_id").agg(mean_distance("ref"), mean_distance("moving"))
    scale = lambda d: F.when(F.col(d) >= 1e-12, F.sqrt(F.lit(2.0)) / F.col(d))
    return centres.join(distances, "registration_id").select(
        "registration_id", "n", "c_ref_x", "c_ref_y", scale("d_ref").alias("s_ref"),
        "c_moving_x", "c_moving_y", scale("d_moving").alias("s_moving"),
    )


def dlt_normal_matrix(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """The 45 distinct sums m<i><j> of the normal matrix, for fits with at least 4 pairs."""
    usable = stats.where((F.col("n") >= 4) & F.col("s_ref").isNotNull() & F.col("s_moving").isNotNull())
    x = F.col("s_moving") * (F.col("moving_x") - F.col("c_moving_x"))
    y = F.col("s_moving") * (F.col("moving_y") - F.col("c_moving_y"))
    u = F.col("s_ref") * (F.col("ref_x") - F.col("c_ref_x"))
    v = F.col("s_ref") * (F.col("ref_y") - F.col("c_ref_y"))
    norm = pairs.join(usable, "registration_id").select(
        "registration_id", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")
    )
    sums = []
    rows = dlt_rows(F.col("x"), F.col("y"), F.col("u"), F.col("v"))
    for i in range(9):
        for j in range(i, 9):
            terms = [a[i] * a[j] for a in rows if a[i] is not None and a[j] is not None]
            total = F.sum(sum(terms[1:], terms[0])) if terms else F.lit(0.0)
            sums.append(total.alias(f"m{i}{j}"))
    return norm.groupBy("registration_id").agg(*sums)


def dlt_rows(x: Column, y: Column, u: Column, v: Column) -> list[list[Column | None]]:
    """The two equation rows of a pair; None stands for 0."""
    one = F.lit(1.0)
    return [
        [None, None, None, -x, -y, -one, v * x, v * y, v],
        [x, y, one, None, None, None, -u * x, -u * y, -u],
    ]


UPPER = [(i, j) for i in range(9) for j in range(i, 9)]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest eigenvectors of a batch of normal matrices, brought back to pixel coordinates."""
    for batch in batches:
        k = len(batch)
        if k == 0:
            continue
        m = np.zeros((k, 9, 9))
        for i, j in UPPER:
            m[:, i, j] = m[:, j, i] = batch[f"m{i}{j}"].to_numpy()
        hn = np.linalg.eigh(m)[1][:, :, 0].reshape(k, 3, 3)

        def similarity(side: str) -> np.ndarray:
            s, cx, cy = (batch[c].to_numpy() for c in (f"s_{side}", f"c_{side}_x", f"c_{side}_y"))
            t = np.zeros((k, 3, 3))
            t[:, 0, 0] = t[:, 1, 1] = s
            t[:, 0, 2], t[:, 1, 2], t[:, 2, 2] = -s * cx, -s * cy, 1.0
            return t

        hd = (np.linalg.inv(similarity("ref")) @ hn @ similarity("moving")).reshape(k, 9)
        largest = hd[np.arange(k), np.abs(hd).argmax(axis=1)]
        scale = np.where(np.abs(hd[:, 8]) < 1e-12, largest, hd[:, 8])
        bad = ~np.isfinite(scale) | (np.abs(scale) < 1e-15)
        out = hd / np.where(bad, 1.0, scale)[:, None]
        out[bad] = np.nan
        frame = pd.DataFrame(out, columns=list(H))
        frame.insert(0, "registration_id", batch["registration_id"].to_numpy())
        yield frame[~bad]


def fit_homography(pairs: DataFrame) -> DataFrame:
    """Homography (h0..h8, moving to reference) of each registration that can be fitted.

    Registrations with under 4 pairs or coinciding points do not appear.
    """
    stats = hartley_stats(pairs)
    rows = dlt_normal_matrix(pairs, stats).join(stats, "registration_id")
    schema = "registration_id long, " + ", ".join(f"{h} double" for h in H)
    return rows.withColumn("registration_id", F.col("registration_id").cast("long")).mapInPandas(_solve, schema)


def parse_homography(registrations: DataFrame) -> DataFrame:
    """h0..h8 of stored registrations; absent (null or the text null) ones are left out."""
    parsed = registrations.where(F.col("homography").isNotNull() & (F.col("homography") != "null")).withColumn(
        "_h", F.from_json("homography", "array<double>")
    )
    return parsed.where(F.size("_h") == 9).select(
        F.col("id").alias("registration_id"), *[F.col("_h")[i].alias(h) for i, h in enumerate(H)]
    )


def apply_homography(points: DataFrame, matrices: DataFrame, x: str = "moving_x", y: str = "moving_y") -> DataFrame:
    """Add mapped_x, mapped_y; a point sent to infinity stays where it is."""
    a, b, c, d, e, f, g, h, i = (F.col(n) for n in H)
    px, py = F.col(x), F.col(y)
    w = g * px + h * py + i
    far = F.abs(w) < 1e-12
    safe = F.when(far, F.lit(1.0)).otherwise(w)
    return (
        points.join(matrices.select("registration_id", *H), "registration_id")
        .withColumn("mapped_x", F.when(far, px).otherwise((a * px + b * py + c) / safe))
        .withColumn("mapped_y", F.when(far, py).otherwise((d * px + e * py + f) / safe))
        .drop(*H)
    )


def invert_homography(matrices: DataFrame) -> DataFrame:
    """Cofactor inverse scaled by its last entry; singular matrices are left out."""
    a, b, c, d, e, f, g, h, i = (F.col(n) for n in H)
    adjugate = [
        e * i - f * h, c * h - b * i, b * f - c * e,
        f * g - d * i, a * i - c * g, c * d - a * f,
        d * h - e * g, b * g - a * h, a * e - b * d,
    ]
    det = a * adjugate[0] + b * adjugate[3] + c * adjugate[6]
    inverse = matrices.withColumn("_det", det).where(F.abs("_det") >= 1e-15)
    last = adjugate[8] / F.col("_det")
    scale = F.when(F.abs(last) > 1e-12, last).otherwise(F.lit(1.0))
    return inverse.withColumn("_s", scale).select(
        "registration_id", *[(v / F.col("_det") / F.col("_s")).alias(n) for v, n in zip(adjugate, H)]
    )


def residuals(pairs: DataFrame, matrices: DataFrame) -> DataFrame:
    """Distance of each mapped moving point to its reference point."""
    return apply_homography(pairs, matrices).withColumn(
        "error", F.hypot(F.col("mapped_x") - F.col("ref_x"), F.col("mapped_y") - F.col("ref_y"))
    )


def fit_residuals(registrations: DataFrame, pairs: DataFrame, matrices: DataFrame) -> DataFrame:
    """RMSE and largest error per registration with a matrix; zeros without pairs."""
    summary = residuals(pairs, matrices).groupBy("registration_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.max("error").alias("max_error"),
    )
    zero = F.lit(0.0)
    return (
        registrations.select(F.col("id").alias("registration_id"))
        .join(matrices.select("registration_id"), "registration_id", "left_semi")
        .join(summary, "registration_id", "left")
        .select(
            "registration_id",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("rmse", zero).alias("rmse"),
            F.coalesce("max_error", zero).alias("max_error"),
        )
    )


def fit_readiness(registrations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs a transform needs and whether they are there: 6 for tps, 4 otherwise."""
    counts = pairs.groupBy(F.col("registration_id").alias("id")).agg(F.count(F.lit(1)).alias("pairs"))
    needed = F.when(F.col("transform_type") == "tps", 6).otherwise(4)
    have = F.coalesce("pairs", F.lit(0))
    return registrations.join(counts, "id", "left").select(
        F.col("id").alias("registration_id"),
        "transform_type",
        have.alias("pairs"),
        needed.alias("needed"),
        (have >= needed).alias("can_fit"),
    )
