"""Points in polygons by the parity grid, and neighbours across partitions."""

import math
import random

from pyspark.sql import functions as F

from annotlake import schema
from annotlake.operators import catalog as C
from annotlake.operators import geometry as G
from annotlake.plans.numbering import number_with_neighbours


def node(x, y):
    return (float(x), float(y), float(x), float(y), float(x), float(y), False)


def inside(ring, px, py):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > py) != (y2 > py) and px < (x1 - x2) * (py - y2) / (y1 - y2) + x2:
            odd = not odd
    return odd


def rings():
    rng = random.Random(21)
    star = [(300 + (260 if k % 2 else 90) * math.cos(k / 25 * math.pi), 250 + (240 if k % 2 else 70) * math.sin(k / 25 * math.pi)) for k in range(50)]
    tangle = [(rng.randrange(-40, 600), rng.randrange(-40, 500)) for _ in range(60)]
    box = [(64, 64), (256, 64), (256, 192), (64, 192)]
    bow = [(10, 10), (500, 400), (500, 10), (10, 400)]
    small = [(100.5, 100.5), (103, 100.5), (103, 104), (100.5, 104)]
    return [star, tangle, box, bow, small, [(5, 5), (90, 5)], box + box[:1]]


def test_points_against_plain_counting(spark):
    rng = random.Random(5)
    shapes = spark.createDataFrame([(k, 1, 5, True, True, [node(*p) for p in r]) for k, r in enumerate(rings())], schema.SHAPES)
    shapes = shapes.unionByName(shapes.where("shape_id = 2").withColumn("frame_id", F.lit(2).cast("long")).withColumn("shape_id", F.lit(99).cast("long")))
    clicks = [(k, 1, rng.randrange(-50, 620) + rng.choice([0.0, 0.25, 0.5]), rng.randrange(-50, 520) + rng.choice([0.0, 0.25, 0.5])) for k in range(400)]
    clicks += [(1000 + k, 1, float(x), float(y)) for k, (x, y) in enumerate(p for r in rings() for p in r)]
    points = spark.createDataFrame(clicks, "point_id long, frame_id long, px double, py double")
    got = {(r["shape_id"], r["point_id"]) for r in G.point_in_polygon(shapes, points).collect()}
    assert got == {(k, i) for k, r in enumerate(rings()) for i, _, x, y in clicks if inside(r, x, y)}


def test_a_point_meets_the_edges_of_one_cell(spark):
    n = 4000
    ring = [(2000 + 1900 * math.cos(2 * math.pi * k / n), 2000 + 1900 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    shapes = spark.createDataFrame([(1, 1, 5, True, True, [node(*p) for p in ring])], schema.SHAPES)
    edges = G.outline_edges(shapes)
    cells = G.edge_cells(edges, 64)
    assert cells.groupBy("gx", "gy").count().agg(F.max("count")).first()[0] <= 200
    assert cells.count() <= 2 * n
    points = spark.createDataFrame([(k, 1, 20.0 * k, 2000.25) for k in range(200)], "point_id long, frame_id long, px double, py double")
    got = {r["point_id"] for r in G.point_in_polygon(shapes, points).collect()}
    assert got == {k for k in range(200) if abs(20.0 * k - 2000) < 1899.9}


def test_neighbours_across_partitions(spark):
    for rows, parts in ((997, 7), (1, 3), (0, 2), (3, 8)):
        df = spark.range(rows).select((F.col("id") * 7919 % 10007).alias("place"), (F.col("id") + 5).alias("frame_id")).repartition(parts)
        got = [tuple(r) for r in number_with_neighbours(df, ["place"], "frame_id", "position").orderBy("position").collect()]
        ids = [i for _, i in sorted((k * 7919 % 10007, k + 5) for k in range(rows))]
        assert [(r[2], r[1], r[3], r[4]) for r in got] == [
            (k + 1, i, ids[k - 1] if k else None, ids[k + 1] if k + 1 < rows else None) for k, i in enumerate(ids)
        ]


def test_frame_neighbours_shuffles_once(spark):
    sequences = spark.createDataFrame([(2, "b", 0), (1, "a", 1)], schema.SEQUENCES)
    frames = spark.createDataFrame([(10 + k, 1 + k % 2, k, "x", 1, 1, False) for k in range(5)], schema.FRAMES)
    out = C.frame_neighbours(sequences, frames).orderBy("position").collect()
    assert [(r["frame_id"], r["previous_id"], r["next_id"], r["is_first"], r["is_last"]) for r in out] == [
        (11, None, 13, True, False), (13, 11, 10, False, False), (10, 13, 12, False, False), (12, 10, 14, False, False), (14, 12, None, False, True),
    ]
