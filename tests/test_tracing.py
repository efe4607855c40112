import math
import random

import numpy as np
import pytest

from annotlake.operators import components as P
from annotlake.operators import skeleton as S
from annotlake.operators import superpixels as U

KEYS = ["frame_id", "label_id", "value", "component"]


# Five drawings whose centre lines are known.
def picture(w, h, cells):
    return ["".join("1" if (x, y) in cells else "." for x in range(w)) for y in range(h)]


BAR = picture(12, 7, {(x, y) for x in range(1, 11) for y in range(2, 5)})
STAIR = picture(24, 10, {(x, 3 + (x - 1) // 3) for x in range(1, 21)} | {(x, 3 + x // 3) for x in range(3, 21, 3)})
NUB = picture(18, 9, {(x, 5) for x in range(1, 16)} | {(8, 4)})
FIBRE = picture(60, 40, {(x, y) for x in range(4, 56) for y in range(40) if abs(y - (20 + 9 * math.sin(x / 9))) <= 3.5})
PLUS = picture(25, 25, {(x, 12) for x in range(1, 24)} | {(12, y) for y in range(1, 24)})


@pytest.fixture(scope="module")
def traced(spark, masks):
    words = S.thin_words(P.value_components(masks(BAR, STAIR, NUB, FIBRE, PLUS)), KEYS)
    return S.skeleton_paths(S.skeleton_nodes(words, KEYS), KEYS).collect()


def test_path_counts_and_spans(traced):
    paths = {}
    for r in traced:
        paths.setdefault(r["frame_id"], []).append([p["x"] for p in r["points"]])
    for frame, span in ((1, 5), (2, 15), (3, 12), (4, 15)):
        assert len(paths[frame]) == 1, (frame, paths[frame])
        assert max(paths[frame][0]) - min(paths[frame][0]) >= span
    assert len(paths[5]) >= 4


def thin(cells):
    """Plain two-step thinning on a set of pixels."""
    ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    while True:
        before = len(cells)
        for step in (0, 1):
            gone = set()
            for x, y in cells:
                p = [(x + a, y + b) in cells for a, b in ring]
                turns = sum(not p[i] and p[(i + 1) % 8] for i in range(8))
                n, e, s, w = p[0], p[2], p[4], p[6]
                stop = (n and e and s) or (e and s and w) if step == 0 else (n and e and w) or (n and s and w)
                if 2 <= sum(p) <= 6 and turns == 1 and not stop:
                    gone.add((x, y))
            cells = cells - gone
        if len(cells) == before:
            return cells


def test_thinning_against_plain_pixels(masks):
    rng = random.Random(5)
    # Wide enough to cross word ends at 62 and 124.
    noise = ["".join("1" if rng.random() < 0.8 else "." for _ in range(130)) for _ in range(20)]
    keys = ["frame_id", "label_id"]
    got = {(r["frame_id"], r["x"], r["y"]) for r in S.thin_components(masks(noise, FIBRE), keys).collect()}
    want = set()
    for i, pic in enumerate((noise, FIBRE), 1):
        cells = {(x, y) for y, line in enumerate(pic) for x, c in enumerate(line) if c == "1"}
        want |= {(i, x, y) for x, y in thin(cells)}
    assert got == want


def test_outline_of_a_square(masks):
    square = picture(8, 8, {(x, y) for x in range(1, 6) for y in range(2, 7)})
    hole = picture(8, 8, {(x, y) for x in range(1, 7) for y in range(1, 7)} - {(3, 3)})
    line = picture(8, 8, {(x, 2) for x in range(1, 6)})
    rings = {r["frame_id"]: {(p["x"], p["y"]) for p in r["points"]} for r in S.component_outlines(P.value_components(masks(square, hole, line)), KEYS).collect()}
    assert {(1, 2), (1, 6), (5, 6), (5, 2)} <= rings[1]
    assert {(1, 1), (1, 6), (6, 6), (6, 1)} <= rings[2]
    assert 3 not in rings


def test_outline_follows_the_border(masks):
    """Unsimplified borders hold exactly the pixels with a side on the outside, and neighbours touch."""
    rng = random.Random(8)
    blobs = []
    for _ in range(3):
        cells = {(6, 6)}
        while len(cells) < 60:
            x, y = rng.choice(sorted(cells))
            cells.add((x + rng.choice((-1, 0, 1)), y + rng.choice((-1, 0, 1))))
        cells = {(x, y) for x, y in cells if 0 <= x < 40 and 0 <= y < 40}
        blobs.append(cells)
    parts = P.value_components(masks(*[picture(40, 40, c) for c in blobs]))
    border = {}
    for r in S.component_borders(parts, KEYS).collect():
        border.setdefault(r["frame_id"], []).append((r["ord"], r["x"], r["y"]))
    for frame, cells in enumerate(blobs, 1):
        outside, stack = set(), [(-1, -1)]
        while stack:
            x, y = stack.pop()
            if (x, y) in outside or (x, y) in cells or not (-1 <= x <= 40 and -1 <= y <= 40):
                continue
            outside.add((x, y))
            stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        want = {(x, y) for x, y in cells if {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & outside}
        spots = [(x, y) for _, x, y in sorted(border[frame])]
        assert spots[0] == min(cells, key=lambda p: (p[1], p[0]))
        walked = set()
        for (x, y), (x2, y2) in zip(spots, [*spots[1:], spots[0]], strict=True):
            n = max(abs(x2 - x), abs(y2 - y))
            assert n <= 1 or x == x2 or y == y2
            walked |= {(x + (x2 - x) * i // max(n, 1), y + (y2 - y) * i // max(n, 1)) for i in range(n + 1)}
        assert walked == want


RINGS = picture(40, 16, {(x, y) for x in range(2, 14) for y in range(2, 14) if x in (2, 13) or y in (2, 13)})
TEE = picture(40, 30, {(x, 3) for x in range(2, 34)} | {(17, y) for y in range(3, 27)})


def test_rings_and_tees(masks):
    words = S.thin_words(P.value_components(masks(RINGS, TEE)), KEYS)
    got = S.skeleton_paths(S.skeleton_nodes(words, KEYS), KEYS).collect()
    ring = [r["points"] for r in got if r["frame_id"] == 1]
    assert len(ring) == 1 and ring[0][0] == ring[0][-1] and len(ring[0]) >= 5
    arms = [r["points"] for r in got if r["frame_id"] == 2]
    ends = sorted((p["x"], p["y"]) for line in arms for p in (line[0], line[-1]))
    assert len(arms) == 3 and len(set(ends)) == 4


def test_superpixels_of_plain_fields(spark, frames):
    """Four flat fields come back as themselves, numbered in raster order, covering every pixel once."""
    w, h, colours = 24, 24, [(250, 10, 10), (10, 250, 10), (10, 10, 250), (240, 240, 20)]
    rows = [(1, y, x, *colours[(y // 12) * 2 + x // 12]) for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(rows, "frame_id long, y long, x long, r int, g int, b int")
    got = {(r["y"], r["x"]): r["sp_id"] for r in U.slic_segments(pixels, frames((w, h)), 4).collect()}
    assert len(got) == w * h
    fields = {}
    for (y, x), k in got.items():
        fields.setdefault((y // 12) * 2 + x // 12, set()).add(k)
    assert [fields[i] for i in range(4)] == [{0}, {1}, {2}, {3}]


def test_superpixels_are_connected_and_not_small(spark, frames):
    rng = np.random.default_rng(1)
    w, h, target = 24, 18, 9
    rgb = np.clip(((np.add.outer(np.arange(h) // 6, np.arange(w) // 8) % 2) * 120 + 60)[..., None] + rng.integers(-12, 12, (h, w, 3)), 0, 255)
    rows = [(1, y, x, *map(int, rgb[y, x])) for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(rows, "frame_id long, y long, x long, r int, g int, b int")
    ids = np.full((h, w), -1)
    for r in U.slic_segments(pixels, frames((w, h)), target).collect():
        ids[r["y"], r["x"]] = r["sp_id"]
    assert (ids >= 0).all()
    firsts = [int(np.flatnonzero(ids.ravel() == k)[0]) for k in range(ids.max() + 1)]
    assert firsts == sorted(firsts)
    for k in range(ids.max() + 1):
        cells = set(zip(*np.nonzero(ids == k), strict=True))
        reached, stack = set(), [next(iter(cells))]
        while stack:
            y, x = stack.pop()
            if (y, x) in cells and (y, x) not in reached:
                reached.add((y, x))
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert reached == cells


def test_thinning_across_tiles(masks):
    """Shapes larger than a tile, against one whole-image pass after the other."""

    rng = random.Random(12)
    disk = ["".join("1" if (x - 95) ** 2 + (y - 90) ** 2 <= 85**2 else "." for x in range(200)) for y in range(180)]
    frame = ["1" * 190 if y < 25 or y >= 145 else "1" * 20 + "." * 140 + "1" * 30 for y in range(170)]
    noise = ["".join("1" if rng.random() < 0.93 else "." for _ in range(150)) for _ in range(140)]
    keys = ["frame_id", "label_id"]
    want = set()
    for k, picture in enumerate((disk, frame, noise, ["11", "11"], ["1" * 140]), 1):
        a = np.array([[c == "1" for c in line] for line in picture])
        a = np.pad(a, 1)
        while True:
            before = a
            for step in range(2):
                ring = [np.roll(a, (-dy, -dx), (0, 1)) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                count, turns = sum(r.astype(int) for r in ring), sum((~ring[i] & ring[(i + 1) % 8]).astype(int) for i in range(8))
                n, _, e, _, s, _, w, _ = ring
                blocked = (n & e & s) | (e & s & w) if step == 0 else (n & e & w) | (n & s & w)
                a = a & ~((count >= 2) & (count <= 6) & (turns == 1) & ~blocked)
            if (a == before).all():
                break
        want |= {(k, x - 1, y - 1) for y, x in zip(*np.nonzero(a), strict=True)}
    runs = masks(disk, frame, noise, ["11", "11"], ["1" * 140])
    got = {(r["frame_id"], r["x"], r["y"]) for r in S.thin_components(runs, keys).collect()}
    assert got == want


@pytest.fixture(scope="module")
def speckled(spark, masks):
    """Skeleton pixels of noise: rings, spurs, junctions side by side, lines of two pixels; one row comes twice."""
    rng = random.Random(21)
    noise = [["".join("1" if rng.random() < p else "." for _ in range(90)) for _ in range(40)] for p in (0.35, 0.5, 0.65, 0.8)]
    words = S.thin_words(P.value_components(masks(*noise, RINGS, TEE, PLUS, ["1"], ["11"])), KEYS)
    nodes = S.skeleton_nodes(words, KEYS).select(*KEYS, "y", "x").persist()
    return nodes.unionByName(nodes.limit(1))


def listed(df, *cols):
    return sorted((*(r[k] for k in KEYS), *(r[c] for c in cols), tuple((p["x"], p["y"]) for p in r["points"])) for r in df.collect())


def test_centre_lines_in_batches_are_those_of_joins(speckled):
    joins = listed(S.joined_lines(speckled, KEYS), "line")
    assert len(joins) > 100
    assert listed(S.small_lines(speckled, KEYS, S.MIN_SPUR, S.SKELETON_EPSILON), "line") == joins


def test_large_skeletons_go_by_joins(speckled, monkeypatch):
    """Any bound gives the same paths, and without large skeletons one copy is written, however many rounds there are."""
    written, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: written.append(1) or cut(df))
    paths = listed(S.skeleton_paths(speckled, KEYS), "path")
    assert len(written) == 1
    assert listed(S.skeleton_paths(speckled, KEYS, 30), "path") == paths
    assert len(written) > 1
