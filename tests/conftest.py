import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from annotlake.session import build_session

    return build_session("8", "tests")


@pytest.fixture(scope="session")
def masks(spark):
    """Rows of text ('.' background, a digit the value) to mask runs of frame 1, label 1."""
    from annotlake import schema

    def make(*pictures):
        rows = []
        for frame, picture in enumerate(pictures, 1):
            for y, line in enumerate(picture):
                x = 0
                while x < len(line):
                    e = x
                    while e < len(line) and line[e] == line[x]:
                        e += 1
                    if line[x] != ".":
                        rows.append((frame, 1, int(line[x]), y, x, e))
                    x = e
        return spark.createDataFrame(rows, schema.MASK_RUNS)

    return make


@pytest.fixture(scope="session")
def frames(spark):
    from annotlake import schema

    def make(*sizes):
        rows = [(i, 1, i, f"f{i}.png", w, h, False) for i, (w, h) in enumerate(sizes, 1)]
        return spark.createDataFrame(rows, schema.FRAMES)

    return make
