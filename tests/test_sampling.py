"""Sampling of free space over small tiles against one map at a time."""

import numpy as np
import pytest

from waymark.operators import sampling, shapes
from waymark.operators.kernels import Graph, sample_free


def cells(spark, maps):
    return spark.createDataFrame([(m, r, c, bool(v)) for m, f in maps.items() for (r, c), v in np.ndenumerate(f)], "map_id long, row int, col int, free boolean")


def test_samples(spark):
    rng = np.random.default_rng(6)
    rooms = np.ones((30, 37), bool)
    rooms[10, :30] = rooms[:20, 18] = False
    wide = np.ones((25, 25), bool)
    wide[0, 0] = False
    maps = {0: rng.random((33, 29)) > 0.02, 1: rooms, 2: np.zeros((5, 5), bool), 3: wide, 4: np.ones((9, 14), bool), 5: rng.random((12, 40)) > 0.01}
    before = {0: [(3, 3), (20, 20)], 1: [(5, 5)], 5: [(6, 20)]}
    nodes = spark.createDataFrame([(m, *p) for m, ps in before.items() for p in ps], "map_id long, row int, col int")
    rows = sampling.sampled(cells(spark, maps), 4, 8, nodes).collect()
    for m, free in maps.items():
        g = Graph()
        for p in before.get(m, []):
            g.node(p)
        sample_free(g, free, 4)
        got = sorted((r["node_id"], r["row"], r["col"]) for r in rows if r["map_id"] == m)
        assert got == [(i, *p) for i, p in enumerate(list(g.nodes)[len(before.get(m, [])) :])], m


@pytest.mark.parametrize(("k", "size"), [(2, 5), (0, 4)])
def test_first_in_box(spark, k, size):
    rng = np.random.default_rng(3)
    maps = {0: rng.random((23, 31)) > 0.4, 1: np.ones((14, 9), bool), 2: np.zeros((4, 4), bool), 3: rng.random((40, 6)) > 0.9}
    rows = sampling.first_in_box(shapes.packed(cells(spark, maps), size), k, size).collect()
    for m, open_ in maps.items():
        want = []
        for r, c in np.argwhere(open_).tolist():
            if not any(abs(r - a) <= k and abs(c - b) <= k for a, b in want):
                want.append((r, c))
        assert sorted((r["row"], r["col"]) for r in rows if r["map_id"] == m) == want, m


def test_a_box_wider_than_a_tile(spark):
    with pytest.raises(ValueError, match="wider"):
        sampling.first_in_box(shapes.packed(cells(spark, {0: np.ones((3, 3), bool)}), 4), 3, 4)
