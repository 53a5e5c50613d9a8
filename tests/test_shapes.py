"""Thinning, branches, rings and simplification over small tiles against the one-map kernels."""

import numpy as np
import pytest

from waymark.operators import shapes
from waymark.operators.kernels import branches, contours, simplify, thin


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(11)
    rooms = np.zeros((37, 45), bool)
    rooms[2:16, 3:20] = rooms[20:35, 3:42] = rooms[2:16, 24:42] = True
    rooms[8:10, 20:24] = rooms[16:20, 10:13] = rooms[16:20, 30:33] = True
    rooms[24:30, 15:22] = False
    ring = np.zeros((20, 21), bool)
    ring[2, 3:17] = ring[16, 3:17] = ring[3:16, 2] = ring[3:16, 17] = True  # a closed loop without an end
    return {0: rng.random((23, 31)) > 0.3, 1: rng.random((9, 8)) > 0.5, 2: np.ones((12, 17), bool), 3: np.zeros((6, 5), bool), 4: rooms, 5: ring, 6: rng.random((1, 30)) > 0.2, 7: rng.random((40, 3)) > 0.1}


def state(spark, masks, size):
    rows = [(m, r, c, bool(v)) for m, free in masks.items() for (r, c), v in np.ndenumerate(free)]
    return shapes.packed(spark.createDataFrame(rows, "map_id long, row int, col int, free boolean"), size)


def chains(df, *key):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in key), []).append((r["i"], r["row"], r["col"]))
    assert all([p[0] for p in sorted(v)] == list(range(len(v))) for v in out.values())
    return {k: [p[1:] for p in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("size", [6])
def test_thinning(spark, masks, size):
    got = {m: np.zeros(f.shape, bool) for m, f in masks.items()}
    for r in shapes.state_cells(shapes.thinned(state(spark, masks, size), size), size).collect():
        got[r["map_id"]][r["row"], r["col"]] = True
    for m, free in masks.items():
        assert (got[m] == thin(free)).all(), m


@pytest.mark.parametrize("size", [7])
def test_branches(spark, masks, size):
    # skeletons, and raw masks: crowded cells have many neighbours
    thinned = {m: thin(f) for m, f in masks.items()} | {m + 100: f & (np.indices(f.shape).sum(axis=0) % 3 > 0) for m, f in masks.items()}
    got = chains(shapes.branches(state(spark, thinned, size), size), "map_id", "branch")
    want = {(m, k): path for m, f in thinned.items() for k, path in enumerate(branches(f))}
    assert got == want


@pytest.mark.parametrize("size", [7])
def test_rings(spark, masks, size):
    got = chains(shapes.ring_points(state(spark, masks, size), size), "map_id", "ring")
    assert got == {(m, k): [tuple(p) for p in ring.tolist()] for m, f in masks.items() for k, ring in enumerate(contours(f))}


def test_simplified_rings(spark, masks):
    shape = spark.createDataFrame([(m, *f.shape) for m, f in masks.items()], "map_id long, height int, width int")
    got = chains(shapes.rings(state(spark, masks, 8), shape, 0.6, 8), "map_id", "ring")
    want = {(m, k): [tuple(p) for p in np.clip(simplify(ring, 0.6), 0, (f.shape[0] - 1, f.shape[1] - 1)).tolist()] for m, f in masks.items() for k, ring in enumerate(contours(f))}
    assert got == want


def test_simplification_of_lines(spark):
    rng = np.random.default_rng(4)
    lines = {k: np.cumsum(rng.integers(-2, 3, (n, 2)), axis=0).astype(float) for k, n in enumerate((1, 2, 3, 40, 200))}
    points = spark.createDataFrame([(0, k, i, *map(float, p)) for k, v in lines.items() for i, p in enumerate(v)], "map_id long, ring int, i int, row double, col double")
    rows = sorted((r["ring"], r["i"], r["row"], r["col"]) for r in shapes.simplified(points, 1.5).collect())
    got = {k: [r[1:] for r in rows if r[0] == k] for k in lines}
    for k, v in lines.items():
        want = [tuple(p) for p in simplify(v, 1.5).tolist()] if len(v) > 1 else [tuple(v[0])]
        assert [p[1:] for p in got[k]] == want, k


def test_chains_over_many_pieces(spark):
    """A line of 300 pieces and a ring of 257, in any order of names."""
    rng = np.random.default_rng(2)
    line, ring = rng.permutation(10_000)[:300].tolist(), (20_000 + rng.permutation(5000)[:257]).tolist()
    rows = [(1, a, b, 3, a, 1) for a, b in zip(line, [*line[1:], None], strict=True)] + [(1, a, b, 2, a, 0) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    got = {r["entry"]: r for r in shapes.rank_chains(spark.createDataFrame(rows, "map_id long, entry long, exit long, length long, low long, low_at long")).collect()}
    assert [got[a]["start"] for a in line] == [3 * i for i in range(300)] and {got[a]["name"] for a in line} == {line[-1]} and got[line[0]]["total"] == 900
    k = ring.index(min(ring))
    assert [got[a]["start"] for a in ring[k:] + ring[:k]] == [2 * i for i in range(257)] and got[ring[0]]["ring"]
