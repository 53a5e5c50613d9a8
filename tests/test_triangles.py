"""Triangulation over small tiles against all triples of a map, and against one map at a time."""

from itertools import combinations

import numpy as np
import pytest

from waymark.operators import triangles
from waymark.operators.kernels import triangulate


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def inside(a, b, c, p):
    """Whether p lies in the circle of a < b < c; of four points on a circle the last one counts as higher."""
    side = 1 if turn(a, b, c) > 0 else -1
    (ax, ay), (bx, by), (cx, cy) = ((v[0] - p[0], v[1] - p[1]) for v in (a, b, c))
    rows = [(x, y, x * x + y * y) for x, y in ((ax, ay), (bx, by), (cx, cy))]
    det = side * sum(rows[i][2] * (rows[(i + 1) % 3][0] * rows[(i + 2) % 3][1] - rows[(i + 1) % 3][1] * rows[(i + 2) % 3][0]) for i in range(3))
    if det or p > c:
        return det > 0
    return turn(a, b, p) * side > 0


def by_triples(points):
    out = set()
    for a, b, c in combinations(sorted(points), 3):
        if turn(a, b, c) and not any(inside(a, b, c, p) for p in points if p not in (a, b, c)):
            out |= {(a, b), (b, c), (a, c)}
    return out


def some(rng, n, height, width):
    return [divmod(int(k), width) for k in rng.permutation(height * width)[:n]]


def run(spark, maps, size):
    nodes = spark.createDataFrame([(m, i, *p) for m, ps in maps.items() for i, p in enumerate(ps)], "map_id long, node_id int, row int, col int")
    rows = triangles.delaunay(nodes, size).collect()
    got = [(r["map_id"], *sorted((maps[r["map_id"]][r["src"]], maps[r["map_id"]][r["dst"]]))) for r in rows]
    assert len(got) == len(set(got)) and all(r["src"] < r["dst"] for r in rows)
    return {m: {g[1:] for g in got if g[0] == m} for m in maps}


def test_small_maps_against_all_triples(spark):
    rng = np.random.default_rng(3)
    maps = {
        0: some(rng, 30, 40, 40),
        1: some(rng, 30, 9, 7),  # many on one circle
        2: [(r, c) for r in range(0, 15, 3) for c in range(0, 18, 3)],  # a lattice
        3: [(4, c) for c in range(0, 50, 5)],  # one line: no triangle
        4: [(7, 7)],
        5: [(0, 0), (60, 1)],
        6: [(0, 0), (1, 50), (2, 99)],  # a sliver
        7: [(25 + a, 25 + b) for a, b in ((0, 25), (7, 24), (15, 20), (20, 15), (24, 7), (25, 0), (-7, 24), (-15, 20), (-20, 15), (-24, 7), (-25, 0), (0, -25))],  # one circle
        8: [(-3, -9), (-20, 5), (8, -2), (30, 40), (0, 0)],
    }
    got = run(spark, maps, 4)
    for m, points in maps.items():
        assert got[m] == by_triples(points), m


@pytest.mark.parametrize("size", [16, 50])
def test_wide_maps_against_one_map_at_a_time(spark, size):
    rng = np.random.default_rng(size)
    hole = [p for p in some(rng, 900, 200, 200) if (p[0] - 100) ** 2 + (p[1] - 100) ** 2 > 3600]
    maps = {0: some(rng, 1200, 200, 260), 1: hole, 2: some(rng, 60, 400, 400) + [(500, 10 * k) for k in range(20)], 3: [(r, c) for r in range(0, 150, 10) for c in range(0, 150, 10)]}
    got = run(spark, maps, size)
    for m, points in maps.items():
        want = {tuple(sorted((points[i], points[j]))) for i, j in triangulate(points)}
        assert got[m] == want, m


def test_most_points_are_done_in_the_first_round(spark):
    """Only a rim goes on: what later rounds see is far less than the map."""
    points = some(np.random.default_rng(9), 3000, 300, 300)
    df = spark.createDataFrame([(0, i, *p, True) for i, p in enumerate(points)], "map_id long, node_id int, row int, col int, open boolean")
    done = triangles._round(df, 50).filter("other IS NULL").count()
    assert done > 0.85 * len(points)


def test_repeated_and_null_nodes_and_none(spark):
    schema = "map_id long, node_id int, row int, col int"
    rows = [(0, 5, 0, 0), (0, 3, 0, 0), (0, 1, 0, 9), (0, 2, 9, 0), (0, 4, None, 3), (None, 0, 1, 1)]
    got = triangles.delaunay(spark.createDataFrame(rows, schema), 4).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2), (0, 1, 3), (0, 2, 3)]
    assert triangles.delaunay(spark.createDataFrame([], schema)).count() == 0
