"""Tiled regions, distances, nearest nodes and coverage against plain one-map code, with tiles much smaller than the maps."""

import numpy as np
import pytest

from waymark.operators import tiles
from waymark.operators.kernels import label_regions, node_map, squared_distance


def cells(spark, maps):
    rows = [(m, r, c, bool(v)) for m, free in maps.items() for (r, c), v in np.ndenumerate(free)]
    return spark.createDataFrame(rows, "map_id long, row int, col int, free boolean")


@pytest.fixture(scope="module")
def maps():
    rng = np.random.default_rng(3)
    spiral = np.zeros((19, 23), bool)
    r, c, dr, dc = 1, 1, 0, 1
    spiral[1, 1] = True
    for n in (20, 16, 20, 14, 18, 12, 16, 10, 14, 8, 12, 6, 10):
        for _ in range(n):
            if 0 < r + dr < 18 and 0 < c + dc < 22:
                r, c = r + dr, c + dc
                spiral[r, c] = True
        dr, dc = dc, -dr
    corridor = np.zeros((21, 40), bool)
    corridor[1:-1, 1:15] = corridor[1:-1, 25:-1] = True
    corridor[10, 15:25] = True  # one pixel wide: closed on an inflated map
    return {0: rng.random((23, 31)) > 0.4, 1: rng.random((8, 8)) > 0.5, 2: np.ones((9, 17), bool), 3: np.zeros((6, 5), bool), 4: spiral, 5: corridor, 6: rng.random((1, 30)) > 0.2, 7: rng.random((40, 3)) > 0.02}


def raster(df, shape, value, fill):
    out = np.full(shape, fill)
    for r in df:
        out[r["row"], r["col"]] = fill if r[value] is None else r[value]
    return out


def by_map(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["map_id"], []).append(r)
    return out


@pytest.mark.parametrize("size", [5, 8])
def test_regions(spark, maps, size):
    got = by_map(tiles.regions(cells(spark, maps), size))
    for m, free in maps.items():
        assert (raster(got.get(m, []), free.shape, "region", 0) == label_regions(free)).all(), m


@pytest.mark.parametrize(("size", "ring"), [(5, False), (8, True), (20, False), (7, True)])
def test_distances(spark, maps, size, ring):
    got = by_map(tiles.distance_cells(tiles.distances(cells(spark, maps), size, ring), size))
    for m, free in maps.items():
        want = squared_distance(np.pad(free, 1))[1:-1, 1:-1] if ring else np.where(free.all(), -1, squared_distance(free))
        assert (raster(got[m], free.shape, "d2", -1) == want).all(), m


def test_envelope_is_exact():
    rng = np.random.default_rng(8)
    for _ in range(60):
        g2 = np.where(rng.random((6, 12)) < 0.4, tiles.FAR, rng.integers(0, 12, (6, 12)) ** 2)
        at = np.sort(rng.choice(40, 12, replace=False))
        got = tiles.row_distances(g2, at, np.arange(40))
        want = (g2[:, :, None] + (at[:, None] - np.arange(40)) ** 2).min(axis=1)
        assert (np.where(got >= tiles.FAR, -1, got) == np.where(want >= tiles.FAR, -1, want)).all()


@pytest.mark.parametrize("size", [5, 16])
def test_nearest_nodes(spark, maps, size):
    rng = np.random.default_rng(1)
    at = {m: [(int(rng.integers(-1, f.shape[0] + 1)), int(rng.integers(-1, f.shape[1] + 1))) for _ in range(9)] for m, f in maps.items() if m != 1}
    nodes = [(m, i, *p) for m, ps in at.items() for i, p in enumerate(dict.fromkeys(ps))]
    got = by_map(tiles.nearest_nodes(cells(spark, maps), spark.createDataFrame(nodes, "map_id long, node_id int, row int, col int"), size))
    for m, free in maps.items():
        label, hops = node_map(~free, list(dict.fromkeys(at.get(m, []))))
        assert (raster(got[m], free.shape, "label", 9) == label).all(), m
        assert (raster(got[m], free.shape, "hops", 9) == hops).all(), m


def test_nodes_on_one_cell_and_no_nodes(spark):
    free = np.ones((4, 9), bool)
    grid = cells(spark, {0: free})
    nodes = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 1, 7), (0, 2, 1, 1)], "map_id long, node_id int, row int, col int")
    got = raster(by_map(tiles.nearest_nodes(grid, nodes, 3))[0], free.shape, "label", -9)
    # node 2 names the cell of node 0, whose place in the order it keeps: the middle column is as near to both
    assert (got[:, :5] == 2).all() and (got[:, 5:] == 1).all()
    assert {r["label"] for r in tiles.nearest_nodes(grid, nodes.filter("false"), 3).collect()} == {-1}


def plain_coverage(free, nodes):
    label = label_regions(free)
    if not free.any() or not nodes:
        return 0.0, None, None, 0.0
    at = np.zeros(free.shape, bool)
    at[tuple(np.array(nodes).T)] = True
    inside = np.isin(label, np.unique(label[at & free])) & free
    d = np.sqrt(squared_distance(~at))[inside]
    share = inside.sum() / free.sum()
    return share, d.mean() if len(d) else None, d.max() if len(d) else None, share / len(nodes)


@pytest.mark.parametrize("size", [6, 16])
def test_coverage(spark, maps, size):
    rng = np.random.default_rng(2)
    nodes = {m: [(int(rng.integers(f.shape[0])), int(rng.integers(f.shape[1]))) for _ in range(4)] for m, f in maps.items() if m != 2}
    nodes[5] = [(3, 3)]
    df = spark.createDataFrame([(m, *p) for m, ps in nodes.items() for p in ps], "map_id long, row int, col int")
    got = {r["map_id"]: r for r in tiles.coverage(cells(spark, maps), df, size).collect()}
    assert len(got) == len(maps)
    for m, free in maps.items():
        for a, b in zip(got[m][1:], plain_coverage(free, nodes.get(m, [])), strict=True):
            assert (a is None and b is None) or abs(a - b) < 1e-6 * max(1, b), m
    assert got[5]["free_space_coverage"] == 1.0  # through a corridor narrower than any safety distance


def test_a_node_outside_is_an_error(spark, maps):
    with pytest.raises(ValueError, match="map 1"):
        tiles.coverage(cells(spark, maps), spark.createDataFrame([(1, 8, 0)], "map_id long, row int, col int"), 4)


def test_components_by_rounds(spark):
    rng = np.random.default_rng(5)
    for n, m in ((200, 120), (60, 200), (300, 0)):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] or [(i, i + 1) for i in range(n)]
        up = tiles.joined(n + 1, *np.array(pairs).T)
        got = tiles.components(spark.createDataFrame([(k, a, b) for k in (1, 2) for a, b in pairs], "map_id long, a long, b long")).collect()
        assert all(up[r["node"]] == r["component"] for r in got)
        assert {r["node"] for r in got} >= {x for p in pairs if p[0] != p[1] for x in p} and len(got) == 2 * len({x for p in pairs if p[0] != p[1] for x in p})


def test_labels_come_with_the_messages(spark):
    """Two nodes on one cell, whose label differs from its order, are met in other tiles; cells are joined with messages alone."""
    cells = spark.createDataFrame([(1, r, c, True) for r in range(5) for c in range(17)], "map_id long, row int, col int, free boolean")
    nodes = spark.createDataFrame([(1, 3, 2, 1), (1, 9, 2, 1), (1, 4, 2, 15)], "map_id long, node_id int, row int, col int")
    got = tiles.nearest_nodes(cells, nodes, 4)
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    assert {(r["row"], r["col"]): r["label"] for r in got.collect()} == {(r, c): 9 if c <= 8 else 4 for r in range(5) for c in range(17)}
