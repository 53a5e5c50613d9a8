"""Merging by rounds against pair after pair on one map."""

import numpy as np
import pytest

from waymark.operators import merging, shapes
from waymark.operators.kernels import Graph, collides, merge_close


def graphs(seed):
    """Crowded random maps: chains of close nodes, walls between, edges along free lines."""
    rng = np.random.default_rng(seed)
    out = {}
    for m, (h, w, n, density, links) in enumerate([(20, 26, 60, 0.1, 90), (16, 16, 20, 0.0, 60), (9, 40, 40, 0.25, 60), (30, 30, 25, 0.05, 0), (5, 5, 1, 0.0, 0), (6, 6, 20, 0.03, 20)]):
        free = rng.random((h, w)) >= density
        nodes = [divmod(int(k), w) for k in rng.permutation(h * w)[:n]]
        g = Graph()
        for p in nodes:
            g.node(p)
        for i, j in rng.integers(0, n, (links, 2)).tolist():
            near = abs(nodes[i][0] - nodes[j][0]) + abs(nodes[i][1] - nodes[j][1]) < 14
            if i != j and near and not collides(~free, nodes[i], nodes[j]):
                g.edge(nodes[i], nodes[j], "made")
        out[m] = (free, nodes, g)
    return out


def run(spark, maps, radius, size=7):
    cells = spark.createDataFrame([(m, r, c, bool(v)) for m, (free, _, _) in maps.items() for (r, c), v in np.ndenumerate(free)], "map_id long, row int, col int, free boolean")
    nodes = spark.createDataFrame([(m, i, *p) for m, (_, ps, _) in maps.items() for i, p in enumerate(ps)], "map_id long, node_id int, row int, col int")
    edges = spark.createDataFrame([(m, ps.index(p), ps.index(q), *v) for m, (_, ps, g) in maps.items() for p in g.near for q, v in g.near[p].items() if p < q], "map_id long, src int, dst int, weight double, edge_type string")
    n, e = merging.merged(nodes, edges, shapes.packed(cells, size), radius, size)
    return n.collect(), e.collect()


@pytest.mark.parametrize(("seed", "radius"), [(1, 1.5), (2, 3)])
def test_rounds_equal_the_sequence(spark, seed, radius):
    maps = graphs(seed)
    got_nodes, got_edges = run(spark, maps, radius)
    for m, (free, nodes, g) in maps.items():
        merge_close(g, ~free, radius)
        assert [(r["row"], r["col"]) for r in sorted((r for r in got_nodes if r["map_id"] == m), key=lambda r: r["place"])] == list(g.nodes), m
        got = sorted((min(p := nodes[r["src"]], q := nodes[r["dst"]]), max(p, q), round(r["weight"], 9), r["edge_type"]) for r in got_edges if r["map_id"] == m)
        assert got == sorted((p, q, round(w, 9), kind) for p in g.near for q, (w, kind) in g.near[p].items() if p < q), m


def test_a_chain_and_a_star(spark):
    """Nodes in a row, each close to the next, and one node with many close ones around it."""
    row = [(2, c) for c in range(2, 14, 2)]
    star = [(10, 10), *[(10 + a, 10 + b) for a in (-2, 0, 2) for b in (-2, 0, 2) if a or b]]
    maps = {}
    for m, nodes in enumerate((row, star)):
        g = Graph()
        for p in nodes:
            g.node(p)
        for p, q in zip(nodes, nodes[1:], strict=False):
            g.edge(p, q, "made")
        maps[m] = (np.ones((21, 42), bool), nodes, g)
    got, _ = run(spark, maps, 2)
    for m, (free, _, g) in maps.items():
        merge_close(g, ~free, 2)
        assert [(r["row"], r["col"]) for r in sorted((r for r in got if r["map_id"] == m), key=lambda r: r["place"])] == list(g.nodes)


def test_lines_that_leave_the_map_are_blocked(spark):
    free = shapes.packed(spark.createDataFrame([(0, r, c, (r, c) != (3, 4)) for r in range(6) for c in range(9)], "map_id long, row int, col int, free boolean"), 4)
    lines = [(0, 0, 0, 0, 8), (1, 3, 0, 3, 8), (2, 0, 0, 6, 0), (3, 0, 0, 0, 9), (4, -1, 0, 2, 2), (5, 5, 8, 5, 8), (6, 3, 4, 3, 4)]
    got = merging.blocked_lines(spark.createDataFrame([(0, k, k, *x) for k, *x in lines], "map_id long, pa long, pb long, r0 int, c0 int, r1 int, c1 int"), free, 4)
    assert sorted(r["pa"] for r in got.collect()) == [1, 2, 3, 4, 6]


def test_no_nodes(spark):
    n, e = merging.merged(spark.createDataFrame([], "map_id long, node_id int, row int, col int"), spark.createDataFrame([], "map_id long, src int, dst int, weight double, edge_type string"), shapes.packed(spark.createDataFrame([(0, 0, 0, True)], "map_id long, row int, col int, free boolean"), 4), 3)
    assert n.count() == 0 and e.count() == 0


def crowded(seed):
    """Walls of small maps, and lines between cells of a few rows, so that many ends are neighbours; some ends lie outside."""
    rng = np.random.default_rng(seed)
    out = {}
    for m, (h, w, n, density) in enumerate([(12, 20, 60, 0.02), (9, 15, 40, 0.0), (16, 9, 80, 0.05), (6, 30, 3, 0.1)]):
        free = rng.random((h, w)) >= density
        lines = np.stack([rng.integers(3, min(h, 9), n), rng.integers(0, w, n), rng.integers(-1, h + 1, n), rng.integers(0, w, n)], axis=1)
        out[m] = (free, lines.tolist())
    return out


def test_lines_merge_whole_as_over_tiles_and_as_the_sequence(spark):
    maps, least, radius = crowded(5), 1.0, 1.0
    packed = spark.createDataFrame([(m, *f.shape, np.flatnonzero(~f).tolist()) for m, (f, _) in maps.items()], "map_id long, height int, width int, walls array<int>")
    lines = spark.createDataFrame([(m, *x) for m, (_, xs) in maps.items() for x in xs], "map_id long, r0 int, c0 int, r1 int, c1 int")
    got = [sorted(map(tuple, merging.merged_lines(packed, lines, least=least, radius=radius, size=7, **more).collect())) for more in ({}, {"most": 50})]
    assert got[0] == got[1]
    for m, (free, xs) in maps.items():
        h, w = free.shape
        g = Graph()
        for r, c in sorted({(r, c) for x in xs for r, c in (x[:2], x[2:]) if 0 <= r < h and 0 <= c < w}):
            g.node((r, c))
        for r0, c0, r1, c1 in xs:
            if (r0, c0) != (r1, c1) and not collides(~free, (r0, c0), (r1, c1)):
                g.edge((r0, c0), (r1, c1), "line")
        merge_close(g, ~free, radius)
        mine = sorted((x for x in got[0] if x[0] == m), key=lambda x: x[4])
        assert [x[2:4] for x in mine] == list(g.nodes)
        assert [x[5] for x in mine] == [len(g.near[p]) for p in g.nodes]
        assert [x[1] for x in mine] == [r * w + c for r, c in g.nodes]


def test_the_query_has_rows(spark):
    from waymark.plans import queries as q

    assert q.merged_nodes(spark, "/root/testdata/sf0.001").count() > 0
