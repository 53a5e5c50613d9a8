"""Components, distances and diameters by rounds against one-map searches."""

import math
from collections import deque

import numpy as np
import pytest

from waymark.operators import graph, reach
from waymark.operators.kernels import shortest_path


@pytest.fixture(scope="module")
def graphs():
    rng = np.random.default_rng(6)
    out = {}
    for m, (n, k) in enumerate(((70, 120), (150, 160), (1, 0), (5, 0), (130, 400))):
        at = rng.integers(0, 60, (n, 2))
        pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (k, 2)).tolist() if a != b}
        if m == 4:
            pairs |= {(i, i + 1) for i in range(n - 1)}  # connected
        out[m] = (at, {p: float(np.hypot(*(at[p[0]] - at[p[1]]))) + 0.5 for p in sorted(pairs)})
    return out


@pytest.fixture(scope="module")
def frames(spark, graphs):
    nodes = [(m, i, *map(int, p)) for m, (at, _) in graphs.items() for i, p in enumerate(at)]
    edges = [(m, a, b, w) for m, (_, e) in graphs.items() for (a, b), w in e.items()]
    return spark.createDataFrame(nodes, "map_id long, node_id int, row int, col int"), spark.createDataFrame(edges, "map_id long, src int, dst int, weight double")


def near(n, edges):
    out = {i: {} for i in range(n)}
    for (a, b), w in edges.items():
        out[a][b] = out[b][a] = w
    return out


def hops(adj, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in adj[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


def test_components(graphs, frames):
    got = {(r["map_id"], r["node_id"]): r["component"] for r in graph.components(*frames).collect()}
    for m, (at, edges) in graphs.items():
        adj = near(len(at), edges)
        for i in range(len(at)):
            assert got[m, i] == min(hops(adj, i))


def test_diameters(graphs, frames):
    got = {r["map_id"]: r["graph_diameter"] for r in reach.diameter(*frames).collect()}
    for m, (at, edges) in graphs.items():
        all_ = [hops(near(len(at), edges), i) for i in range(len(at))]
        assert got[m] == (max(max(h.values()) for h in all_) if all(len(h) == len(at) for h in all_) else math.inf)


@pytest.mark.parametrize("delta", [None, 1000.0])
def test_distances(spark, graphs, frames, delta):
    sources = [(m, s) for m, (at, _) in graphs.items() for s in sorted({0, len(at) // 2, len(at) - 1})]
    got = {(r["map_id"], r["source"], r["node_id"]): r for r in reach.distances(spark.createDataFrame(sources, "map_id long, source int"), frames[1], delta).collect()}
    for m, s in sources:
        at, edges = graphs[m]
        adj = near(len(at), edges)
        flat = {i: (0.0, 0.0) for i in range(len(at))}
        for t in range(len(at)):
            path = shortest_path(adj, flat, s, t)
            if path is None:
                assert (m, s, t) not in got
                continue
            r = got[m, s, t]
            assert math.isclose(r["distance"], sum(adj[a][b] for a, b in zip(path, path[1:], strict=False)), abs_tol=1e-9)
            if t != s:
                assert math.isclose(got[m, s, r["back"]]["distance"] + adj[r["back"]][t], r["distance"], abs_tol=1e-9)
            else:
                assert r["back"] is None


def check_diameters(graphs, df):
    got = {r["map_id"]: r["graph_diameter"] for r in df.collect()}
    for m, (at, edges) in graphs.items():
        all_ = [hops(near(len(at), edges), i) for i in range(len(at))]
        assert got[m] == (max(max(h.values()) for h in all_) if all(len(h) == len(at) for h in all_) else math.inf)


@pytest.mark.parametrize("whole", [0, 100])
def test_diameters_by_rounds_and_in_part(graphs, frames, whole):
    check_diameters(graphs, reach.diameter(*frames, whole))


def test_diameters_of_small_maps_take_no_rounds(graphs, frames, monkeypatch):
    monkeypatch.setattr(reach, "cut", None)
    check_diameters(graphs, reach.diameter(*frames))
    monkeypatch.setattr(reach, "WORDS", 1)  # a map at a time
    check_diameters(graphs, reach.diameter(*frames))
