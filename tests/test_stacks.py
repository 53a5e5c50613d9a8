"""Builds of stacks of maps against the kernels, map by map."""

import numpy as np
import pytest

from waymark.operators.kernels import Config, build, close_pairs, triangulate
from waymark.operators.stacks import built, triangulated


def equal(stack, resolution=0.05, safety=0.1, cfg=None):
    cfg = cfg or Config()
    stride = 2 * stack.shape[2]
    for free, (near, kinds) in zip(stack, built(stack, resolution, safety, cfg), strict=True):
        g, _ = build(free, resolution, safety, 0, cfg)
        assert [divmod(p, stride) for p in near] == list(g.nodes)
        assert [kinds[p] for p in near] == list(g.nodes.values())
        assert [{divmod(q, stride): kind for q, kind in near[p].items()} for p in near] == [{q: kind for q, (_, kind) in g.near[p].items()} for p in g.nodes]


def maps(seed, density, shape=(6, 30, 41)):
    free = np.random.default_rng(seed).random(shape) >= density
    free[:, 0, 0] = False
    return free


@pytest.mark.parametrize("density", [0.001, 0.02, 0.1, 0.3, 1.0])
@pytest.mark.parametrize(("resolution", "safety"), [(0.05, 0.1), (0.05, 0.05), (0.1, 0.1)])
def test_a_stack_equals_each_map(density, resolution, safety):
    equal(maps(4, density), resolution, safety)


@pytest.mark.parametrize("stage", ["skeleton", "boundary", "free", "delaunay", "prune"])
def test_without_a_stage(stage):
    equal(maps(5, 0.03, (3, 30, 41)), cfg=Config(**{stage if stage == "prune" else f"use_{stage}": False}))


@pytest.mark.parametrize("shape", [(8, 1, 1), (8, 1, 9), (8, 9, 1), (8, 2, 2), (8, 5, 4)])
def test_tiny_maps(shape):
    equal(maps(6, 0.2, shape))
    equal(maps(7, 0.2, shape), 0.1, 0.1)


def test_samples_and_loops():
    """A map with room for free-space samples, and one whose skeleton is a ring without an end."""
    free = np.ones((2, 90, 110), bool)
    free[0, 40:50, 20:30] = False
    free[1, [0, -1]] = free[1, :, [0, -1]] = False
    free[1, 20:70, 20:90] = False
    equal(free)
    equal(free, safety=0.4)


@pytest.mark.parametrize(("h", "w", "n"), [(48, 64, 300), (6, 6, 36), (1, 30, 10), (30, 1, 10), (4, 40, 60), (8, 8, 3), (8, 8, 1), (15000, 15000, 50)])
def test_triangulations_of_many_maps(h, w, n):
    rng = np.random.default_rng(n)
    sets = [sorted({tuple(x) for x in np.stack([rng.integers(0, h, n), rng.integers(0, w, n)], axis=1).tolist()}) for _ in range(10)]
    sets += [[(i, 2 * i) for i in range(7)], [(0, 0), (0, 2), (2, 0), (2, 2)], [(0, 1), (1, 0), (1, 2), (2, 1)]]
    k = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    p = np.array([x for s in sets for x in s], np.int64)
    i, j = triangulated(k, p[:, 0], p[:, 1])
    start = np.append(0, np.cumsum([len(s) for s in sets]))
    for m, s in enumerate(sets):
        got = list(zip((i[k[i] == m] - start[m]).tolist(), (j[k[i] == m] - start[m]).tolist(), strict=True))
        assert len(got) == len(set(got)) and set(got) == triangulate(s)


@pytest.mark.parametrize("radius", [1, 1.5, 3, 5])
def test_close_pairs(radius):
    rng = np.random.default_rng(1)
    cells = [divmod(int(x), 20) for x in rng.permutation(15 * 20)[:80]]
    want = [(i, j) for i in range(80) for j in range(i + 1, 80) if np.hypot(cells[i][0] - cells[j][0], cells[i][1] - cells[j][1]) <= radius]
    assert list(close_pairs([r * 40 + c for r, c in cells], radius, 15, 20)) == want


def test_a_build_takes_stacks_whole(spark):
    """Maps that are all free, that can't be built and that have walls, of two sizes, as the kernel builds them."""
    from waymark.operators import build as b

    free = {1: np.ones((40, 50), bool), 2: np.ones((3, 3), bool), **{m: f for m, f in enumerate(maps(8, 0.02, (4, 30, 41)), 3)}}
    packed = spark.createDataFrame([(m, *f.shape, np.flatnonzero(~f).tolist()) for m, f in free.items()], "map_id long, height int, width int, walls array<int>")
    got = b.build_graphs(packed, resolution=0.05, safety=0.1).collect()
    assert [r["map_id"] for r in got if r["kind"] == "error"] == [2]
    for m, f in free.items():
        if m == 2:
            continue
        g, _ = build(f, 0.05, 0.1, 0)
        nodes = sorted((r["node_id"], (r["row"], r["col"]), r["node_type"]) for r in got if r["map_id"] == m and r["kind"] == "node")
        assert nodes == [(i, p, kind) for i, (p, kind) in enumerate(g.nodes.items())]
        names = list(g.nodes)
        edges = {(names[r["src"]], names[r["dst"]]): (r["weight"], r["edge_type"]) for r in got if r["map_id"] == m and r["kind"] == "edge"}
        want = {(p, q): (w * 0.05, kind) for i, p in enumerate(names) for q, (w, kind) in g.near[p].items() if i < names.index(q)}
        assert {e: kind for e, (_, kind) in edges.items()} == {e: kind for e, (_, kind) in want.items()}
        assert all(abs(edges[e][0] - want[e][0]) < 1e-12 for e in want)


def test_coverage_of_builds(spark):
    """Built and covered by one task, by tiles where maps are large, and by the nodes of built graphs; odd maps among them."""
    from waymark.operators import build as b
    from waymark.operators import evaluate

    free = {1: np.ones((40, 50), bool), 2: np.ones((3, 3), bool), 3: np.zeros((5, 6), bool), **{m: f for m, f in enumerate(maps(9, 0.1, (3, 20, 21)), 4)}}
    packed = spark.createDataFrame([(m, *f.shape, np.flatnonzero(~f).tolist()) for m, f in free.items()], "map_id long, height int, width int, walls array<int>")
    shown = lambda df: sorted((r["map_id"], *[None if v is None else round(v, 9) for v in r[1:]]) for r in df.collect())
    want = shown(evaluate.coverage(packed, b.nodes_of(b.build_graphs(packed, resolution=0.05, safety=0.05)), size=16))
    assert len(want) == len(free) and 0 < len({r[1:] for r in want if r[1]})
    stacked = evaluate.build_coverage(packed, resolution=0.05, safety=0.05, size=16)
    # no exchange between the build and its coverage: the maps are dealt once
    assert stacked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert shown(stacked) == want
    assert shown(evaluate.build_coverage(packed, resolution=0.05, safety=0.05, size=16, whole_maps=500)) == want
