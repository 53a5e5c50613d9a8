"""Kernels, transforms, codecs and the manager on small drawn maps."""

import math

import numpy as np
import pytest

from waymark.manager import MapManager, Service
from waymark.operators import kernels as k
from waymark.sources import codecs


def drawn(h, w, parts, background=0):
    image = np.full((h, w), background, np.uint8)
    for r, c, v in parts:
        image[r, c] = v
    return image


CROSS = drawn(20, 20, [(slice(8, 12), slice(None), 255), (slice(None), slice(8, 12), 255)])
BOX = drawn(100, 100, [(slice(40, 60), slice(40, 60), 0)], 255)
SPLIT = drawn(100, 100, [(slice(0, 100), slice(50, 52), 0)], 255)
CONFIG = k.Config(1.0, 1.5, 1.0, 2.0, 0.3, 0.3)


def test_distance_is_exact():
    rng = np.random.default_rng(3)
    free = rng.random((17, 23)) > 0.1
    walls = np.argwhere(~free)
    r, c = np.indices(free.shape)
    assert (k.squared_distance(free) == ((r[..., None] - walls[:, 0]) ** 2 + (c[..., None] - walls[:, 1]) ** 2).min(-1)).all()


def test_line_matches_a_literal_walk():
    def walk(r0, c0, r1, c1):
        dr, dc, sr, sc = abs(r1 - r0), abs(c1 - c0), (r1 > r0) - (r1 < r0), (c1 > c0) - (c1 < c0)
        out, e, r, c = [(r0, c0)], dc - dr, r0, c0
        while (r, c) != (r1, c1):
            e2 = 2 * e
            if e2 > -dr:
                e, c = e - dr, c + sc
            if e2 < dc:
                e, r = e + dc, r + sr
            out.append((r, c))
        return out

    for r in range(-6, 7):
        for c in range(-6, 7):
            assert list(zip(*(x.tolist() for x in k.line(0, 0, r, c)), strict=True)) == walk(0, 0, r, c)


def test_cross_has_a_graph_with_true_weights():
    g, blocked = k.build(CROSS, 0.05, 0.1)
    assert g.nodes and any(g.near.values())
    for p in g.near:
        for q, (w, _) in g.near[p].items():
            assert w == pytest.approx(math.dist(p, q))
            assert not k.collides(blocked, p, q) or not k.collides(blocked, q, p)


def test_empty_and_tiny_maps():
    assert not k.build(np.zeros((10, 10), np.uint8), 0.05, 0.1)[0].nodes
    m = MapManager()
    with pytest.raises(ValueError):
        m.create("tiny", np.full((1, 1), 255, np.uint8), 0.05, 0.2)
    assert len(m.errors()) == 1 and m.get("tiny") is None


def test_free_map_keeps_its_margin():
    g, _ = k.build(np.full((10, 10), 255, np.uint8), 0.05, 0.1)
    assert g.nodes and all(2 <= r < 8 and 2 <= c < 8 for r, c in g.nodes)


def test_square_contour():
    ring = k.contours(drawn(100, 100, [(slice(40, 60), slice(40, 60), 255)]) > 0)
    assert len(ring) == 1 and len(k.simplify(ring[0], 0.6)) >= 5


def test_triangulation_has_empty_circles():
    rng = np.random.default_rng(5)
    pts = sorted({tuple(x) for x in rng.integers(0, 40, (40, 2)).tolist()})
    edges = k.triangulate(pts)
    n = len(pts)
    assert n - 1 <= len(edges) <= 3 * n - 6
    for a, b in edges:  # planar: no two edges cross
        for c, d in edges:
            if len({a, b, c, d}) == 4:
                o = lambda i, j, m: np.sign((pts[j][0] - pts[i][0]) * (pts[m][1] - pts[i][1]) - (pts[j][1] - pts[i][1]) * (pts[m][0] - pts[i][0]))
                assert not (o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0)


def test_thinning_keeps_the_regions():
    mask = CROSS > 0
    thin = k.thin(mask)
    assert thin.sum() < mask.sum() and k.label_regions(thin).max() == k.label_regions(mask).max()


def test_routes_go_round_and_stop_at_walls():
    m = MapManager()
    m.create("box", BOX, 0.1, 0.2, config=CONFIG)
    path = m.route("box", (2, 2), (8, 8))
    assert sum(math.dist(a, b) for a, b in zip(path, path[1:], strict=False)) > math.dist((2, 2), (8, 8))
    m.create("split", SPLIT, 0.1, 0.2, config=CONFIG)
    assert m.route("split", (2, 5), (8, 5)) == []
    assert m.route("split", (2, 2), (2, 4), shortcut=3.0) == [(2, 2), (2, 4)]
    assert m.route("split", (2, 2), (2, 4)) != []
    assert m.route("split", (4, 5), (5, 5), shortcut=2.0) == []
    with pytest.raises(KeyError):
        m.route("none", (0, 0), (1, 1))


def test_nodes_find_themselves():
    m = MapManager()
    e = m.create("a", BOX, 0.1, 0.2, config=CONFIG)
    world = [p[:2] for p in m.csr("a")["nodes"]]
    assert m.nearest("a", world) == list(range(len(e.graph.nodes)))
    assert m.nearest("a", [(-50.0, 0.0)]) == [None]


def test_lower_threshold_gives_more_nodes():
    bands = drawn(30, 30, [(slice(5, 25), slice(5, 25), 200), (slice(10, 20), slice(10, 20), 50)], 127)
    assert len(k.build(bands, 0.05, 0.2, 30)[0].nodes) >= len(k.build(bands, 0.05, 0.2, 210)[0].nodes)


@pytest.mark.parametrize("name", ["skeleton_distance", "boundary_distance", "free_distance", "merge_distance", "min_subgraph_length"])
def test_config_is_checked(name):
    with pytest.raises(ValueError, match=name):
        k.Config(**{name: 0})
    with pytest.raises(ValueError):
        k.Config(boundary_inflation=1.0)


def test_png_round_trip_and_service():
    rng = np.random.default_rng(1)
    for shape in ((9, 7), (9, 7, 3), (9, 7, 4)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert (codecs.decode_png(codecs.encode_png(a)).reshape(shape) == a).all()
    s = Service()
    assert s.generate(" ", b"x", resolution=0.1, safety_distance=0.2, occupancy_threshold=127)[0] == 400
    assert s.generate("m", b"bad", resolution=0.1, safety_distance=0.2, occupancy_threshold=127)[0] == 400
    assert s.generate("m", codecs.encode_png(BOX), resolution=0.1, safety_distance=0.2, occupancy_threshold=127)[0] == 201
    assert s.health()[1]["status"] == "running" and s.graph("m")[0] == 200 and s.graph("x")[0] == 404
    assert s.route("x", (0, 0), (1, 1))[0] == 404 and s.visualize("m")[1][:4] == b"\x89PNG"
