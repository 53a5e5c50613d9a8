"""Whole routes, path metrics, build stages, drawn maps, metadata and timers."""

import json
import math

import numpy as np
import pytest

from waymark.manager import MapManager
from waymark.measure import Sections, write_json
from waymark.operators import build as b
from waymark.operators import evaluate, kernels
from waymark.sources import maps


def cells_of(spark, images):
    rows = [(k, r, c, int(v)) for k, im in enumerate(images) for (r, c), v in np.ndenumerate(im)]
    return spark.createDataFrame(rows, "map_id long, row int, col int, value int")


@pytest.fixture(scope="module")
def walls():
    image = np.full((40, 50), 255, np.uint8)
    image[10:30, 24:26] = 0
    return image


def test_find_routes_equals_the_manager(spark, walls):
    manager = MapManager()
    e = manager.create("a", walls, 0.05, 0.1)
    names = list(e.graph.nodes)
    ids = {p: i for i, p in enumerate(names)}
    nodes = spark.createDataFrame([(0, i, *p) for p, i in ids.items()], "map_id long, node_id int, row int, col int")
    edges = spark.createDataFrame([(0, ids[p], ids[q], w) for p in names for q, (w, _) in e.graph.near[p].items() if p < q], "map_id long, src int, dst int, weight double")
    blocked = spark.createDataFrame([(0, r, c, bool(v)) for (r, c), v in np.ndenumerate(e.blocked)], "map_id long, row int, col int, blocked boolean")
    rng = np.random.default_rng(4)
    asked = [(i, 0, *map(int, (rng.integers(-1, 41), rng.integers(-1, 51), rng.integers(0, 40), rng.integers(0, 50)))) for i in range(60)]
    asked.append((60, 7, 1, 1, 2, 2))  # an unknown map
    got = b.find_routes(spark.createDataFrame(asked, "route_id long, map_id long, r0 int, c0 int, r1 int, c1 int"), blocked, nodes, edges, shortcut=0.5, part=20).collect()
    assert len(got) == 61
    assert {r["reason"] for r in got} >= {"bad start", "straight", "search"}
    for row in got:
        _, m, r0, c0, r1, c1 = asked[row["route_id"]]
        if m == 7:
            assert (row["found"], row["reason"]) == (False, "bad start")
            continue
        want = manager.route("a", *(b.world(r, c, *e.frame())[:2] for r, c in ((r0, c0), (r1, c1))), shortcut=0.5)
        assert row["found"] == bool(want)
        if want:
            assert [(p["row"], p["col"]) for p in row["points"]] == [b.pixel(*p[:2], *e.frame()) for p in want]


def test_path_metrics_on_a_line(spark):
    nodes = spark.createDataFrame([(0, i, 5, 5 + 10 * i) for i in range(3)] + [(1, 0, 1, 1)], "map_id long, node_id int, row int, col int")
    edges = spark.createDataFrame([(0, 0, 1, 10.0), (0, 1, 2, 10.0)], "map_id long, src int, dst int, weight double")
    image = np.full((11, 31), 255, np.uint8)
    image[0] = 0
    got = {r["map_id"]: r for r in evaluate.path_metrics(nodes, edges, cells_of(spark, [image, image]), samples=50).collect()}
    assert got[0]["path_success_rate"] == 1.0 and got[0]["average_path_smoothness"] == 1.0 and got[0]["average_path_clearance"] == 5.0
    assert 10 <= got[0]["average_path_length"] <= 20
    assert tuple(got[1])[1:] == (0.0, 0.0, 0.0, 0.0)


def test_diameter_of_a_path_and_of_two_parts(spark):
    nodes = spark.createDataFrame([(m, i, 0, i) for m in (0, 1) for i in range(4)], "map_id long, node_id int, row int, col int")
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0), (0, 2, 3, 1.0), (1, 0, 1, 1.0)], "map_id long, src int, dst int, weight double")
    assert {r["map_id"]: r["graph_diameter"] for r in evaluate.diameter(nodes, edges).collect()} == {0: 3.0, 1: math.inf}


def test_stages_alone(spark, walls):
    cells = cells_of(spark, [walls])
    free = kernels.squared_distance(np.pad(walls > 127, 1))[1:-1, 1:-1] >= 4
    skeleton = b.skeletons(cells, safety=0.1, resolution=0.05).toPandas()
    assert len(skeleton) and free[skeleton["row"], skeleton["col"]].all()
    placed = b.free_samples(cells, distance=4).toPandas()
    d = kernels.squared_distance(walls > 127)
    assert (d[placed["row"], placed["col"]] > 16).all()
    rings = b.boundaries(cells, safety=0.1, resolution=0.05).toPandas()
    assert rings["ring"].nunique() == 2  # the outer border, and round the wall


def test_triangulation_on_lattices_is_planar():
    pts = [(r, c) for r in range(6) for c in range(7)]
    edges = kernels.triangulate(pts)
    assert len(edges) == 3 * len(pts) - 3 - 2 * (5 + 6)  # a full triangulation of a convex lattice


def test_drawn_maps_and_metadata(spark, tmp_path):
    w = maps.warehouse(spark)
    assert w.count() == 250_000 and w.filter("row = 210 AND col = 250").first()["value"] == 0
    (tmp_path / "m.yaml").write_text("image: m.png\nresolution: 0.05\norigin: [-11.975, -17.975, 0.0]\n")
    row = maps.map_yaml(spark, str(tmp_path / "m.yaml")).first()
    assert (row["image"], row["resolution"], row["origin"]) == ("m.png", 0.05, [-11.975, -17.975, 0.0])


def test_sections_and_sink(tmp_path):
    s = Sections()
    with s.section("build"):
        pass
    got = s.time_queries(lambda x, y: x + y, 3.0, 2.0, count=10)
    assert got["min_query_time"] <= got["average_query_time"] <= got["max_query_time"] <= got["total_query_time"]
    write_json(s.results(), str(tmp_path / "p.json"))
    out = json.loads((tmp_path / "p.json").read_text())
    assert set(out) == {"total_time", "peak_memory_mb", "component_breakdown", "query_performance"} and set(out["component_breakdown"]) == {"build", "queries"}


def test_clustering_tells_neighbours_of_neighbours(spark):
    """Against triangles counted one by one, without a row for each pair of a node's edges."""
    from itertools import combinations

    from waymark.operators import graph

    pairs = {1: [(a, b) for a, b in combinations(range(8), 2) if (a * b + a) % 3], 2: [(0, 1), (1, 2), (0, 2), (2, 3)], 3: [(0, 1)]}
    nodes = spark.createDataFrame([(m, i) for m in (*pairs, 4) for i in range(9)], "map_id long, node_id int")
    edges = spark.createDataFrame([(m, a, b, 1.0) for m, x in pairs.items() for a, b in x], "map_id long, src int, dst int, weight double")
    got = graph.clustering(nodes, edges)
    assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
    for r in got.collect():
        e, total = set(pairs.get(r["map_id"], ())), 0.0
        for i in range(9):
            near = [b if a == i else a for a, b in e if i in (a, b)]
            if len(near) > 1:
                total += sum((min(p), max(p)) in e for p in combinations(near, 2)) * 2 / (len(near) * (len(near) - 1))
        assert abs(r["average_clustering"] - total / 9) < 1e-6
