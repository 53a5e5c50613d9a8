"""Maps that go whole, many at a time, against the same maps over tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import build as b
from waymark.operators import evaluate


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(8)
    maps = {1: rng.random((19, 22)) > 0.03, 2: rng.random((19, 22)) > 0.05, 3: np.ones((9, 8), bool), 4: np.zeros((5, 6), bool), 5: rng.random((34, 12)) > 0.02}
    return spark.createDataFrame([(m, r, c, 255 if v else 0) for m, f in maps.items() for (r, c), v in np.ndenumerate(f)], "map_id long, row int, col int, value int").cache()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


FORMS = {
    "thinned": lambda c, n: b.thinned(c.selectExpr("map_id", "row", "col", "value > 127 free"), least=2.0, size=8, whole_maps=n),
    "contours": lambda c, n: b.contour_points(c.selectExpr("map_id", "row", "col", "value > 127 free"), least=3.0, size=8, whole_maps=n),
    "skeletons": lambda c, n: b.skeletons(c, safety=0.1, resolution=0.05, size=8, whole_maps=n),
    "boundaries": lambda c, n: b.boundaries(c, safety=0.1, resolution=0.05, size=8, whole_maps=n),
    "samples": lambda c, n: b.free_samples(c, distance=3, size=8, whole_maps=n),
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_whole_maps_equal_tiles(spark, cells, form):
    want = rows(FORMS[form](cells, None))
    assert want and rows(FORMS[form](cells, 410)) == want  # maps 1 and 2 over tiles, the others whole


def test_coverage_of_whole_maps(spark, cells):
    nodes = spark.createDataFrame([(1, 3, 3), (1, 3, 3), (1, 10, 20), (2, 0, 0), (3, 1, 1), (4, 2, 2), (9, 5, 5)], "map_id long, row int, col int")
    shown = lambda n: sorted((r["map_id"], *[None if v is None else round(v, 9) for v in r[1:]]) for r in evaluate.coverage(cells, nodes, size=8, whole_maps=n).collect())
    want = shown(410)
    assert len(want) == 5 and shown(None) == want
    with pytest.raises(ValueError, match="map 3"):
        evaluate.coverage(cells, nodes.union(spark.createDataFrame([(3, 9, 0)], nodes.schema)), size=8)


def test_whole_maps_take_no_rounds(spark, cells):
    """A small map's skeleton is one pass, however many tiles wide: over tiles, each round was a job of its own."""
    before = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        FORMS["skeletons"](cells, None).collect()
        jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) - set(before)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8


def test_short_walks_meet_what_lines_meet():
    from waymark.operators.kernels import Walls, collides

    rng = np.random.default_rng(5)
    for blocked in (rng.random((9, 13)) > 0.8, np.asfortranarray(rng.random((6, 4)) > 0.9)):
        meets = Walls(blocked).meets
        ends = rng.uniform(-1.5, 13.5, (400, 4)).tolist()
        assert [meets((a, b), (c, d)) for a, b, c, d in ends] == [collides(blocked, (a, b), (c, d)) for a, b, c, d in ends]


def test_builds_of_packed_maps_make_no_cell_rows(spark, cells):
    """Packed maps and their cells give the same graphs, and one pass of a task a map."""
    packed = cells.filter("value = 0").groupBy("map_id").agg(F.collect_set(F.expr("row * if(map_id = 5, 12, 22) + col")).alias("walls")).filter("map_id in (1, 2, 5)")
    packed = packed.selectExpr("map_id", "if(map_id = 5, 34, 19) height", "if(map_id = 5, 12, 22) width", "walls")
    got = b.build_graphs(packed, resolution=0.05, safety=0.1)
    assert rows(got) == rows(b.build_graphs(cells.filter("map_id in (1, 2, 5)"), resolution=0.05, safety=0.1))
    assert got.filter("kind = 'node'").count()


def test_pairs_are_those_of_choice():
    from waymark.operators import evaluate as e

    for seed, n in ((1, 2), (2, 3), (3, 29), (4, 9_999), (5, 10_001)):
        rng = np.random.default_rng(seed)
        assert e._pairs(seed, n, 200).tolist() == [rng.choice(n, 2, replace=False).tolist() for _ in range(200)]


def test_pairs_that_come_again_are_searched_once(spark, monkeypatch):
    from types import SimpleNamespace as Row

    from waymark.operators import evaluate as e

    asked = []
    monkeypatch.setattr(e, "shortest_path", lambda near, at, a, b, real=e.shortest_path: asked.append((a, b)) or real(near, at, a, b))
    nodes = [{"a": i, "b": 1, "c": 1 + 2 * i} for i in range(4)]
    edges = [{"a": i, "b": i + 1, "w": 2.0} for i in range(3)]
    cr, cc = np.indices((3, 9)).reshape(2, -1)
    row = e._sampled_paths(Row(map_id=7, n=nodes, e=edges, cr=cr, cc=cc, cv=np.where((cr == 0) & (cc == 0), 0, 255)), 500, 127)
    assert len(asked) == len(set(asked)) == 12 and row[0] == 7 and row[4] == 1.0 and row[2] == 1.0


def test_nearest_nodes_of_whole_maps(spark, cells):
    nodes = spark.createDataFrame([(1, 5, 3, 3), (1, 9, 3, 3), (1, 2, 10, 20), (2, 1, 0, 0), (2, 0, 18, 21), (2, 4, 30, 1), (3, 7, 1, 1), (4, 1, 2, 2)], "map_id long, node_id int, row int, col int")
    free = cells.selectExpr("map_id", "row", "col", "value > 127 free")
    want = rows(b.nearest_nodes(free, nodes, 8))
    assert len(want) == cells.count() and rows(b.nearest_nodes(free, nodes, 8, 410)) == want


def test_triangulations_of_whole_maps(spark):
    from waymark.operators import triangles

    rng = np.random.default_rng(3)
    points = {1: rng.integers(0, 40, (60, 2)), 2: np.indices((4, 5)).reshape(2, -1).T * 5, 3: np.array([[1, 1], [2, 2], [3, 3]]), 4: np.array([[0, 0], [0, 0], [7, 1], [2, 9]])}
    nodes = spark.createDataFrame([(m, i, *map(int, p)) for m, ps in points.items() for i, p in enumerate(ps)], "map_id long, node_id int, row int, col int")
    want = rows(triangles.delaunay(nodes, 16))
    assert rows(triangles.delaunay_maps(nodes, 16)) == want and rows(triangles.delaunay_maps(nodes, 16, 30)) == want
