"""Exploded and packed rows are joined by sorting: the planner's guess of their size would send them through the driver."""

import os

import pytest

from pyspark.sql import functions as F

from waymark.operators import raster
from waymark.plans import queries as q
from waymark.shared import cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

WHOLE = ("border_inflation", "merge_pairs")


@pytest.mark.parametrize("name", WHOLE)
def test_no_rows_are_sent_through_the_driver(spark, name):
    plan = q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_band_with_and_without_sizes(spark):
    cells = q._grid_cells(spark, SF).filter("map_id < 4")
    a, b = (raster.border_band(c, 0.1, 0.05).toPandas().sort_values(["map_id", "row", "col"]).to_numpy().tolist() for c in (cells, cells.select("map_id", "row", "col")))
    assert a == b and a


def test_rounds_are_joined_by_sorting(spark):
    a, b = (cut(spark.range(100)) for _ in range(2))
    assert "BroadcastExchange" not in a.join(b, "id")._jdf.queryExecution().executedPlan().toString()


def test_cells_are_laid_out_by_as_many_tasks_as_maps_need(spark):
    from waymark.sources import maps

    walls = spark.createDataFrame([(i, i % 48, i % 64) for i in range(300)], "map_id long, row int, col int")
    cells = maps.cells_from(walls)
    assert cells.select(F.spark_partition_id()).distinct().count() == 3
    assert cells.filter("value = 0").count() == 300 and cells.count() == 300 * 48 * 64


def test_points_and_cells_of_nearest_nodes_are_joined_by_sorting(spark):
    for query in (q.nearest_node, q.nearest_node_id):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in next(x for x in plan.splitlines() if "Join" in x)


def test_grid_graphs_meet_no_exchange_after_their_maps_are_dealt(spark):
    """However many maps there are, a task holds the grids of those dealt to it."""
    for df in q._grid(spark, SF):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_lines_meet_obstacles_without_rows_for_cells(spark):
    from waymark.operators import packed
    from waymark.operators.kernels import line

    walls = [(m, r, c) for m in (1, 2) for r in range(9) for c in range(9) if (r * 7 + c * 5 + m) % 11 == 0]
    lines = [(m, i, j, 8 - j, (i * j) % 9) for m in (1, 2, 3) for i in range(9) for j in range(9)]
    got = packed.meets(spark.createDataFrame(lines, "map_id long, r0 int, c0 int, r1 int, c1 int"), spark.createDataFrame(walls, "map_id long, row int, col int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "BroadcastExchange" not in plan
    want = {x: any((x[0], int(r), int(c)) in walls for r, c in zip(*line(*x[1:]), strict=True)) for x in lines}
    assert {tuple(r)[:5]: r["hit"] for r in got.collect()} == want and len(set(want.values())) == 2


def joins(df):
    """The joins of the plan as it was run."""
    df.collect()
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in x]


def test_reports_and_regions_are_joined_by_sorting_when_run(spark):
    """Sizes found out while running don't turn a join into one through the driver either."""
    from waymark.operators import evaluate, merging, shapes

    nodes, edges = (cut(spark.createDataFrame(x, y)) for x, y in (([(1, i, i, 2) for i in range(4)], "map_id long, node_id int, row int, col int"), ([(1, 0, 1, 1.0)], "map_id long, src int, dst int, weight double")))
    blocked = cut(spark.createDataFrame([(1, r, c, r == 3) for r in range(5) for c in range(5)], "map_id long, row int, col int, blocked boolean"))
    free = shapes.packed(blocked.select("map_id", "row", "col", (~F.col("blocked")).alias("free")), 4)
    lines = spark.createDataFrame([(1, 0, 1, 0, 0, 4, 4), (1, 0, 2, 0, 0, 1, 1)], "map_id long, pa long, pb long, r0 int, c0 int, r1 int, c1 int")
    left = lines.join(merging.blocked_lines(lines, free, 4), merging.PAIR, "left_anti")
    for df in (evaluate.report(nodes, edges, blocked), evaluate.coverage(blocked.select("map_id", "row", "col", F.lit(255).alias("value")), nodes, size=4), left):
        found = joins(df)
        assert found and not [x for x in found if "Broadcast" in x]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    return plan.count("Exchange"), plan.count("REPARTITION_BY_NUM")


@pytest.mark.parametrize("name", ["geojson_geometry", "geojson_features"])
def test_features_meet_no_exchange_after_their_maps_are_dealt(spark, name):
    """A task holds the features of the maps dealt to it, however many there are: an edge's ends are no join."""
    every, dealt = exchanges(q.queries()[name](spark, SF))
    assert every == dealt


def test_edges_without_known_ends_are_no_features(spark):
    from waymark.sources import codecs

    nodes = spark.createDataFrame([(1, 3, 1, 2), (1, 5, 3, 4), (2, 0, 7, 7), (3, 1, 0, 0)], "map_id long, node_id int, row int, col int")
    edges = spark.createDataFrame([(1, 3, 5, 1.0), (1, 3, 9, 1.0), (1, 9, 5, 1.0), (1, 5, 3, 1.0), (2, 8, 9, 1.0), (4, 1, 2, 1.0)], "map_id long, src int, dst int, weight double")
    got = {tuple(r) for r in codecs.geojson_rows(codecs.to_geojson(nodes, edges)).collect()}
    a, b = (2.0, -1.0), (4.0, -3.0)
    points = {(1, 3, *a), (1, 5, *b), (2, 0, 7.0, -7.0), (3, 1, 0.0, 0.0)}
    lines = {(1, 2, 3, 5, *a, *b), (1, 3, 5, 3, *b, *a), (1, 4, 5, 3, *b, *a), (1, 5, 3, 5, *a, *b)}
    assert got == {(m, i, "Point", -1, -1, "map", x, y, x, y) for m, i, x, y in points} | {(m, i, "MultiLineString", s, e, "", *p) for m, i, s, e, *p in lines}


def test_clustering_meets_no_exchange_after_its_maps_are_dealt(spark):
    every, dealt = exchanges(q.clustering(spark, SF.replace("0.001", "0.1")))  # enough maps for several tasks; planned, not run
    assert every == dealt
