"""Details that must equal what users of the formats and parameters expect."""

import json

import numpy as np
import pytest

from waymark.operators import kernels
from waymark.sources import codecs, images
from waymark.streaming import routes


def test_truncated_images_are_none():
    whole = codecs.encode_png(np.arange(60, dtype=np.uint8).reshape(6, 10))
    assert (images.grayscale(whole) == np.arange(60).reshape(6, 10)).all()
    for n in range(len(whole) - 12):
        assert images.grayscale(whole[:n]) is None and images.rgb(whole[:n]) is None, n
    with pytest.raises(ValueError, match="Invalid image"):
        images.decode_grayscale(whole[:20])


def test_merging_goes_by_whole_pixels(monkeypatch):
    seen = []
    monkeypatch.setattr(kernels, "merge_close", lambda graph, blocked, radius: seen.append(radius))
    image = np.full((40, 40), 255, np.uint8)
    image[18:22, 18:22] = 0
    kernels.build(image, 0.02, 0.04, config=kernels.OFFICE)  # 0.15 m are 7.5 pixels
    assert seen == [8]


def test_geojson_members(spark):
    nodes = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 5, 2)], "map_id long, node_id int, row int, col int")
    edges = spark.createDataFrame([(0, 0, 1, 4.0)], "map_id long, src int, dst int, weight double")
    got = json.loads(codecs.feature_collection(codecs.to_geojson(nodes, edges)).first()["content"])
    assert list(got) == ["type", "name", "crs", "date_generated", "features"] and got["name"] == "graph" and got["date_generated"]
    assert [f["properties"] for f in got["features"]] == [{"id": 0, "frame": "map"}, {"id": 1, "frame": "map"}, {"id": 2, "startid": 0, "endid": 1}, {"id": 3, "startid": 1, "endid": 0}]
    assert json.loads(codecs.empty_collection())["features"] == []


@pytest.mark.parametrize("order", [(1.0, 0.05), (0.05, 1.0)])
def test_shortcuts_are_measured_in_the_world(spark, order):
    """Two maps of different resolutions in one call: each request by its own distance in metres."""
    size = 20
    blocked = spark.range(size * size).selectExpr("cast(id div 20 as int) row", "cast(id % 20 as int) col", "false blocked").crossJoin(spark.createDataFrame([(0,), (1,)], "map_id long"))
    nodes = spark.createDataFrame([(m, 0, 10, 10) for m in (0, 1)], "map_id long, node_id int, row int, col int")
    edges = spark.createDataFrame([], "map_id long, src int, dst int, weight double")
    frames = spark.createDataFrame([(m, size, r, 0.0, 0.0, 0.0) for m, r in enumerate(order)], "map_id long, height int, resolution double, x_offset double, y_offset double, rotation double")
    asks = [(m, m, 5 * r, size * r - 5 * r, 15 * r, size * r - 5 * r) for m, r in enumerate(order)]  # ten pixels: 10 m and 0.5 m
    got = {r["route_id"]: len(r["path"]) for r in routes.answer_points(spark.createDataFrame(asks, routes.POINTS_REQUEST), blocked, nodes, edges, frames, shortcut=2.0).collect()}
    assert got == {m: 3 if r == 1.0 else 2 for m, r in enumerate(order)}


def test_rasters_stay_in_the_task_that_makes_them(spark):
    """Walls go in and cells come out: no raster goes back to Python in a batch of thousands of maps."""
    from waymark.operators import packed

    walls = spark.createDataFrame([(m, 5, 7, [m % 35, 34]) for m in range(600)], "map_id long, height int, width int, walls array<int>")
    for df in (packed.cells(walls), packed.maxima(walls, 1.0)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = packed.cells(walls)
    assert got.count() == 600 * 35 and got.filter("d2 = 0").count() == 600 * 2 - 17
    assert packed.distances(walls).count() == 600
