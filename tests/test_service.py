"""Images, uploads, forms, the service over HTTP, command lines, robot state and answers with points."""

import json
import math
import os
import struct
import threading
import zlib

import numpy as np
import pytest

from waymark import cli, rest
from waymark.manager import Colour, MapManager, Service, read_form
from waymark.operators import build, evaluate, kernels
from waymark.sources import codecs, images
from waymark.streaming import routes


def png(rows: bytes, w: int, h: int, depth: int, colour: int, palette: bytes = b"") -> bytes:
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_kinds():
    assert images.grayscale(png(bytes([0, 0b10100000]), 3, 1, 1, 0)).tolist() == [[255, 0, 255]]
    assert images.grayscale(png(bytes([0, 0b00011011]), 4, 1, 2, 0)).tolist() == [[0, 85, 170, 255]]
    assert images.rgb(png(bytes([0, 0b10000000]), 2, 1, 1, 3, bytes([1, 2, 3, 9, 8, 7]))).tolist() == [[[9, 8, 7], [1, 2, 3]]]
    wide = png(bytes([0, 0x12, 0x34]), 1, 1, 16, 0)
    assert images.grayscale(wide).tolist() == [[0x12]]
    with pytest.raises(ValueError, match="8-bit"):
        images.decode_grayscale(wide)
    for bad in (b"", None):
        with pytest.raises(ValueError, match="Empty"):
            images.decode_grayscale(bad)
    with pytest.raises(ValueError, match="Invalid"):
        images.decode_grayscale(b"\x89PNG\r\n\x1a\nxx")
    assert images.grayscale(b"nothing") is None and images.rgb(b"nothing") is None
    assert images.grayscale(b"P5 # a\n2 1\n255\n\x07\x08").tolist() == [[7, 8]]
    assert images.rgb(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (5, 7, 3), (5, 7, 4)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert (codecs.decode_png(codecs.encode_png(a)).reshape(shape) == a).all()
    raw = rng.integers(0, 256, (4, 6)).astype(np.uint8)  # filters up, sub, average and Paeth undone by plain loops
    for f in range(5):
        want = np.zeros((4, 6), int)
        for r in range(4):
            for i in range(6):
                a, b, c = (want[r, i - 3] if i > 2 else 0), (want[r - 1, i] if r else 0), (want[r - 1, i - 3] if r and i > 2 else 0)
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                want[r, i] = (int(raw[r, i]) + int((0, a, b, (a + b) // 2, paeth)[f])) % 256
        assert (codecs.png_rows(np.c_[np.full(4, f, np.uint8), raw].tobytes(), 4, 6, 3) == want).all()


def test_images_from_files(spark, tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert images.write_image(str(tmp_path / "a.png"), a) and not images.write_image(str(tmp_path / "b.png"), np.zeros((2, 2, 5)))
    assert not images.write_image(str(tmp_path / "none" / "a.png"), a)
    (tmp_path / "broken.png").write_bytes(b"no image")
    found = images.read_grayscale(spark, str(tmp_path / "*.png"))
    got = {os.path.basename(r["path"]): r for r in found.collect()}
    assert got["a.png"]["pixels"] == a.tobytes() and (got["a.png"]["height"], got["a.png"]["width"]) == (3, 4)
    assert got["broken.png"]["pixels"] is None and got["broken.png"]["height"] is None
    assert sorted((r["row"], r["col"], r["value"]) for r in images.raster_cells(found).collect()) == [(i // 4, i % 4, i) for i in range(12)]
    colour = images.read_rgb(spark, str(tmp_path / "a.png")).first()
    assert colour["channels"] == 3 and colour["pixels"][:3] == bytes(3)


def test_uploads_and_uris():
    assert images.from_upload(b"x", "image/png", None) == b"x" and images.from_upload(b"x", "text/plain", "a.png") == b"x"
    for kind, name in (("text/plain", "a.txt"), (None, None), ("", "")):
        with pytest.raises(images.BadRequest, match="image file"):
            images.from_upload(b"x", kind, name)
    assert images.from_uri("http://h/a", lambda u: (b"y", "image/png; q")) == b"y" and images.from_uri("http://h/a.png", lambda u: (b"y", "")) == b"y"
    with pytest.raises(images.BadRequest, match="image file"):
        images.from_uri("http://h/a.png", lambda u: (b"y", "text/html"))
    with pytest.raises(images.BadRequest, match="Failed to load"):
        images.from_uri("nowhere:/x")
    assert images.load((b"f", "image/png", None), "http://h/a") == b"f"
    with pytest.raises(images.BadRequest, match="not provided"):
        images.load(None, "")
    with pytest.raises(images.BadRequest, match="threshold"):
        images.decode_map(b"x", None)


def test_forms_and_colours():
    good = {"map_id": "m", "safety_distance": "0.3", "resolution": "0.05", "occupancy_threshold": "127"}
    assert read_form(good)["x_offset"] == 0.0
    s = Service()
    for change in ({"map_id": ""}, {"safety_distance": "0"}, {"resolution": "-1"}, {"occupancy_threshold": "256"}, {"occupancy_threshold": "x"}, {"x_offset": "nan"}, {"resolution": ""}):
        assert s.generate_form(good | change, (b"x", "image/png", "a.png"))[0] == 422
    assert s.generate_form(good | {"map_id": "  "}, (b"x", "image/png", "a.png"))[0] == 400
    assert s.generate_form(good)[0] == 400 and s.generate_form(good, (b"", "image/png", None))[1]["detail"] == "Empty image."
    assert Colour(1, 2, 255).to_tuple() == (1, 2, 255)
    with pytest.raises(ValueError, match="Green"):
        Colour(0, 256, 0)


def free_png(n=80):
    return codecs.encode_png(np.full((n, n), 255, np.uint8))


def test_service_over_http(tmp_path):
    (tmp_path / "waymark_graph_old.png").write_bytes(b"x")
    s = rest.server("127.0.0.1", 0, str(tmp_path))
    assert not os.listdir(tmp_path)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        c = rest.Client(f"http://127.0.0.1:{s.server_address[1]}")
        assert c.health() == (200, {"status": "running", "errors": {}})
        fields = {"map_id": " m ", "safety_distance": 0.3, "resolution": 0.05, "occupancy_threshold": 127}
        status, graph = c.generate(free_png(), **fields)
        assert status == 201 and len(graph["nodes"]) > 3 and c.graph("m") == (200, graph)
        assert c.graph("x")[0] == 404 and c.visualize("x")[0] == 404 and c.nearest_nodes("x", [(1, 1)])[0] == 404
        status, picture = c.visualize("m")
        assert status == 200 and picture == (tmp_path / "waymark_graph_m.png").read_bytes()
        assert c.nearest_nodes("m", [(1.0, 2.0), (-9.0, 0.0)])[1][1] is None
        x, y, _ = graph["nodes"][0]
        status, way = c.route("m", (x, y), (x + 0.5, y - 0.5))
        assert status == 200 and way[0] == {"x": x, "y": y, "z": 0.0}
        assert c.generate(free_png(), **(fields | {"resolution": 0}))[0] == 422 and c._call("/nothing")[0] == 404
        assert c._call("/graph/route", b"{}")[0] == 422
        c.generate(free_png(90), **fields)
        assert not (tmp_path / "waymark_graph_m.png").exists()
    finally:
        s.shutdown()
        s.server_close()
    assert rest.log_level("Debug") == 10
    with pytest.raises(ValueError, match="unknown"):
        rest.log_level("loud")


def test_pictures_of_manager(tmp_path):
    m = MapManager(folder=str(tmp_path))
    assert not m.draw("a")
    m.create("a", np.full((60, 60), 255, np.uint8), 0.05, 0.2)
    assert m.draw("a") and m.draw("a") and os.path.exists(m.picture_path("a"))
    m.clear()
    assert not os.listdir(tmp_path)
    m.create("a/../b", np.full((60, 60), 255, np.uint8), 0.05, 0.2)
    assert m.draw("a/../b") and len(os.listdir(tmp_path)) == 1 and m.remove("a/../b") and not m.remove("a/../b")


def test_command_lines(spark, tmp_path, capsys):
    image = np.full((60, 70), 255, np.uint8)
    image[20:40, 30:40] = 0
    images.write_image(str(tmp_path / "m.png"), image)
    out = tmp_path / "out"
    assert cli.main(["generate", str(tmp_path / "m.png"), "--safety-distance", "0.15", "--output-dir", str(out), "--graph-eval", "--num-path-samples", "20", "--perf-eval", "--num-query-samples", "5"]) == 0
    first = json.loads((out / "evaluation_metrics.json").read_text())
    assert set(first) == {"coverage", "graph_structure", "path_planning", "validation"} and first["graph_structure"]["num_nodes"] > 0
    assert set(json.loads((out / "performance_metrics.json").read_text())) == {"total_time", "peak_memory_mb", "component_breakdown", "query_performance"}
    assert images.grayscale((out / "waypoint_graph.png").read_bytes()).shape == image.shape
    again = tmp_path / "again"
    assert cli.main(["evaluate", str(out / "graph.gml"), str(tmp_path / "m.png"), str(again), "--resolution", "0.05", "--safety-distance", "0.15", "--occupancy-threshold", "127"]) == 0
    second = json.loads((again / "evaluation_metrics.json").read_text())
    assert second["graph_structure"]["num_edges"] == first["graph_structure"]["num_edges"] and second["coverage"]["free_space_coverage"] == first["coverage"]["free_space_coverage"]
    assert cli.main(["geojson", str(out / "graph.gml")]) == 0
    features = json.loads((out / "graph.geojson").read_text())["features"]
    assert len(features) == first["graph_structure"]["num_nodes"] + 2 * first["graph_structure"]["num_edges"]
    assert cli.main(["geojson", str(tmp_path / "none.gml")]) == 1
    with pytest.raises(Exception, match="."):
        cli.main(["generate", str(tmp_path / "none.png"), "--output-dir", str(out)])


def test_grid_step_is_that_of_free_space():
    config = kernels.Config(skeleton_distance=1.0, boundary_distance=2.0, free_distance=1.5)
    graph, _ = kernels.build(np.full((200, 200), 255, np.uint8), 0.05, 0.3, config=config)
    assert len(graph.nodes) == 49 and (6, 36) in graph.nodes


def test_boundary_points_on_blocked_cells_stay():
    image = np.full((60, 60), 255, np.uint8)
    image[25:35, 25:35] = 0
    config = kernels.Config(use_skeleton=False, use_free=False, use_delaunay=False, prune=False, boundary_distance=0.5)
    graph, blocked = kernels.build(image, 0.05, 0.3, config=config)
    wide = kernels.Config(use_skeleton=False, use_free=False, use_delaunay=False, prune=False, boundary_distance=0.5, boundary_inflation=1.01)
    edges = [(p, q) for p in graph.nodes for q in graph.near[p]]
    assert edges and all(not kernels.collides(blocked, p, q) for p, q in edges)
    assert all(t == "boundary" for t in kernels.build(image, 0.05, 0.3, config=wide)[0].nodes.values())


def test_distances_by_growing_columns():
    rng = np.random.default_rng(4)
    for h, w, p in ((9, 13, 0.2), (20, 7, 0.02), (1, 30, 0.1), (12, 12, 0.0)):
        free = rng.random((h, w)) >= p
        got, walls = kernels.squared_distance(free), np.argwhere(~free)
        for r in range(h):
            for c in range(w):
                if len(walls):
                    assert got[r, c] == ((walls - (r, c)) ** 2).sum(axis=1).min()


def test_distances_by_size(spark):
    from waymark.operators import raster

    rng = np.random.default_rng(9)
    cells = spark.createDataFrame([(m, r, c, int(rng.integers(0, 5) and 255)) for m in range(3) for r in range(7 + m) for c in range(9)], "map_id long, row int, col int, value int")
    key = lambda df: sorted(map(tuple, df.collect()))
    for ring in (True, False):
        assert key(raster.distance(cells, ring=ring)) == key(raster.distance(cells, ring=ring, most=10))


def test_empty_graphs_have_rows(spark):
    cells = spark.createDataFrame([(m, r, c, 255 if (r, c) != (0, 0) else 0) for m in (1, 2) for r in range(6) for c in range(6)], "map_id long, row int, col int, value int")
    nodes = spark.createDataFrame([(1, 0, 3, 3), (1, 1, 3, 5)], "map_id long, node_id int, row int, col int")
    edges = spark.createDataFrame([(1, 0, 1, 0.1)], "map_id long, src int, dst int, weight double")
    got = {}
    for r in evaluate.evaluate_all(cells, nodes, edges, safety=0.05, resolution=0.05, samples=5).collect():
        got.setdefault(r["map_id"], {})[r["metric"]] = r["value"]
    assert got[1]["num_nodes"] == 2 and got[1]["path_success_rate"] == 1.0 and got[1]["free_space_coverage"] == 1.0
    assert {k: got[2][k] for k in ("num_nodes", "num_edges", "average_degree", "average_edge_length", "graph_diameter", "average_clustering", "path_success_rate", "num_subgraphs", "free_space_coverage")} == dict.fromkeys(("num_nodes", "num_edges", "average_degree", "average_edge_length", "graph_diameter", "average_clustering", "path_success_rate", "num_subgraphs", "free_space_coverage"), 0.0)
    assert got[2]["node_validity"] == got[2]["connectivity"] == got[2]["edge_length_validity"] == 1.0
    with pytest.raises(Exception, match="outside the map"):
        evaluate.coverage(cells, nodes.withColumn("col", nodes["col"] - 9)).collect()


def test_heading_counts_and_odometry_sets_speed(spark, tmp_path):
    rows = [(1, 1.0, "goal", 0.0, 0.0, 1.0, None), (1, 2.0, "pose", 0.0, 0.0, -1.0, None), (1, 3.0, "odometry", 0.0, 0.0, 0.5, 0.7), (1, 4.0, "pose", 0.0, 0.0, 1.0, None), (2, 5.0, "odometry", 3.0, 4.0, 0.0, 0.2), (2, 4.0, "pose", 1.0, 1.0, 0.0, None)]
    spark.createDataFrame(rows, routes.EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(routes.EVENT).parquet(str(tmp_path / "in"))
    # events of one batch are taken in the order of their time
    query = routes.navigate(stream).writeStream.format("memory").queryName("robots").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r["robot"], r["ts"], r["mode"], r["distance"], r["speed"]) for r in spark.table("robots").orderBy("robot", "ts").collect()]
    assert got[:3] == [(1, 1.0, "wait", None, 0.0), (1, 2.0, "drive", 2.0, 0.0), (1, 3.0, "reached", 0.5, 0.7)]
    assert got[3] == (1, 4.0, "wait", None, 0.7) and got[4][2] == "wait" and got[5][4] == 0.2


def test_answers_with_points(spark, tmp_path):
    image = np.full((60, 60), 255, np.uint8)
    image[25:35, 20:40] = 0
    cells = spark.createDataFrame([(1, r, c, int(image[r, c])) for r in range(60) for c in range(60)], "map_id long, row int, col int, value int")
    built = build.build_graphs(cells, resolution=0.05, safety=0.1, x_offset=1.0, y_offset=-2.0, rotation=0.2).cache()
    nodes, edges = build.nodes_of(built), build.edges_of(built)
    blocked = spark.createDataFrame([(1, r, c, bool(v)) for (r, c), v in np.ndenumerate(kernels.build(image, 0.05, 0.1)[1])], "map_id long, row int, col int, blocked boolean")
    frames = spark.createDataFrame([(1, 60, 0.05, 1.0, -2.0, 0.2)], "map_id long, height int, resolution double, x_offset double, y_offset double, rotation double")
    at = lambda r, c: build.world(r, c, 60, 0.05, 1.0, -2.0, 0.2)
    asked = [(1, 1, *at(10, 10), *at(50, 50)), (2, 1, *at(30, 30), *at(50, 50)), (3, 9, 0.0, 0.0, 1.0, 1.0)]
    requests = spark.createDataFrame(asked, routes.POINTS_REQUEST)
    got = {r["route_id"]: r for r in routes.answer_points(requests, blocked, nodes, edges, frames).collect()}
    assert [got[i]["success"] for i in (1, 2, 3)] == [True, False, False] and got[2]["path"] is None
    path = [(p["x"], p["y"]) for p in got[1]["path"]]
    assert path[0] == pytest.approx(at(10, 10)) and path[-1] == pytest.approx(at(50, 50)) and len(path) > 2
    places = {(round(r["x"], 6), round(r["y"], 6)) for r in nodes.collect()}
    assert all((round(x, 6), round(y, 6)) in places for x, y in path[1:-1])
    assert got[1]["message"] != got[2]["message"]
    requests.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(routes.POINTS_REQUEST).parquet(str(tmp_path / "in"))
    routes.serve_points(stream, blocked, nodes, edges, frames, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert {r["route_id"]: r["success"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: True, 2: False, 3: False}
    marks = {r["kind"]: r["points"] for r in routes.markers(nodes, edges).collect()}
    assert len(marks["points"]) == nodes.count() and len(marks["lines"]) == 2 * edges.count()


def test_robot_frame_and_parameters(spark):
    goals = spark.createDataFrame([(1, 1.0, 1.0, math.pi / 2, 1.0, 4.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0)], "robot long, x double, y double, heading double, goal_x double, goal_y double")
    got = {r["robot"]: [(round(p["x"], 6), round(p["y"], 6)) for p in r["points"]] for r in routes.mapless_paths(goals).collect()}
    assert got[1] == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)] and got[2] == [(0.0, 0.0), (0.0, 0.0)]
    paths = spark.createDataFrame([(1, [(1.0, 2.0)], 1.0, 1.0, math.pi / 2)], "route_id long, points array<struct<x:double,y:double>>, x double, y double, heading double")
    assert [(round(p["x"], 6), round(p["y"], 6)) for p in routes.robot_paths(paths).first()["points"]] == [(1.0, 0.0)]
    modes = spark.createDataFrame([(None, True), (1.0, True), (1.0, False)], "goal_x double, mapless boolean")
    assert [r["mode"] for r in routes.dispatch(modes).collect()] == ["wait", "mapless", "map"]
    assert routes.Parameters.from_settings({"mapless": True}).tick_hz == 10.0
    with pytest.raises(ValueError, match="unknown"):
        routes.Parameters.from_settings({"x": 1})
    asked = spark.createDataFrame([("map", "map", None), ("odom", "map", False), ("map", "map", True)], "start_frame string, goal_frame string, cancelled boolean")
    assert routes.in_frame(asked).count() == 1
