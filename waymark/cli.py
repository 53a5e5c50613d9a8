"""Command lines: generate (image to graph), evaluate (graph and image to metrics), geojson (GML to GeoJSON).

    python -m waymark.cli generate map.png --resolution 0.05 --safety-distance 0.3 --output-dir graphs --graph-eval
    python -m waymark.cli evaluate graphs/graph.gml map.png graphs --resolution 0.05 --safety-distance 0.3 --occupancy-threshold 127
    python -m waymark.cli geojson graphs/graph.gml -o graph.geojson
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manager import MapManager
from .measure import Sections, write_json
from .operators import build, evaluate
from .sources import codecs, images


def _session() -> SparkSession:
    return SparkSession.builder.appName("waymark").getOrCreate()


def _cells(spark: SparkSession, path: str) -> DataFrame:
    """cells(map_id, row, col, value) of one image, map_id 0."""
    found = images.read_grayscale(spark, path)
    if found.filter("pixels IS NOT NULL").isEmpty():
        raise RuntimeError(f"Failed to read map file: {path}")
    return images.raster_cells(found).select(F.lit(0).cast("long").alias("map_id"), "row", "col", "value").cache()


def metrics(cells: DataFrame, nodes: DataFrame, edges: DataFrame, a: argparse.Namespace, samples: int = 1000) -> dict[str, dict[str, float]]:
    """Nested metrics of one map by category."""
    rows = evaluate.evaluate_all(cells, nodes, edges, safety=a.safety_distance, resolution=a.resolution, threshold=a.occupancy_threshold, samples=samples).collect()
    out: dict[str, dict[str, float]] = {}
    for r in sorted(rows, key=lambda r: (r["category"], r["metric"])):
        out.setdefault(r["category"], {})[r["metric"]] = r["value"]
    return out


def summary(results: dict[str, dict[str, float]]) -> str:
    return "\n".join(line for category, values in results.items() for line in (f"{category}:", *(f"  {k}: {v if v is None else round(v, 4)}" for k, v in values.items())))


def generate(a: argparse.Namespace) -> int:
    spark, times = _session(), Sections()
    os.makedirs(a.output_dir, exist_ok=True)
    with times.section("load_map"):
        cells = _cells(spark, a.map_path)
    with times.section("build_graph"):
        built = build.build_graphs(cells, resolution=a.resolution, safety=a.safety_distance, threshold=a.occupancy_threshold, x_offset=a.x_offset, y_offset=a.y_offset, rotation=a.rotation).cache()
        failed = built.filter("kind = 'error'").first()
    if failed:
        raise RuntimeError(failed["edge_type"])
    nodes, edges = build.nodes_of(built), build.edges_of(built)
    with times.section("save_graph"):
        text = codecs.to_gml(nodes, edges).first()
        with open(os.path.join(a.output_dir, "graph.gml"), "w") as f:
            f.write(text["content"] if text else "graph [\n]\n")
    with times.section("visualize_graph"):
        with open(a.map_path, "rb") as f:
            image = images.grayscale(f.read())
        manager = MapManager()
        manager.create("map", image, a.resolution, a.safety_distance, threshold=a.occupancy_threshold, x_offset=a.x_offset, y_offset=a.y_offset, rotation=a.rotation)
        if not images.write_image(os.path.join(a.output_dir, "waypoint_graph.png"), manager.overlay("map")):
            raise RuntimeError("the picture can't be written")
    if a.graph_eval:
        with times.section("evaluate_graph"):
            results = metrics(cells, nodes, edges, a, a.num_path_samples)
        print(summary(results))
        write_json(results, os.path.join(a.output_dir, "evaluation_metrics.json"))
    if a.perf_eval:
        h, w = image.shape
        times.time_queries(lambda x, y: manager.nearest("map", [(x, y)]), w * a.resolution, h * a.resolution, a.num_query_samples)
        write_json(times.results(), os.path.join(a.output_dir, "performance_metrics.json"))
    return 0


def evaluate_graph(a: argparse.Namespace) -> int:
    spark = _session()
    files = spark.read.text(a.graph_path, wholetext=True).select(F.lit(0).cast("long").alias("map_id"), F.col("value").alias("content"))
    nodes, edges = codecs.parse_gml_nodes(files), codecs.parse_gml_edges(files)
    results = metrics(_cells(spark, a.map_path), nodes, edges, a)
    print(summary(results))
    os.makedirs(a.output_dir, exist_ok=True)
    write_json(results, os.path.join(a.output_dir, "evaluation_metrics.json"))
    return 0


def geojson(a: argparse.Namespace) -> int:
    """1 if anything fails, and says what."""
    target = a.output or a.input_file.rsplit(".", 1)[0] + ".geojson"
    try:
        spark = _session()
        files = spark.read.text(a.input_file, wholetext=True).select(F.lit(0).cast("long").alias("map_id"), F.col("value").alias("content"))
        text = codecs.feature_collection(codecs.to_geojson(codecs.parse_gml_nodes(files), codecs.parse_gml_edges(files))).first()
        with open(target, "w") as f:
            f.write(text["content"] if text else codecs.empty_collection())
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="waymark", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(dest="command", required=True)

    def map_options(c: argparse.ArgumentParser, required: bool) -> None:
        for name, value in (("resolution", 0.05), ("safety-distance", 0.3)):
            c.add_argument(f"--{name}", type=float, required=required, default=None if required else value)
        c.add_argument("--occupancy-threshold", type=int, required=required, default=None if required else 127)
        for name in ("x-offset", "y-offset", "rotation"):
            c.add_argument(f"--{name}", type=float, default=0.0)

    g = commands.add_parser("generate", help="an image to a graph")
    g.add_argument("map_path")
    map_options(g, False)
    g.add_argument("--output-dir", default="graphs")
    g.add_argument("--graph-eval", action="store_true")
    g.add_argument("--num-path-samples", type=int, default=1000)
    g.add_argument("--perf-eval", action="store_true")
    g.add_argument("--num-query-samples", type=int, default=100)
    g.set_defaults(run=generate)
    e = commands.add_parser("evaluate", help="a graph on its image")
    for name in ("graph_path", "map_path", "output_dir"):
        e.add_argument(name)
    map_options(e, True)
    e.set_defaults(run=evaluate_graph)
    j = commands.add_parser("geojson", help="GML to GeoJSON")
    j.add_argument("input_file")
    j.add_argument("-o", "--output")
    j.set_defaults(run=geojson)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    raise SystemExit(main())
