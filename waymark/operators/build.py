"""Graphs of many maps at once: a whole build takes a map whole, many maps to a task; single stages go over tiles too."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bulky
from . import sampling, shapes, stacks, tiles, whole
from .kernels import Config, Graph, branches, build, collides, contours, node_map, sample_free, shortest_path, simplify, thin

NODES = "map_id long, node_id int, row int, col int, x double, y double, z double, node_type string"
EDGES = "map_id long, src int, dst int, weight double, edge_type string"


def spread(df: DataFrame, *more: str) -> DataFrame:
    """By map, over enough partitions for all cores: maps are small in bytes and long in work, so no coalescing."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "map_id", *more)


def raster(pdf: pd.DataFrame) -> np.ndarray:
    image = np.zeros((pdf["row"].max() + 1, pdf["col"].max() + 1), np.uint8)
    image[pdf["row"], pdf["col"]] = pdf["value"]
    return image


def world(row: float, col: float, height: int, resolution: float, x_offset: float, y_offset: float, rotation: float) -> tuple[float, float]:
    """Pixel to world; a build shifts the y offset by the map's height."""
    x, y, c, s = col * resolution, -row * resolution, math.cos(rotation), math.sin(rotation)
    return x * c - y * s + x_offset, x * s + y * c + y_offset + height * resolution


def pixel(x: float, y: float, height: int, resolution: float, x_offset: float, y_offset: float, rotation: float) -> tuple[int, int]:
    dx, dy, c, s = x - x_offset, y - y_offset - height * resolution, math.cos(rotation), math.sin(rotation)
    return round(-(dy * c - dx * s) / resolution), round((dx * c + dy * s) / resolution)


def stack_graphs(free: np.ndarray, resolution: float, safety: float, cfg: Config) -> list[tuple[dict[int, dict[int, str]], dict[int, str | None]] | ValueError]:
    """The graph of each map of a stack as ``stacks.built`` gives it, or what a map can't be built for."""
    stride = 2 * free.shape[2]
    alone = free.all(axis=(1, 2)) | (max(free.shape[1:]) > stacks.TOO_WIDE)
    out: list = [None] * len(free)
    for k in np.flatnonzero(alone).tolist():
        try:
            graph, _ = build(free[k], resolution, safety, 0, cfg)
        except ValueError as e:
            out[k] = e
            continue
        name = {p: p[0] * stride + p[1] for p in graph.nodes}
        out[k] = {name[p]: {name[q]: kind for q, (_, kind) in graph.near[p].items()} for p in name}, {name[p]: kind for p, kind in graph.nodes.items()}
    rest = np.flatnonzero(~alone).tolist()
    for k, got in zip(rest, stacks.built(free[rest], resolution, safety, cfg) if rest else (), strict=True):
        out[k] = got
    return out


def build_graphs(cells: DataFrame, *, resolution: float = 0.05, safety: float = 0.1, threshold: int = 127, x_offset: float = 0.0, y_offset: float = 0.0, rotation: float = 0.0, config: Config | None = None) -> DataFrame:
    """kind ('node', 'edge', 'error'), and the columns of NODES and EDGES, of every map.

    A map that can't be built gives one error row, as other maps go on. cells(map_id, row, col, value), or packed maps (``whole.parted``).
    """
    cfg = config or Config()

    def one(map_id: int | None, height: int, stride: int, near: dict[int, dict[int, str]], kinds: dict[int, str | None]) -> list[tuple]:
        ids, rows, at = {p: i for i, p in enumerate(near)}, [], {p: divmod(p, stride) for p in near}
        for p, i in ids.items():
            x, y = world(*at[p], height, resolution, x_offset, y_offset, rotation)
            rows.append(("node", map_id, i, *at[p], x, y, 0.0, kinds[p], None, None, None, None))
        for p, i in ids.items():
            rows += [("edge", map_id, None, None, None, None, None, None, None, i, ids[q], math.dist(at[p], at[q]) * resolution, kind) for q, kind in near[p].items() if i < ids[q]]
        return rows

    def run(held: list, free: np.ndarray) -> pd.DataFrame:
        _, h, w = free.shape
        rows = []
        for t, got in zip(held, stack_graphs(free, resolution, safety, cfg), strict=True):
            rows += [("error", whole.name(t), *[None] * 10, str(got))] if isinstance(got, ValueError) else one(whole.name(t), h, 2 * w, *got)
        return pd.DataFrame(rows, columns=COLUMNS).astype({"map_id": "Int64"} | {c: "Int32" for c in ("node_id", "row", "col", "src", "dst")})

    rows, _, _ = whole.parted(_free(cells, threshold), GATHERED, 1 << 62, nulls=True)
    return whole.stacked(rows, GATHERED, run, "kind string, " + NODES + ", src int, dst int, weight double, edge_type string")


GATHERED = 64  # the tile's width in which a map's cells come to its task
COLUMNS = ["kind", "map_id", "node_id", "row", "col", "x", "y", "z", "node_type", "src", "dst", "weight", "edge_type"]


def nodes_of(built: DataFrame) -> DataFrame:
    return built.filter("kind = 'node'").select("map_id", "node_id", "row", "col", "x", "y", "z", "node_type")


def edges_of(built: DataFrame) -> DataFrame:
    return built.filter("kind = 'edge'").select("map_id", "src", "dst", "weight", "edge_type")


def node_maps(blocked: DataFrame, nodes: DataFrame) -> DataFrame:
    """map_id, row, col, label, hops: each cell's nearest node by steps; label -1 unreached, -2 blocked."""

    def run(key: tuple, b: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        mask = np.ones((b["row"].max() + 1, b["col"].max() + 1), bool) if len(b) else np.ones((0, 0), bool)
        mask[b["row"], b["col"]] = b["blocked"]
        n = n.sort_values("node_id")
        label, hops = node_map(mask, list(zip(n["row"].tolist(), n["col"].tolist(), strict=True)))
        r, c = np.indices(mask.shape)
        return pd.DataFrame({"map_id": key[0], "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "label": label.ravel(), "hops": hops.ravel()})

    a = spread(blocked.selectExpr("cast(map_id as long) map_id", "row", "col", "blocked")).groupBy("map_id")
    return a.cogroup(spread(nodes.selectExpr("cast(map_id as long) map_id", "node_id", "row", "col")).groupBy("map_id")).applyInPandas(run, "map_id long, row int, col int, label int, hops int")


def routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest routes for requests(route_id, map_id, start_id, goal_id): route_id, found, length, path of node ids."""
    both = requests.selectExpr("'r' k", "cast(map_id as long) map_id", "route_id a", "cast(start_id as long) b", "cast(goal_id as long) c", "0D w", "0D x")
    both = both.union(nodes.selectExpr("'n' k", "cast(map_id as long) map_id", "cast(node_id as long) a", "0L b", "0L c", "cast(row as double) w", "cast(col as double) x"))
    both = both.union(edges.selectExpr("'e' k", "cast(map_id as long) map_id", "cast(src as long) a", "cast(dst as long) b", "0L c", "weight w", "0D x"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, e, r = (pdf[pdf["k"] == k] for k in "ner")
        near: dict[int, dict[int, float]] = {}
        for a, b, w in zip(e["a"], e["b"], e["w"], strict=True):
            near.setdefault(a, {})[b] = w
            near.setdefault(b, {})[a] = w
        at = dict(zip(n["a"], zip(n["w"], n["x"], strict=True), strict=True))
        # the straight distance in the edges' unit, and never more than the edges say
        scale = min([near[a][b] / d for a in near for b in near[a] if (d := math.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]))], default=0.0) * (1 - 1e-12)
        at = {k: (p[0] * scale, p[1] * scale) for k, p in at.items()}
        out = []
        for route, a, b in zip(r["a"], r["b"], r["c"], strict=True):
            path = shortest_path(near, at, a, b) if a in at and b in at else None
            out.append((route, key[0], path is not None, sum(near[p][q] for p, q in zip(path, path[1:], strict=False)) if path else None, path))
        return pd.DataFrame(out, columns=["route_id", "map_id", "found", "length", "path"])

    return spread(both).groupBy("map_id").applyInPandas(run, "route_id long, map_id long, found boolean, length double, path array<long>")


def find_routes(requests: DataFrame, blocked: DataFrame, nodes: DataFrame, edges: DataFrame, *, shortcut: float, resolution: float = 0.05, part: int = 5_000) -> DataFrame:
    """Whole routes for requests(route_id, map_id, r0, c0, r1, c1) in pixels: route_id, found, reason, points.

    In order: ends that are blocked or outside have no route; a free straight line shorter than ``shortcut`` metres is
    the route (``requests`` may say so themselves, in a boolean column short); otherwise both ends go to their nearest nodes by free lines and the graph is searched. A map's requests
    are dealt to tasks of about ``part`` requests, each with a copy of the map, so a busy map doesn't end in one task;
    maps that nobody asks for are left out.
    """
    near = F.hypot(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) * resolution < shortcut
    near = F.col("short") if "short" in requests.columns else near
    asked = requests.select("route_id", F.col("map_id").cast("long").alias("map_id"), "r0", "c0", "r1", "c1", near.cast("double").alias("near"))
    parts = asked.groupBy("map_id").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    copies = parts.select("map_id", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))

    def copied(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumn("map_id", F.col("map_id").cast("long")).join(copies, "map_id").selectExpr("map_id", *columns, "part")

    both = copied(blocked, "'b' k", "cast(row as long) a", "cast(col as long) b", "cast(blocked as long) c", "0L d", "0L e", "0D w")
    both = both.union(copied(nodes, "'n'", "cast(node_id as long)", "cast(row as long)", "cast(col as long)", "0L", "0L", "0D"))
    both = both.union(copied(edges, "'e'", "cast(src as long)", "cast(dst as long)", "0L", "0L", "0L", "weight"))
    own = asked.join(parts, "map_id").withColumn("part", F.pmod(F.xxhash64("route_id"), F.col("parts")).cast("int"))
    none = asked.filter("map_id IS NULL").select("route_id", F.lit(False).alias("found"), F.lit("bad start").alias("reason"), F.lit(None).cast("array<struct<row:int,col:int>>").alias("points"))
    both = both.union(own.selectExpr("map_id", "'r'", "cast(route_id as long)", "cast(r0 as long)", "cast(c0 as long)", "cast(r1 as long)", "cast(c1 as long)", "near", "part"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells, n, e, r = (pdf[pdf["k"] == k] for k in "bner")
        h, w = (int(cells["a"].max()) + 1, int(cells["b"].max()) + 1) if len(cells) else (0, 0)
        mask = np.ones((h, w), bool)
        mask[cells["a"], cells["b"]] = cells["c"] != 0
        n = n.sort_values("a")
        names, at = n["a"].tolist(), dict(zip(n["a"].tolist(), zip(n["b"].tolist(), n["c"].tolist(), strict=True), strict=True))
        near: dict[int, dict[int, float]] = {}
        for a, b in zip(e["a"].tolist(), e["b"].tolist(), strict=True):
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = math.dist(at[a], at[b])
        label = node_map(mask, [at[x] for x in names])[0] if len(r) else mask

        def one(p: tuple[int, int], q: tuple[int, int], short: bool) -> tuple[str, list | None]:
            for end, what in ((p, "bad start"), (q, "bad goal")):
                if not (0 <= end[0] < h and 0 <= end[1] < w) or mask[end]:
                    return what, None
            if short and not collides(mask, p, q):
                return "straight", [p, q]
            if label[p] < 0 or label[q] < 0:
                return "no node", None
            a, z = names[label[p]], names[label[q]]
            if collides(mask, p, at[a]) or collides(mask, at[z], q):
                return "no node", None
            path = shortest_path(near, at, a, z)
            return ("search", [p, *(at[x] for x in path), q]) if path else ("no way", None)

        rows = []
        for route, r0, c0, r1, c1, short in zip(*(r[k].tolist() for k in "abcdew"), strict=True):
            reason, points = one((r0, c0), (r1, c1), short > 0)
            rows.append((route, points is not None, reason, [{"row": int(a), "col": int(b)} for a, b in points] if points else None))
        return pd.DataFrame(rows, columns=["route_id", "found", "reason", "points"])

    return spread(both, "part").groupBy("map_id", "part").applyInPandas(run, "route_id long, found boolean, reason string, points array<struct<row:int,col:int>>").union(none)


def _free(cells: DataFrame, threshold: int = 127) -> DataFrame:
    return cells if "walls" in cells.columns else cells.select("map_id", "row", "col", (F.col("value") > threshold).alias("free"))


def _clear(tiled: DataFrame, least: float, size: int) -> DataFrame:
    return shapes.clear(tiles.tile_distances(tiled, size, ring=True), least)


def _both(small: DataFrame, large: DataFrame | None, over: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of the maps that went whole, and those of the others over tiles."""
    return small if large is None else small.unionByName(over(large))


def thinned(free: DataFrame, *, least: float, size: int = tiles.SIZE, whole_maps: int | None = None) -> DataFrame:
    """map_id, row, col: the skeletons of what lies ``least`` or more cells from an obstacle in free(map_id, row, col, free)."""
    rows, large, _ = whole.parted(free, size, whole_maps)
    small = whole.stacked(rows, size, lambda held, f: whole.cells_of(held, thin(whole.clear(f, least))), "map_id long, row int, col int")
    return _both(small, large, lambda t: shapes.state_cells(shapes.thinned(_clear(t, least, size), size), size))


def contour_points(free: DataFrame, *, least: float, size: int = tiles.SIZE, whole_maps: int | None = None) -> DataFrame:
    """map_id, ring, i, row, col: every point of the closed lines around what lies ``least`` or more cells from an obstacle."""
    rows, large, _ = whole.parted(free, size, whole_maps)
    make = lambda held, f: whole.lines_of(held, [contours(m) for m in whole.clear(f, least)], "ring", float)
    return _both(whole.stacked(rows, size, make, "map_id long, ring int, i int, row double, col double"), large, lambda t: shapes.ring_points(_clear(t, least, size), size))


def skeletons(cells: DataFrame, *, safety: float, resolution: float, size: int = tiles.SIZE, whole_maps: int | None = None) -> DataFrame:
    """map_id, branch, i, row, col: the branches of each map's skeleton, pixel by pixel."""
    least = safety / resolution
    rows, large, _ = whole.parted(_free(cells), size, whole_maps)
    make = lambda held, f: whole.lines_of(held, [branches(m) for m in thin(whole.clear(f, least))], "branch", np.int32)
    return _both(whole.stacked(rows, size, make, "map_id long, branch int, i int, row int, col int"), large, lambda t: shapes.branches(shapes.thinned(_clear(t, least, size), size), size))


def boundaries(cells: DataFrame, *, safety: float, resolution: float, inflation: float = 1.5, tolerance: float = 0.6, size: int = tiles.SIZE, whole_maps: int | None = None) -> DataFrame:
    """map_id, ring, i, row, col: vertices of the simplified contours around obstacles, in map pixels."""
    least = safety * inflation / resolution
    rows, large, shape = whole.parted(_free(cells), size, whole_maps)

    def make(held: list, f: np.ndarray) -> pd.DataFrame:
        top = (f.shape[1] - 1, f.shape[2] - 1)
        return whole.lines_of(held, [[np.clip(simplify(ring, tolerance), 0, top) for ring in contours(m)] for m in whole.clear(f, least)], "ring", float)

    return _both(whole.stacked(rows, size, make, "map_id long, ring int, i int, row double, col double"), large, lambda t: shapes.rings(_clear(t, least, size), shape, tolerance, size))


def nearest_nodes(free: DataFrame, nodes: DataFrame, size: int = tiles.SIZE, whole_maps: int | None = None) -> DataFrame:
    """``tiles.nearest_nodes`` of free(map_id, row, col, free) or packed maps, small maps whole."""
    rows, large, sized = whole.parted(free, size, whole_maps, nulls=True)
    at = nodes.select(F.col("map_id").cast("long").alias("map_id"), F.col("node_id").cast("int").alias("node_id"), "row", "col")
    seeds = at.groupBy("map_id", "row", "col").agg(F.min("node_id").alias("order"), F.max("node_id").alias("label"))
    # nodes outside their map reach nothing; they may be more than a map's cells
    seeds = seeds.join(bulky(sized.filter("few")), "map_id").filter("row BETWEEN 0 AND height - 1 AND col BETWEEN 0 AND width - 1")
    seeds = seeds.groupBy("map_id").agg(F.collect_list(F.struct("row", "col", "order", "label")).alias("seeds"))
    small = whole.stacked(rows.join(bulky(seeds), "map_id", "left"), size, whole.settled, "map_id long, row int, col int, label int, hops int")
    return _both(small, large, lambda t: tiles.tile_nearest(t, nodes, size))


def free_samples(cells: DataFrame, *, distance: int, size: int = tiles.SIZE, whole_maps: int | None = None) -> DataFrame:
    """map_id, node_id, row, col: nodes placed at distance maxima in free space, in the order they are placed."""
    rows, large, _ = whole.parted(_free(cells), size, whole_maps)

    def make(held: list, f: np.ndarray) -> pd.DataFrame:
        lines = []
        for m in f:
            sample_free(graph := Graph(), m, distance)
            lines.append([list(graph.nodes)])
        return whole.lines_of(held, lines, "line", np.int32).rename(columns={"i": "node_id"})[["map_id", "node_id", "row", "col"]]

    return _both(whole.stacked(rows, size, make, "map_id long, node_id int, row int, col int"), large, lambda t: sampling.sampled_tiles(t, distance, size))
