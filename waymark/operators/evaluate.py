"""Graph quality: distances to nodes, coverage, clearance and smoothness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import line_cells
from ..shared import bulky, cut
from . import reach, tiles, whole
from .build import _free as free_cells
from .build import build_graphs, nodes_of, spread, stack_graphs
from .build import raster as to_raster
from .graph import clustering, components, degree_stats, for_maps
from .kernels import Config, line, shortest_path, squared_distance
from .whole import tasks


def node_distance(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean and greatest distance of cells to the nearest node, by map: the distance transform of the node raster."""
    from .raster import distance

    at = nodes.select("map_id", "row", "col").distinct().withColumn("node", F.lit(True))
    marked = cells.select("map_id", "row", "col").join(at, ["map_id", "row", "col"], "left").withColumn("value", F.when(F.col("node"), 0).otherwise(255))
    d = distance(marked, 127, ring=False)
    return d.groupBy("map_id").agg(F.round(F.avg(F.sqrt("d2")), 5).alias("average_distance_to_node"), F.round(F.max(F.sqrt("d2")), 5).alias("max_distance_to_node"))


def clearance(lines: DataFrame, dist: DataFrame) -> DataFrame:
    """Mean obstacle distance over the cells of each line."""
    cells = lines.select("map_id", "line_id", F.explode(line_cells(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))).alias("p")).select("map_id", "line_id", F.col("p.row").alias("row"), F.col("p.col").alias("col"))
    return cells.join(dist.select("map_id", "row", "col", "d2"), ["map_id", "row", "col"]).groupBy("line_id").agg(F.round(F.avg(F.sqrt("d2")), 5).alias("clearance"), F.count("*").alias("n_cells"))


def smoothness(path: DataFrame) -> DataFrame:
    """1 - mean turn / pi of path(path_id, seq, row, col); 1 for paths without a turn."""
    w = Window.partitionBy("path_id").orderBy("seq")
    v = path.select("path_id", *[(F.col(c) - F.lag(c).over(w)).alias(f"a{c}") for c in ("row", "col")], *[(F.lead(c).over(w) - F.col(c)).alias(f"b{c}") for c in ("row", "col")])
    size = F.hypot("arow", "acol") * F.hypot("brow", "bcol")
    turn = F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("arow") * F.col("brow") + F.col("acol") * F.col("bcol")) / size))))
    return v.withColumn("t", turn).groupBy("path_id").agg(F.round(F.when(F.count("t") == 0, F.lit(1.0)).otherwise(1.0 - F.avg("t") / math.pi), 5).alias("smoothness"))


def coverage(cells: DataFrame, nodes: DataFrame, *, threshold: int = 127, size: int = tiles.SIZE, whole_maps: int | None = None) -> DataFrame:
    """``tiles.coverage`` of cells(map_id, row, col, value) or packed maps: the map's own free space, over the threshold, not inflated."""
    rows, large, sized = whole.parted(free_cells(cells, threshold), size, whole_maps, nulls=True)
    at = cut(nodes.groupBy(F.col("map_id").cast("long").alias("map_id"), "row", "col").agg(F.count("*").alias("n")))
    known = at.join(bulky(sized), "map_id")
    inside = F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)
    lost = known.filter(~F.coalesce(inside, F.lit(False))).limit(1).collect()
    if lost:
        raise ValueError(f"map {lost[0]['map_id']}: a node lies outside the map")
    held = known.filter("few").groupBy("map_id").agg(F.collect_list(F.struct("row", "col", "n")).alias("at"))
    small = whole.stacked(rows.join(bulky(held), "map_id", "left"), size, whole.covered, whole.COVERED)
    return small if large is None else small.unionByName(tiles.tile_coverage(large, at.withColumn("i", F.explode(F.expr("sequence(1L, n)"))).select("map_id", "row", "col"), size))


def build_coverage(cells: DataFrame, *, resolution: float, safety: float, threshold: int = 127, config: Config | None = None, size: int = tiles.SIZE, whole_maps: int | None = None) -> DataFrame:
    """``coverage`` of the graphs that ``build_graphs`` makes of cells(map_id, row, col, value) or packed maps. A map that goes whole
    is built and covered by one task; a map that can't be built has no nodes."""
    cfg = config or Config()
    rows, large, sized = whole.parted(free_cells(cells, threshold), size, whole_maps, nulls=True)

    def make(held: list, free: np.ndarray) -> pd.DataFrame:
        at, n = np.zeros(free.shape, bool), np.zeros(len(free), np.int64)
        for k, got in enumerate(stack_graphs(free, resolution, safety, cfg)):
            if not isinstance(got, ValueError):
                n[k] = len(got[0])
                r, c = np.divmod(np.array(list(got[0]), np.int64), 2 * free.shape[2])
                at[k, r, c] = True
        return whole.cover(held, free, at, n)

    small = whole.stacked(rows, size, make, whole.COVERED)
    if large is None:
        return small
    many = cells.join(bulky(sized.filter("NOT few").select(F.col("map_id").alias("many"))), F.col("map_id").eqNullSafe(F.col("many")), "left_semi")
    return small.unionByName(tiles.tile_coverage(large, nodes_of(build_graphs(many, resolution=resolution, safety=safety, threshold=threshold, config=cfg)), size))


def regions(cells: DataFrame, *, threshold: int = 127, size: int = tiles.SIZE) -> DataFrame:
    """map_id, row, col, region of the cells over the threshold: 8-connected regions, numbered from 1 in row-major order."""
    return tiles.regions(cells.select("map_id", "row", "col", (F.col("value") > threshold).alias("free")), size)


def _graph_groups(nodes: DataFrame, edges: DataFrame):
    n = spread(nodes.selectExpr("cast(map_id as long) map_id", "cast(node_id as int) node_id", "row", "col")).groupBy("map_id")
    return n.cogroup(spread(edges.selectExpr("cast(map_id as long) map_id", "cast(src as int) src", "cast(dst as int) dst", "weight")).groupBy("map_id"))


def _adjacency(n: pd.DataFrame, e: pd.DataFrame) -> dict[int, dict[int, float]]:
    near: dict[int, dict[int, float]] = {x: {} for x in n["node_id"].tolist()}
    for a, b, w in zip(e["src"].tolist(), e["dst"].tolist(), e["weight"].tolist(), strict=True) if len(e) else ():
        near[a][b] = near[b][a] = w
    return near


def diameter(nodes: DataFrame, edges: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """graph_diameter by map: the greatest number of hops between two nodes; infinite if some are not connected, 0 for
    those of ``maps`` without a graph."""
    return for_maps(reach.diameter(nodes, edges), maps, graph_diameter=0.0)


def collision_free(nodes: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """map_id, collision_free of the maps with edges: no blocked cell on any edge as it is drawn, what is outside left out.

    Both ends and the blocked cells meet by equi-joins; a map's edges are as many tasks as there are.
    """
    at = lambda k, r, c: nodes.select("map_id", F.col("node_id").alias(k), F.col("row").alias(r), F.col("col").alias(c))
    lines = edges.select("map_id", "src", "dst").join(at("src", "r0", "c0"), ["map_id", "src"]).join(at("dst", "r1", "c1"), ["map_id", "dst"])
    cells = lines.select("map_id", F.explode(line_cells(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"), drawn=True)).alias("p")).select("map_id", F.col("p.row").alias("row"), F.col("p.col").alias("col")).distinct()
    hit = cells.join(blocked.filter("blocked").select("map_id", "row", "col"), ["map_id", "row", "col"], "left_semi").select("map_id").distinct().withColumn("hit", F.lit(True))
    return edges.select("map_id").distinct().join(hit, "map_id", "left").select("map_id", F.col("hit").isNull().alias("collision_free"))


def validity(nodes: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """By map: collision_free (no edge over a blocked cell), node_validity (no node blocked or outside), connectivity, num_subgraphs and edge_length_validity (every
    weight in pixels positive and at most the map's diagonal). ``blocked`` holds every cell of the maps; a map without a
    graph is valid and connected, with no subgraph."""
    size = blocked.groupBy("map_id").agg(F.hypot(F.max("row") + 1, F.max("col") + 1).alias("diagonal"))
    n = nodes.join(blocked.select("map_id", "row", "col", "blocked"), ["map_id", "row", "col"], "left").groupBy("map_id").agg(F.bool_and(F.coalesce(~F.col("blocked"), F.lit(False))).alias("node_validity"))
    c = components(nodes, edges).groupBy("map_id").agg(F.countDistinct("component").alias("num_subgraphs"))
    e = edges.join(size, "map_id").groupBy("map_id").agg(F.bool_and((F.col("weight") > 0) & (F.col("weight") <= F.col("diagonal"))).alias("edge_length_validity"))
    out = n.join(bulky(c), "map_id").join(bulky(e), "map_id", "left").join(bulky(collision_free(nodes, edges, blocked)), "map_id", "left")
    out = out.select("map_id", F.coalesce("collision_free", F.lit(True)).alias("collision_free"), "node_validity", (F.col("num_subgraphs") == 1).alias("connectivity"), "num_subgraphs", F.coalesce("edge_length_validity", F.lit(True)).alias("edge_length_validity"))
    return for_maps(out, size, collision_free=True, node_validity=True, connectivity=True, num_subgraphs=0, edge_length_validity=True)


def path_metrics(nodes: DataFrame, edges: DataFrame, cells: DataFrame, samples: int = 1000, threshold: int = 127) -> DataFrame:
    """Over ``samples`` node pairs of each map: mean length, smoothness and clearance of shortest paths, and the share
    of pairs that have one. The pairs come from a generator seeded by the map's id. No path or under two nodes: zeros.

    ``cells`` are the maps' cells; clearance counts the joints of two lines twice, as each line holds its ends.
    """
    parts = [
        nodes.groupBy(F.col("map_id").cast("long").alias("map_id")).agg(F.collect_list(F.struct(F.col("node_id").cast("int").alias("a"), F.col("row").alias("b"), F.col("col").alias("c"))).alias("n")),
        edges.groupBy(F.col("map_id").cast("long").alias("map_id")).agg(F.collect_list(F.struct(F.col("src").cast("int").alias("a"), F.col("dst").cast("int").alias("b"), F.col("weight").alias("w"))).alias("e")),
        cells.groupBy(F.col("map_id").cast("long").alias("map_id")).agg(*[F.collect_list(c).alias(k) for k, c in (("cr", "row"), ("cc", "col"), ("cv", "value"))]),
    ]
    one = parts[0].join(bulky(parts[1]), "map_id", "full").join(bulky(parts[2]), "map_id", "full")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_sampled_paths(t, samples, threshold) for t in b.itertuples(index=False)], columns=PATHS.replace(" long", "").replace(" double", "").split(", "))

    return one.repartition(tasks(one), "map_id").mapInPandas(run, PATHS)


PATHS = "map_id long, average_path_length double, average_path_smoothness double, average_path_clearance double, path_success_rate double"


def _pairs(seed: int, n: int, samples: int) -> np.ndarray:
    """``samples`` times ``Generator.choice(n, 2, replace=False)``, its three draws of each time made at once; a test holds them equal."""
    a, b, turn = np.random.default_rng(seed).integers(0, np.tile([n - 1, n, 2], samples), dtype=np.uint32).astype(np.int64).reshape(-1, 3).T
    b = np.where(b == a, n - 1, b)
    return np.stack([np.where(turn == 0, b, a), np.where(turn == 0, a, b)], axis=1)


def _sampled_paths(t, samples: int, threshold: int) -> tuple:
    """A row of PATHS of a row of nodes n(a, b, c), edges e(a, b, w) and cells cr, cc, cv of one map. A pair that comes again is
    searched once; turns and distances along an edge are kept."""
    key = int(t.map_id)
    at = {x["a"]: (x["b"], x["c"]) for x in (() if t.n is None else t.n)}
    near: dict[int, dict[int, float]] = {x: {} for x in at}
    for x in () if t.e is None else t.e:
        near[x["a"]][x["b"]] = near[x["b"]][x["a"]] = x["w"]
    names, found, seen, bends = sorted(at), {}, {}, {}
    if len(names) < 2:
        return (key, 0.0, 0.0, 0.0, 0.0)
    dist = np.zeros((0, 0))
    if t.cr is not None:
        dist = np.sqrt(squared_distance(to_raster(pd.DataFrame({"row": t.cr, "col": t.cc, "value": t.cv})) > threshold))
    scale = min((w / d for a in near for b, w in near[a].items() if (d := math.dist(at[a], at[b]))), default=0.0) * (1 - 1e-12)
    place = {k: (p[0] * scale, p[1] * scale) for k, p in at.items()}

    def along(p: int, q: int) -> np.ndarray:
        if (p, q) not in seen:
            seen[p, q] = dist[line(*at[p], *at[q])]
        return seen[p, q]

    def bend(p: int, q: int, r: int) -> float | None:
        if (p, q, r) not in bends:
            u, v = (at[q][0] - at[p][0], at[q][1] - at[p][1]), (at[r][0] - at[q][0], at[r][1] - at[q][1])
            s = math.hypot(*u) * math.hypot(*v)
            bends[p, q, r] = math.acos(max(-1.0, min(1.0, float(u[0] * v[0] + u[1] * v[1]) / s))) if s else None
        return bends[p, q, r]

    def walked(a: int, b: int) -> tuple | None:
        path = shortest_path(near, place, names[a], names[b])
        if path is None:
            return None
        turns = [x for p, q, r in zip(path, path[1:], path[2:], strict=False) if (x := bend(p, q, r)) is not None]
        steps = list(zip(path, path[1:], strict=False))
        return sum([near[p][q] for p, q in steps]), 1 - sum(turns) / len(turns) / math.pi if turns else 1.0, float(np.concatenate([along(p, q) for p, q in steps]).mean())

    got = []
    for pair in map(tuple, _pairs(key & 0xFFFFFFFF, len(names), samples).tolist()):
        if pair not in found:
            found[pair] = walked(*pair)
        if found[pair] is not None:
            got.append(found[pair])
    mean = np.mean(got, axis=0).tolist() if got else [0.0, 0.0, 0.0]
    return (key, *mean, len(got) / samples)


def report(nodes: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """All counts, structure and validity metrics of each map of ``blocked``, and a line of text with them."""
    maps = blocked.select("map_id").distinct()
    out = degree_stats(nodes, edges, maps)
    for more in (diameter(nodes, edges, maps), clustering(nodes, edges, maps), validity(nodes, edges, blocked)):
        out = out.join(bulky(more), "map_id")
    text = F.format_string("map %d: %d nodes, %d edges, %d subgraphs, nodes valid: %s, lengths valid: %s", "map_id", "num_nodes", "num_edges", "num_subgraphs", F.col("node_validity").cast("string"), F.col("edge_length_validity").cast("string"))
    return out.withColumn("summary", text)


def evaluate_all(cells: DataFrame, nodes: DataFrame, edges: DataFrame, *, safety: float, resolution: float, threshold: int = 127, samples: int = 1000) -> DataFrame:
    """(map_id, category, metric, value): coverage, graph_structure, path_planning and validation of every map of ``cells``.

    A map without a graph has zeros, valid and connected; truth values count as 1 and 0. Nodes outside their map are an
    error that names the map.
    """
    from .raster import distance, inflate

    d = distance(cells, threshold, ring=False)
    blocked = inflate(d.withColumn("d2", F.coalesce("d2", F.lit(2**31 - 1))), safety, resolution).select("map_id", "row", "col", "blocked")
    maps = cells.select("map_id").distinct()
    cover = coverage(cells, nodes, threshold=threshold)
    graph = degree_stats(nodes, edges, maps).join(diameter(nodes, edges, maps), "map_id").join(clustering(nodes, edges, maps), "map_id")
    path = for_maps(path_metrics(nodes, edges, cells, samples, threshold), maps, average_path_length=0.0, average_path_smoothness=0.0, average_path_clearance=0.0, path_success_rate=0.0)
    parts = [("coverage", cover), ("graph_structure", graph), ("path_planning", path), ("validation", validity(nodes, edges, blocked))]
    rows = [df.select(F.col("map_id").cast("long"), F.lit(name).alias("category"), F.explode(F.create_map(*[x for c in df.columns if c != "map_id" for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value")) for name, df in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])
