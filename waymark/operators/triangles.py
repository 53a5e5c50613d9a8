"""Delaunay triangulation over tiles: one map many tasks, the result that of the whole map.

A round triangulates each tile with the eight around it. A point of the middle tile is done if the circles of all its triangles
lie within the nine tiles, as no point outside can change them. All others go on, with the done points joined to them: a
triangulation of any points that hold a point's true neighbours gives that point its true triangles. The next round's
tiles are four times as wide. In the last, the nine tiles hold all that is left of the map.

Ties (four points on a circle) are resolved as if later points, in row-major order, lay higher by amounts that dwarf earlier
ones': a rule on the points alone, so all tiles agree. Points on one line have no edges.

What goes on are the points at tile borders whose circles are wide, and the rim of the map: about as many as the hull has
points. Points laid out around one large empty circle are all rim, and meet in one task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bulky, cut
from .kernels import joined, triangles, triangulate
from .tiles import SIZE, TILE, place
from .whole import tasks

NODE = ["map_id", "node_id"]
FEW = 2_000  # points of a map that a task triangulates at once


def circle(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int]) -> tuple[float, float, float]:
    """(row, col, radius) of the circle through three points that aren't on a line."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d, b2, c2 = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
    x, y = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    return a[0] + x, a[1] + y, math.hypot(x, y)


def _stars(key: tuple, t: pd.DataFrame, size: int) -> pd.DataFrame:
    """The done points of the middle tile: a row for each neighbour, and one without."""
    map_id, tr, tc = key
    ids, points = t["node_id"].tolist(), list(zip(t["row"].tolist(), t["col"].tolist(), strict=True))
    n, whole = len(points), len(points) == t["left"].iloc[0]
    third = triangles(points)
    spokes = defaultdict(list)
    for a, b in third:
        spokes[a].append(b)
    low, high = ((tr - 1) * size, (tc - 1) * size), ((tr + 2) * size, (tc + 2) * size)
    known: dict[frozenset, bool] = {}

    def within(a: int, b: int) -> bool:
        c = third[a, b]
        if max(b, c) >= n:
            return False
        name = frozenset((a, b, c))
        if name not in known:
            r, q, far = circle(points[a], points[b], points[c])
            far = far * (1 + 1e-9) + 1e-6  # rounding may only put a point off
            known[name] = low[0] - 1 < r - far and r + far < high[0] and low[1] - 1 < q - far and q + far < high[1]
        return known[name]

    rows = []
    own = (t["open"] & (t["row"] // size == tr) & (t["col"] // size == tc)).tolist()
    for a in range(n):
        if own[a] and (whole or all(within(a, b) for b in spokes[a])):
            rows.append((map_id, ids[a], None))
            rows += [(map_id, ids[a], ids[b]) for b in spokes[a] if joined(third, n, a, b)]
    return pd.DataFrame(rows, columns=["map_id", "node_id", "other"]).astype({"other": "Int32"})


def _round(points: DataFrame, size: int) -> DataFrame:
    """(map_id, node_id, other): neighbours of the points done in this round; null once for each."""
    at = place(points.join(points.groupBy("map_id").agg(F.count("*").alias("left")), "map_id"), size)
    asked = at.filter("open").select(*TILE).distinct()
    around = at.withColumn("dr", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dc", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    dealt = around.withColumn("tr", F.col("tr") + F.col("dr")).withColumn("tc", F.col("tc") + F.col("dc")).drop("dr", "dc").join(asked, TILE, "left_semi")
    return dealt.groupBy(*TILE).applyInPandas(lambda key, t: _stars(key, t, size), "map_id long, node_id int, other int")


def delaunay(nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """map_id, src, dst (src < dst) of the Delaunay triangulation of each map's nodes(map_id, node_id, row, col).

    Of nodes on one pixel the least id stands for all. Nodes without a pixel take no part. A task has at most the nodes of nine tiles.
    """
    whole = nodes.select(F.col("map_id").cast("long").alias("map_id"), F.col("node_id").cast("int").alias("node_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).dropna()
    points = cut(whole.groupBy("map_id", "row", "col").agg(F.min("node_id").alias("node_id")).withColumn("open", F.lit(True)))
    found, rim = [], None
    while not points.isEmpty():
        done = cut(_round(points, size))
        found.append(done)
        names = done.filter("other IS NULL").select(*NODE)
        left = points.filter("open").join(names, NODE, "left_anti")
        rim = done.dropna() if rim is None else rim.union(done.dropna())
        rim = cut(rim.join(left.select("map_id", F.col("node_id").alias("other")), ["map_id", "other"], "left_semi").select(*NODE, "other"))
        beside = points.join(rim, NODE, "left_semi").withColumn("open", F.lit(False))
        points = cut(left.union(beside.select(*left.columns)))
        size *= 4
    if not found:
        return whole.filter("false").select("map_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    return reduce(DataFrame.union, found).filter("node_id < other").select("map_id", F.col("node_id").alias("src"), F.col("other").alias("dst"))


def delaunay_maps(nodes: DataFrame, size: int = SIZE, few: int = FEW) -> DataFrame:
    """``delaunay``, where maps of at most ``few`` points are triangulated whole, many to a task; tiles and rounds are for the others."""
    whole = nodes.select(F.col("map_id").cast("long").alias("map_id"), F.col("node_id").cast("int").alias("node_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).dropna()
    points = cut(whole.groupBy("map_id", "row", "col").agg(F.min("node_id").alias("node_id")))
    count = points.groupBy("map_id").agg(F.count("*").alias("points"))
    many = count.filter(F.col("points") > few)
    large = None if many.isEmpty() else cut(points.join(bulky(many), "map_id", "left_semi"))
    mine = points if large is None else points.join(bulky(many), "map_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b.itertuples(index=False):
                ids = [p["node_id"] for p in t.points]
                out += [(t.map_id, min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in triangulate([(p["row"], p["col"]) for p in t.points])]
            yield pd.DataFrame(out, columns=["map_id", "src", "dst"]).astype({"map_id": "int64", "src": "int32", "dst": "int32"})

    rows = mine.repartition(tasks(points), "map_id").groupBy("map_id").agg(F.collect_list(F.struct("node_id", "row", "col")).alias("points"))
    small = rows.mapInPandas(run, "map_id long, src int, dst int")
    return small if large is None else small.unionByName(delaunay(large, size))
