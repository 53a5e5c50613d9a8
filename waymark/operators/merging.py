"""Merging close nodes by rounds over the graphs of all maps, with the result of merging pair after pair in order.

A sweep takes the pairs (a, b) within the radius by the places of a, then b, and merges b into a: b's edges move to a, unless
a moved line is blocked. Merging (a, b) reads b and its edges, and writes edges of a, b and b's neighbours. Two pairs must keep
their order where the b of one is among those nodes of the other; all pairs without such an earlier one are done at once.
An open pair's nodes only grow by nodes of earlier open pairs, so what is done early is never met again. The rounds of a
sweep are as many as the longest such chain of pairs, which is short where few nodes lie within a radius.

Maps that fit one tile, of lines that a task may hold, merge whole and pair after pair, many maps to a task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import line_cells
from ..shared import bulky, cut
from . import shapes, tiles, whole
from .graph import radius_pairs
from .kernels import crossings, merge_sweeps
from .packed import PART, walks
from .shapes import numbered
from .tiles import SIZE, TILE, place

PAIR = ["map_id", "pa", "pb"]
NEAR = ["map_id", "node", "other", "r", "c", "weight", "edge_type"]


def blocked_lines(lines: DataFrame, free: DataFrame, size: int = SIZE) -> DataFrame:
    """The PAIRs of lines(map_id, pa, pb, r0, c0, r1, c1) that meet a cell not set in ``free`` (STATE of shapes), or leave the map.

    Lines' cells go to their tiles, one bit a cell of the map.
    """
    cells = place(lines.select(*PAIR, F.explode(line_cells(*map(F.col, ("r0", "c0", "r1", "c1")))).alias("p")).select(*PAIR, "p.row", "p.col"), size)
    r, c = F.col("row") - F.col("tr") * size, F.col("col") - F.col("tc") * size
    known = cells.withColumn("y", r).withColumn("x", c).join(free, TILE, "left")
    known = known.withColumn("k", F.col("y") * F.col("w") + F.col("x"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(k div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("7 - k % 8")
    is_set = (F.col("y") < F.col("h")) & (F.col("x") < F.col("w")) & (F.call_function("getbit", byte, bit.cast("int")) == 1)
    return bulky(known.filter(~F.coalesce(is_set, F.lit(False))).select(*PAIR).distinct())


def _ready(pending: DataFrame, near: DataFrame) -> DataFrame:
    """The pending pairs that no earlier one must precede."""
    rank = F.struct("pa", "pb")
    own = pending.select(*PAIR, F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(False).alias("own")), F.struct(F.col("b").alias("node"), F.lit(True).alias("own")))).alias("t")).select(*PAIR, "t.node", "t.own")
    more = pending.join(near.withColumnRenamed("node", "b"), ["map_id", "b"]).filter("other <> a").select(*PAIR, F.col("other").alias("node"), F.lit(False).alias("own"))
    touched = own.union(more)
    first = touched.groupBy("map_id", "node").agg(F.min(rank).alias("any_"), F.min(F.when(F.col("own"), rank)).alias("b_"))
    free = F.when(F.col("own"), F.col("any_") == rank).otherwise(F.col("b_").isNull() | (F.col("b_") >= rank))
    fits = touched.join(first, ["map_id", "node"]).groupBy(*PAIR).agg(F.bool_and(free).alias("fits")).filter("fits").drop("fits")
    return pending.join(fits, PAIR)


def _moved(done: DataFrame, near: DataFrame) -> DataFrame:
    """The lines from a to b's other neighbours: PAIR, a, ar, ac, other, r, c."""
    return done.join(near.select("map_id", F.col("node").alias("b"), "other", "r", "c"), ["map_id", "b"]).filter("other <> a").select(*PAIR, "a", "ar", "ac", "other", "r", "c")


def _sweep(now: DataFrame, near: DataFrame, free: DataFrame, radius: float, size: int) -> tuple[DataFrame | None, DataFrame]:
    """(the pairs merged, with lines: whether edges moved; NEAR afterwards) of all pairs of ``now``, each tried once."""
    at = now.select("map_id", "place", "node_id", "row", "col")
    pairs = radius_pairs(now.select("map_id", F.col("place").alias("node_id"), "row", "col"), radius).select("map_id", F.col("a").alias("pa"), F.col("b").alias("pb"))
    pairs = pairs.join(at.select("map_id", F.col("place").alias("pa"), F.col("node_id").alias("a"), F.col("row").alias("ar"), F.col("col").alias("ac")), ["map_id", "pa"])
    pending = cut(pairs.join(at.select("map_id", F.col("place").alias("pb"), F.col("node_id").alias("b")), ["map_id", "pb"]).select(*PAIR, "a", "b", "ar", "ac"))
    log = []
    while not pending.isEmpty():
        ready = cut(_ready(pending, near))
        lines = _moved(ready, near)
        hit = blocked_lines(lines.select(*PAIR, F.col("ar").alias("r0"), F.col("ac").alias("c0"), F.col("r").alias("r1"), F.col("c").alias("c1")), free, size)
        moving = lines.select(*PAIR).distinct().withColumn("lines", F.lit(True))
        done = cut(ready.join(hit, PAIR, "left_anti").join(moving, PAIR, "left").fillna(False, ["lines"]))
        gone = done.select("map_id", F.col("b").alias("node"))
        if not done.isEmpty():
            log.append(done)
            m = _moved(done, near).withColumn("weight", F.hypot(F.col("ar") - F.col("r"), F.col("ac") - F.col("c"))).withColumn("edge_type", F.lit("merge"))
            there = m.select("map_id", F.col("a").alias("node"), "other", "r", "c", "weight", "edge_type")
            back = m.select("map_id", F.col("other").alias("node"), F.col("a").alias("other"), F.col("ar").alias("r"), F.col("ac").alias("c"), "weight", "edge_type")
            made = there.union(back).distinct()
            kept = near.join(gone, ["map_id", "node"], "left_anti").join(gone.withColumnRenamed("node", "other"), ["map_id", "other"], "left_anti").join(made, ["map_id", "node", "other"], "left_anti")
            near = cut(kept.select(*NEAR).union(made.select(*NEAR)))
        # a pair whose b is gone has nothing to merge: b comes back, if at all, by pairs that it leads, which are later ones
        pending = cut(pending.join(ready.select(*PAIR), PAIR, "left_anti").join(gone.withColumnRenamed("node", "b"), ["map_id", "b"], "left_anti").select(*PAIR, "a", "b", "ar", "ac"))
    return (reduce(DataFrame.union, log) if log else None), near


def merged(nodes: DataFrame, edges: DataFrame, free: DataFrame, radius: float, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Nodes(map_id, node_id, row, col, place) and edges(map_id, src, dst, weight, edge_type) after sweeps until nothing merges.

    nodes(map_id, node_id, row, col): whole pixels, distinct by map, in the order of their ids; edges(map_id, src, dst, weight,
    edge_type), undirected. ``free``: STATE of shapes, the cells that lines may cross. A node that went and got edges again
    stands behind all others (place). Maps in which a sweep merged nothing take no part in the next.
    """
    now = cut(nodes.select(F.col("map_id").cast("long").alias("map_id"), F.col("node_id").cast("int").alias("node_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("node_id").cast("long").alias("place")))
    e = edges.select(F.col("map_id").cast("long").alias("map_id"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("weight").cast("double").alias("weight"), "edge_type").filter("src <> dst")
    both = e.union(e.select("map_id", F.col("dst"), F.col("src"), "weight", "edge_type")).toDF("map_id", "node", "other", "weight", "edge_type")
    near = cut(both.join(now.select("map_id", F.col("node_id").alias("other"), F.col("row").alias("r"), F.col("col").alias("c")), ["map_id", "other"]).select(*NEAR))
    awake = now
    while True:
        log, near = _sweep(awake, near, free, radius, size)
        if log is None:
            break
        gone = log.select("map_id", F.col("b").alias("node_id"))
        again = log.filter("lines").groupBy("map_id", F.col("a").alias("node_id")).agg(F.min(F.struct("pa", "pb")).alias("by")).join(gone, ["map_id", "node_id"], "left_semi")
        again = numbered(again.select("map_id", "node_id", "by.pa", "by.pb"), "pa", "pb", shift=12)
        last = now.groupBy("map_id").agg((F.max("place") + 1).alias("base"))
        back = now.join(again, ["map_id", "node_id"]).join(last, "map_id").select("map_id", "node_id", "row", "col", (F.col("base") + F.col("number")).alias("place"))
        now = cut(now.join(gone, ["map_id", "node_id"], "left_anti").union(back))
        awake = now.join(gone.select("map_id").distinct(), "map_id", "left_semi")
    return now, near.filter("node < other").select("map_id", F.col("node").alias("src"), F.col("other").alias("dst"), "weight", "edge_type")


ENDS = ("r0", "c0", "r1", "c1")
LEFT = "map_id long, node_id int, row int, col int, place long, degree int"


def _line_graph(lines: DataFrame, free: DataFrame, sized: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``merged_lines`` over tiles: STATE ``free``, map_id, height and width of ``sized``."""
    lines = lines.withColumns({k: F.shiftleft(F.col(r).cast("long"), 32) + F.col(c) for k, r, c in (("pa", *ENDS[:2]), ("pb", *ENDS[2:]))}).join(bulky(sized), "map_id")
    name = lambda r, c: (F.col(r) * F.col("width") + F.col(c)).cast("int")
    ends = lines.select("map_id", "height", "width", F.explode(F.array(*[F.struct(F.col(r).alias("row"), F.col(c).alias("col")) for r, c in (ENDS[:2], ENDS[2:])])).alias("p"))
    ends = ends.select("map_id", "height", "width", "p.row", "p.col").filter("row BETWEEN 0 AND height - 1 AND col BETWEEN 0 AND width - 1")
    nodes = ends.select("map_id", "row", "col", name("row", "col").alias("node_id")).distinct()
    open_ = lines.join(blocked_lines(lines, free, size), PAIR, "left_anti").select("map_id", *ENDS, name("r0", "c0").alias("a"), name("r1", "c1").alias("b"))
    edges = open_.filter("a <> b").groupBy("map_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min(F.hypot(F.col("r0") - F.col("r1"), F.col("c0") - F.col("c1"))).alias("weight"))
    return nodes, edges.withColumn("edge_type", F.lit("line"))


def _over_tiles(lines: DataFrame, tiled: DataFrame, sized: DataFrame, least: float, radius: float, size: int) -> DataFrame:
    free = cut(shapes.clear(tiles.tile_distances(tiled, size, ring=True), least))
    nodes, edges = merged(*_line_graph(lines, free, sized, size), free, radius, size)
    ends = edges.select("map_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("map_id", "node_id").agg(F.count("*").cast("int").alias("degree"))
    return nodes.join(bulky(ends), ["map_id", "node_id"], "left").fillna(0, ["degree"]).select("map_id", "node_id", "row", "col", "place", "degree")


def _whole_merged(held: list, free: np.ndarray, radius: float) -> pd.DataFrame:
    """LEFT rows of a stack of maps with lines r0, c0, r1, c1 (arrays)."""
    _, h, w = free.shape
    out = []
    for t, f in zip(held, free, strict=True):
        r0, c0, r1, c1 = (np.asarray(getattr(t, k), np.int64) for k in ENDS)
        in0, in1 = ((r >= 0) & (r < h) & (c >= 0) & (c < w) for r, c in ((r0, c0), (r1, c1)))
        near = {p // w * 2 * w + p % w: {} for p in np.unique(np.concatenate([(r0 * w + c0)[in0], (r1 * w + c1)[in1]])).tolist()}
        both = in0 & in1
        ends = [v[both] for v in (r0, c0, r1, c1)]
        for a in range(0, len(ends[0]), 5000):
            p = [v[a : a + 5000] for v in ends]
            line, row, col = walks(*p)
            open_ = np.bincount(line, ~f[row, col], len(p[0])) == 0
            for x, y in zip((p[0] * 2 * w + p[1])[open_].tolist(), (p[2] * 2 * w + p[3])[open_].tolist(), strict=True):
                if x != y:
                    near[x][y] = near[y][x] = "line"
        at = {p: p // (2 * w) * w + p % (2 * w) for p in near}
        place, alive = dict(at), list(near)
        for again in merge_sweeps(near, crossings(~f), radius, h, w):
            # as ``merged``: behind the places before the sweep
            last = max(place[p] for p in alive)
            place.update(zip(again, range(last + 1, last + 1 + len(again)), strict=True))
            alive = list(near)
        out += [(whole.name(t), at[p], *divmod(at[p], w), place[p], len(q)) for p, q in near.items()]
    return pd.DataFrame(out, columns=["map_id", "node_id", "row", "col", "place", "degree"]).astype({"map_id": "int64", "node_id": "int32", "row": "int32", "col": "int32", "place": "int64", "degree": "int32"})


def merged_lines(cells: DataFrame, lines: DataFrame, *, least: float, radius: float, size: int = SIZE, whole_maps: int | None = None, most: int = PART) -> DataFrame:
    """LEFT rows: what ``merged`` leaves of the graphs of lines(map_id, r0, c0, r1, c1), with places and degrees.

    Nodes are the lines' ends on their map, named in row-major order; edges are the lines whose cells lie ``least`` or more from
    an obstacle of cells(map_id, row, col, free), or packed maps. A map of more than ``most`` lines goes over tiles.
    """
    lines = lines.select(F.col("map_id").cast("long").alias("map_id"), *[F.col(c).cast("int").alias(c) for c in ENDS])
    busy = cut(lines.groupBy("map_id").count().filter(F.col("count") > most).select("map_id"))
    parts = [(cells, whole_maps)] if busy.isEmpty() else [(cells.join(busy, "map_id", "left_anti"), whole_maps), (cells.join(busy, "map_id", "left_semi"), 0)]
    out = None
    for part, at_most in parts:
        rows, large, sized = whole.parted(part, size, at_most)
        if large is not None:
            many = bulky(sized.filter("NOT few").select("map_id", "height", "width"))
            tiled = _over_tiles(cut(lines.join(many.select("map_id"), "map_id", "left_semi").distinct()), large, many, least, radius, size)
            out = tiled if out is None else out.unionByName(tiled)
        if at_most != 0:
            few = lines if busy.isEmpty() else lines.join(busy, "map_id", "left_anti")
            held = few.groupBy("map_id").agg(F.collect_set(F.struct(*ENDS)).alias("s")).select("map_id", *[F.col(f"s.{c}").alias(c) for c in ENDS])
            make = lambda t, f: _whole_merged(t, whole.clear(f, least), radius)
            small = whole.stacked(rows.join(bulky(held), "map_id"), size, make, LEFT)
            out = small if out is None else out.unionByName(small)
    return out
