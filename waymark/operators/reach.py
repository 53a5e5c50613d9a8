"""Distances over graphs by rounds: many sources of many maps at once, no graph in one task.

A request set's frontier is a DataFrame; every round joins it with the edges. Nodes(map_id, node_id, row, col) and
edges(map_id, src, dst, weight), undirected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bulky, cut
from .graph import both_ways


def distances(sources: DataFrame, edges: DataFrame, delta: float | None = None) -> DataFrame:
    """(map_id, source, node_id, distance, back) of the nodes that sources(map_id, source) reach; back is the node before, of
    equally near ones the least, null at the source.

    Buckets of width ``delta`` (the mean weight of an edge unless given) are settled in turn for all sources: inside a bucket
    distances are relaxed until nothing gets less; then all edges leave it once. A round's work is its frontier's edges.
    """
    step = cut(both_ways(edges.select(F.col("map_id").cast("long").alias("map_id"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("weight").cast("double").alias("weight"))))
    if delta is None:
        delta = step.agg(F.avg("weight")).first()[0] or 1.0
    start = sources.select(F.col("map_id").cast("long").alias("map_id"), F.col("source").cast("int").alias("source")).distinct()
    best = cut(start.select("map_id", "source", F.col("source").alias("node_id"), F.lit(0.0).alias("distance")))
    frontier, bucket = best, 0
    key = ["map_id", "source", "node_id"]
    pending = None  # reached, but in a later bucket
    while True:
        new = frontier.join(step.withColumnRenamed("src", "node_id"), ["map_id", "node_id"]).groupBy("map_id", "source", F.col("dst").alias("node_id")).agg(F.min(F.col("distance") + F.col("weight")).alias("near"))
        better = cut(new.join(best, key, "left").filter("distance IS NULL OR near < distance").select(*key, F.col("near").alias("distance")))
        if not better.isEmpty():
            best = cut(best.unionByName(better).groupBy(*key).agg(F.min("distance").alias("distance")))
        pending = better if pending is None else pending.unionByName(better)
        waiting = cut(pending.groupBy(*key).agg(F.min("distance").alias("distance")))
        low = waiting.agg(F.min("distance")).first()[0]
        if low is None:
            break
        bucket = max(bucket, int(low // delta))
        frontier = waiting.filter(F.col("distance") < (bucket + 1) * delta)
        pending = waiting.filter(F.col("distance") >= (bucket + 1) * delta)
    # the node before: one whose distance and edge add up to this one's
    ends = best.select("map_id", "source", F.col("node_id").alias("src"), F.col("distance").alias("so_far"))
    before = ends.join(step, ["map_id", "src"]).groupBy("map_id", "source", F.col("dst").alias("node_id")).agg(F.min(F.struct((F.col("so_far") + F.col("weight")).alias("total"), "src")).alias("b"))
    out = best.join(before, key, "left")
    return out.select(*key, "distance", F.when(F.col("node_id") != F.col("source"), F.col("b.src")).alias("back"))


WHOLE = 512  # nodes of a map that is searched whole
WORDS = 1 << 22  # 8-byte words that a task's searches hold at once


def diameter(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(map_id, graph_diameter): the greatest number of hops between two nodes of each map; infinite if it falls apart.

    Maps of at most ``whole`` nodes are rows of node and edge lists, many to a task; larger ones go by rounds over all maps.
    """
    n = nodes.select(F.col("map_id").cast("long").alias("map_id"), F.col("node_id").cast("int").alias("node_id"))
    e = edges.select(F.col("map_id").cast("long").alias("map_id"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    size = n.groupBy("map_id").agg(F.count("*").alias("nodes"))
    if (size.agg(F.max("nodes")).first()[0] or 0) <= whole:
        return _diameters_whole(n, e)
    big = cut(size.filter(F.col("nodes") > whole).select("map_id"))
    small, large = ([bulky(x).join(big, "map_id", how) for x in (n, e)] for how in ("left_anti", "left_semi"))
    return _diameters_whole(*small).unionByName(_diameters_by_rounds(*large))


def _diameters_whole(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    lists = edges.groupBy("map_id").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))
    none = F.array().cast("array<int>")
    one = bulky(nodes.groupBy("map_id").agg(F.collect_set("node_id").alias("n"))).join(bulky(lists), "map_id", "left").select("map_id", "n", *[F.coalesce(c, none).alias(c) for c in ("src", "dst")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, links = (np.array(pc.list_value_length(b.column(i)), np.int64) for i in (1, 2))
            load = np.cumsum(count + 2 * links) * (-(-int(count.max(initial=0)) // 64))
            a = 0
            while a < b.num_rows:
                upto = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + WORDS, "right")))
                part = b.slice(a, upto - a)
                far = _hops(count[a:upto], links[a:upto], *(part.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(far)], ["map_id", "graph_diameter"])
                a = upto

    return one.mapInArrow(run, "map_id long, graph_diameter double")


def _hops(count: np.ndarray, links: np.ndarray, ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The diameters of maps with ``count`` nodes (their ids one map after the other) and ``links`` edges: all sources of all
    maps at once, a bit each. Edges of unknown nodes are left out."""
    maps = np.arange(len(count))
    of, of_edge = np.repeat(maps, count), np.repeat(maps, links)
    key = np.sort((of << 32) + ids)
    first = np.cumsum(count) - count
    local = np.arange(len(key)) - first[of]
    ends = [(of_edge << 32) + x for x in (src, dst)]
    at = [np.minimum(np.searchsorted(key, x), len(key) - 1) for x in ends]
    known = (key[at[0]] == ends[0]) & (key[at[1]] == ends[1])
    a, b = at[0][known], at[1][known]
    s, t = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(t, kind="stable")
    s, t = s[order], t[order]
    bits = np.zeros((len(key), -(-int(count.max()) // 64)), np.uint64)
    bits[np.arange(len(key)), local // 64] = np.uint64(1) << (local % 64).astype(np.uint64)
    out, hops = np.zeros(len(count)), 0
    while len(t):
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        told, to = np.bitwise_or.reduceat(bits[s], starts, axis=0), t[starts]
        grown = np.zeros(len(count), bool)
        grown[of[to[(told & ~bits[to]).any(axis=1)]]] = True
        hops += 1
        out[grown] = hops
        bits[to] |= told
        live = grown[of[t]]  # maps where nothing was new are done
        s, t = s[live], t[live]
    reached = np.unpackbits(bits[first].view(np.uint8), axis=1).sum(axis=1)
    return np.where(reached == count, out, np.inf)


def _diameters_by_rounds(n: DataFrame, edges: DataFrame) -> DataFrame:
    """Sources go 63 to a number: a node's bits say which sources have reached it, and a round ors the neighbours' bits, so
    one exchange serves 63 searches of a map. A group of sources is done when none of its bits is new.
    """
    step = cut(both_ways(edges.withColumn("weight", F.lit(1.0))).select("map_id", F.col("src").alias("node_id"), "dst"))
    size = n.groupBy("map_id").agg(F.count("*").alias("nodes"))
    bits = n.select("map_id", "node_id", F.floor(F.col("node_id") / 63).cast("int").alias("group"), F.expr("shiftleft(1L, node_id % 63)").alias("bits"))
    seen, fresh, hops = cut(bits), None, 0
    fresh = seen
    last = n.select("map_id").distinct().select("map_id", F.lit(0).alias("hops"))
    while True:
        told = fresh.join(step, ["map_id", "node_id"]).groupBy("map_id", F.col("dst").alias("node_id"), "group").agg(F.bit_or("bits").alias("told"))
        fresh = cut(told.join(seen, ["map_id", "node_id", "group"], "left").select("map_id", "node_id", "group", F.col("told").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0"))
        if fresh.isEmpty():
            break
        hops += 1
        last = cut(last.join(fresh.select("map_id").distinct().withColumn("now", F.lit(hops)), "map_id", "left").select("map_id", F.coalesce("now", "hops").alias("hops")))
        seen = cut(seen.unionByName(fresh).groupBy("map_id", "node_id", "group").agg(F.bit_or("bits").alias("bits")))
    reached = seen.groupBy("map_id").agg(F.sum(F.bit_count("bits")).alias("pairs"))
    whole = F.col("pairs") == F.col("nodes") * F.col("nodes")
    return last.join(size, "map_id").join(reached, "map_id").select("map_id", F.when(whole, F.col("hops").cast("double")).otherwise(F.lit(float("inf"))).alias("graph_diameter"))
