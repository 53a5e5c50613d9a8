"""Rasters as square tiles, so that one map is many tasks: regions, distances, nearest nodes, coverage.

``tiles`` packs cells(map_id, row, col, free), every cell of a map, into one row a tile. Work inside a tile is numpy on
``size`` x ``size`` cells; between tiles go only border cells, labels, or envelopes of parabolas, as DataFrames:

* regions: labels inside tiles, equal labels over tile borders, components of that small graph by rounds;
* distances: obstacle rows above and below from running windows over the strips of a column, then the lower envelope of a
  row's parabolas, first within each tile, then of the tiles' envelopes together;
* nearest nodes: (steps, node order) settled inside tiles, border cells sent to the neighbours, and only tiles that got
  something better computed again, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bulky, cut

SIZE = 256
SENT = 200_000  # rows that a task sends back at once, about
BAND = 16  # rows whose envelopes are merged in one group
TILE = ["map_id", "tr", "tc"]
FAR = np.iinfo(np.int64).max // 4
STEP = np.int64(1) << 32


def place(df: DataFrame, size: int) -> DataFrame:
    """Adds tr and tc, the tile of (row, col)."""
    return df.withColumn("tr", F.floor(F.col("row") / size).cast("int")).withColumn("tc", F.floor(F.col("col") / size).cast("int"))


def local(size: int):
    """The number of a cell in its tile."""
    return ((F.col("row") - F.col("tr") * size) * size + (F.col("col") - F.col("tc") * size)).cast("int")


def tiles(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """map_id, tr, tc, h, w, free (array<int>: the free cells' numbers) of cells(map_id, row, col, free)."""
    c = place(cells.select(F.col("map_id").cast("long").alias("map_id"), "row", "col", "free"), size)
    t = c.groupBy(*TILE).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.collect_list(F.when(F.col("free"), local(size))).alias("free"))
    return t.select(*TILE, (F.col("h") - F.col("tr") * size).cast("int").alias("h"), (F.col("w") - F.col("tc") * size).cast("int").alias("w"), "free")


def mask(free: np.ndarray, h: int, w: int, size: int) -> np.ndarray:
    out = np.zeros(h * size, bool)
    out[np.asarray(free, np.int64)] = True
    return out.reshape(h, size)[:, :w]


def each(df: DataFrame, make: Callable[..., pd.DataFrame | None], schema: str) -> DataFrame:
    """The rows that ``make`` gives for every row of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, n = [], 0
            for r in b.itertuples(index=False):
                out = make(r)
                if out is not None and len(out):
                    held.append(out)
                    n += len(out)
                if n >= SENT:  # small tiles go back together
                    yield pd.concat(held, ignore_index=True)
                    held, n = [], 0
            if held:
                yield pd.concat(held, ignore_index=True)

    return df.mapInPandas(run, schema)


def together(df: DataFrame, width: str, make: Callable[[list], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``make`` gives for lists of rows of ``df`` of one ``width``: small rasters are worked on at once, to ``SENT`` cells or one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w, same in b.groupby(width):
                held, n = [], 0
                for r in same.itertuples(index=False):
                    held.append(r)
                    n += r.h * int(w)
                    if n >= SENT:
                        yield make(held)
                        held, n = [], 0
                if held:
                    yield make(held)

    return df.mapInPandas(run, schema)


# --- regions ------------------------------------------------------------------------------------------------------


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of 0..n-1 under the links a-b, by hooking and pointer doubling."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            return up
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (further := up[up])).any():
            up = further


def label_tile(free: np.ndarray) -> np.ndarray:
    """The first cell's number, in row-major order, of each free cell's 8-connected region; -1 elsewhere."""
    h, w = free.shape
    at = np.arange(h * w).reshape(h, w)
    links = []
    for p, q in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:]), (np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[:-1, 1:], np.s_[1:, :-1])):
        both = free[p] & free[q]
        links.append((at[p][both], at[q][both]))
    up = joined(h * w, *(np.concatenate(x) for x in zip(*links, strict=True)))
    return np.where(free, up.reshape(h, w), -1)


def components(links: DataFrame) -> DataFrame:
    """(map_id, node, component) of the nodes of links(map_id, a, b): component is the least node that is reached.

    Alternating large and small stars: each round hangs neighbours below the least one, so the depth halves. The minimum of
    a node's neighbours is aggregated before the exchange; a node with very many neighbours is no single group.
    """
    e = cut(links.filter("a <> b").select("map_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def shape(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("map_id", "a", "b").cast("decimal(38,0)"))).first())

    before = None
    while (now := shape(e)) != before:
        before = now
        both = bulky(e.union(e.select("map_id", F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("map_id", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(bulky(least), ["map_id", "a"]).select("map_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("map_id", "a").agg(F.min("b").alias("m"))
        small = large.join(bulky(least), ["map_id", "a"])
        e = cut(small.filter("b <> m").select("map_id", F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("map_id", "a", F.col("m").alias("b"))).distinct())
    return bulky(e.select("map_id", F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("map_id", F.col("b"), F.col("b")).distinct()))


LABELS = "map_id long, tr int, tc int, h int, w int, labels binary"


def labelled(tiled: DataFrame, size: int) -> DataFrame:
    """LABELS rows: the label of a cell is the number row * 2^32 + col of its region's first cell in the tile, -1 if not free."""

    def make(t) -> pd.DataFrame:
        label = label_tile(mask(t.free, t.h, t.w, size))
        whole = ((t.tr * size + label // t.w) * STEP + t.tc * size + label % t.w).astype(np.int64)
        return pd.DataFrame({"map_id": [t.map_id], "tr": [t.tr], "tc": [t.tc], "h": [t.h], "w": [t.w], "labels": [np.where(label < 0, -1, whole).astype(np.int64).tobytes()]})

    return each(tiled, make, LABELS)


def _labels(t) -> np.ndarray:
    return np.frombuffer(t.labels, np.int64).reshape(t.h, t.w)


def border_links(labels: DataFrame, size: int) -> DataFrame:
    """(map_id, a, b): labels of neighbouring cells of two tiles."""

    def make(t) -> pd.DataFrame:
        """Free cells along the border, and the cells of other tiles that they ask for: right, below, and both diagonals."""
        at = _labels(t)
        rim = np.zeros(at.shape, bool)
        rim[[0, -1]] = rim[:, [0, -1]] = True
        r, c = np.nonzero(rim & (at >= 0))
        out = [(np.zeros(len(r), bool), r, c, at[r, c])]
        for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
            away = (r + dr >= size) | (c + dc >= size) | (c + dc < 0)
            out.append((np.ones(int(away.sum()), bool), r[away] + dr, c[away] + dc, at[r[away], c[away]]))
        asks, r, c, label = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"map_id": t.map_id, "asks": asks, "row": r + t.tr * size, "col": c + t.tc * size, "label": label})

    rims = each(labels, make, "map_id long, asks boolean, row int, col int, label long")
    has = rims.filter("NOT asks").select("map_id", "row", "col", F.col("label").alias("b"))
    return rims.filter("asks").select("map_id", "row", "col", F.col("label").alias("a")).join(has, ["map_id", "row", "col"]).select("map_id", "a", "b").distinct()


def region_tables(cells: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(LABELS rows, (map_id, tr, tc, label, component, cells)): each tile's labels and the regions they belong to.

    A region's component is the number of its first cell in the map.
    """
    return tile_regions(tiles(cells, size), size)


def tile_regions(tiled: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``region_tables`` of ``tiles``."""
    labels = cut(labelled(tiled, size))

    def make(t) -> pd.DataFrame:
        found, n = np.unique(_labels(t), return_counts=True)
        return pd.DataFrame({"map_id": t.map_id, "tr": t.tr, "tc": t.tc, "label": found[found >= 0], "cells": n[found >= 0]})

    own = each(labels, make, "map_id long, tr int, tc int, label long, cells long")
    known = components(border_links(labels, size)).withColumnRenamed("node", "label")
    return labels, own.join(known, ["map_id", "label"], "left").select(*TILE, "label", F.coalesce("component", "label").alias("component"), "cells")


def numbered_regions(parts: DataFrame, size: int) -> DataFrame:
    """(map_id, component, region): regions numbered from 1 in the row-major order of their first cells, by map.

    Counts of bands of rows are summed first, so no task sorts the regions of a whole map.
    """
    first = parts.select("map_id", "component").distinct().withColumn("band", F.shiftright("component", 32).cast("int"))
    first = first.withColumn("band", F.floor(F.col("band") / size))
    bands = first.groupBy("map_id", "band").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("map_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place_ = F.row_number().over(Window.partitionBy("map_id", "band").orderBy("component"))
    return first.join(bands.select("map_id", "band", before.alias("before")), ["map_id", "band"]).select("map_id", "component", (place_ + F.col("before")).cast("int").alias("region"))


def regions(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """map_id, row, col, region of the free cells: 8-connected regions, numbered from 1 in row-major order."""
    labels, parts = region_tables(cells, size)
    parts = cut(parts)
    known = parts.join(numbered_regions(parts, size), ["map_id", "component"]).groupBy(*TILE).agg(F.collect_list(F.struct("label", "region")).alias("known"))

    def make(t) -> pd.DataFrame:
        at = _labels(t)
        r, c = np.nonzero(at >= 0)
        label, region = (np.array([k[x] for k in t.known], np.int64) for x in ("label", "region"))
        order = np.argsort(label)
        found = region[order][np.searchsorted(label[order], at[r, c])]
        return pd.DataFrame({"map_id": t.map_id, "row": (r + t.tr * size).astype(np.int32), "col": (c + t.tc * size).astype(np.int32), "region": found.astype(np.int32)})

    return each(labels.join(known, TILE), make, "map_id long, row int, col int, region int")


# --- distances ----------------------------------------------------------------------------------------------------


def envelope(g2: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, column, start) of the parabolas (x - at)^2 + g2 on the lower envelope of each row, from left to right.

    ``g2`` is rows x parabolas, FAR where there is none; ``at`` their ascending columns. All rows go at once; a parabola is
    pushed once and popped once, so the work is linear in the cells.
    """
    n, m = g2.shape
    at = np.arange(m, dtype=np.int64) if at is None else at
    column, start, value = np.zeros((n, m), np.int64), np.zeros((n, m), np.int64), np.zeros((n, m), np.int64)
    k = np.zeros(n, np.int64)
    rows = np.arange(n)
    for j in range(m):
        live = rows[g2[:, j] < FAR]
        u, g = at[j], g2[:, j]
        begin = np.full(n, -FAR)
        while len(live):
            full = live[k[live] > 0]
            top = k[full] - 1
            i, f = column[full, top], value[full, top]
            # the first column where the new parabola is strictly lower than the top one
            cross = (u * u - i * i + g[full] - f) // (2 * (u - i)) + 1
            over = cross <= start[full, top]
            begin[full] = cross
            live = full[over]
            k[live] -= 1
            begin[live] = -FAR
        live = rows[g2[:, j] < FAR]
        column[live, k[live]], start[live, k[live]], value[live, k[live]] = u, begin[live], g[live]
        k[live] += 1
    return k, column, start


def row_distances(g2: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Least (x - at)^2 + g2 of each row at each of the ascending columns ``x``; FAR where a row has no parabola."""
    k, column, start = envelope(g2, at)
    out = np.full((len(g2), len(x)), FAR)
    if not len(at):
        return out
    where, rows = np.searchsorted(at, column), np.arange(len(g2))
    p = np.zeros(len(g2), np.int64)
    some = k > 0
    for j, u in enumerate(x.tolist()):
        while True:
            nxt = np.minimum(p + 1, np.maximum(k - 1, 0))
            go = (nxt > p) & (start[rows, nxt] <= u)
            if not go.any():
                break
            p[go] += 1
        q = column[rows, p]
        out[some, j] = ((u - q) ** 2 + g2[rows, where[rows, p]])[some]
    return out


def distances(cells: DataFrame, size: int = SIZE, ring: bool = False) -> DataFrame:
    """map_id, tr, tc, h, w, d2 (binary, int64): squared distance of each cell to the nearest that isn't free, exact.

    ``ring``: a border of obstacles around the map counts too. Without obstacles d2 is FAR.
    """
    return tile_distances(cut(tiles(cells, size)), size, ring)


def tile_distances(tiled: DataFrame, size: int = SIZE, ring: bool = False) -> DataFrame:
    """``distances`` of ``tiles``, which are read several times."""

    def strip(t) -> pd.DataFrame:
        wall = ~mask(t.free, t.h, t.w, size)
        any_ = wall.any(axis=0)
        first, last = wall.argmax(axis=0), t.h - 1 - wall[::-1].argmax(axis=0)
        base = t.tr * size
        return pd.DataFrame({"map_id": t.map_id, "tr": t.tr, "tc": t.tc, "k": np.arange(t.w, dtype=np.int32), "first": np.where(any_, first + base, -1), "last": np.where(any_, last + base, -1)})

    seen = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    strips = each(tiled, strip, "map_id long, tr int, tc int, k int, first long, last long").select(*TILE, "k", seen("first"), seen("last"))
    w = Window.partitionBy("map_id", "tc", "k").orderBy("tr")
    above = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    below = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = strips.select(*TILE, "k", above.alias("above"), below.alias("below")).groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct("k", "above", "below"))).alias("near"))
    sized = tiled.groupBy("map_id").agg(F.max(F.col("tr") * size + F.col("h")).cast("long").alias("height"), F.max(F.col("tc") * size + F.col("w")).cast("long").alias("width"))

    def gaps(t) -> np.ndarray:
        """Squared distance to the nearest obstacle of the same column."""
        wall, rows = ~mask(t.free, t.h, t.w, size), (np.arange(t.h) + t.tr * size)[:, None]
        none = [-1 if ring else -FAR, t.height if ring else FAR]
        over, under = (np.array([none[x] if v[k] is None else v[k] for v in t.near], np.int64) for x, k in enumerate(("above", "below")))
        up = np.maximum.accumulate(np.where(wall, rows, over), axis=0)
        down = np.minimum.accumulate(np.where(wall, rows, under)[::-1], axis=0)[::-1]
        gap = np.minimum(rows - up, down - rows)
        return np.where(gap >= 1 << 30, FAR, np.minimum(gap, 1 << 30) ** 2)

    def column_parts(held: list) -> pd.DataFrame:
        """What isn't lowest within the tile isn't lowest in the row. Tiles of one width, their rows below each other."""
        g2, out = np.concatenate([gaps(t) for t in held]), []
        k, column, _ = envelope(g2)
        r, p = np.nonzero(np.arange(column.shape[1]) < k[:, None])
        q = column[r, p]
        g, base = g2[r, q], 0
        for t in held:
            for a in range(0, t.h, BAND):
                h = min(BAND, t.h - a)
                x, y = np.searchsorted(r, (base + a, base + a + h))
                out.append((t.map_id, t.tr, a // BAND, t.tc, h, t.w, t.width, (r[x:y] - base - a).astype(np.int32).tobytes(), (q[x:y] + t.tc * size).tobytes(), g[x:y].tobytes()))
            base += t.h
        return pd.DataFrame(out, columns=["map_id", "tr", "band", "tc", "h", "w", "width", "r", "q", "g2"])

    parts = together(tiled.join(near, TILE).join(sized, "map_id"), "w", column_parts, "map_id long, tr int, band int, tc int, h int, w int, width long, r binary, q binary, g2 binary")

    def merge(held: list) -> pd.DataFrame:
        """Bands of maps of one width, their rows below each other."""
        width, edge = int(held[0].width), int(ring)
        at = np.arange(-edge, width + edge)
        g2, base, out = np.full((sum(t.h for t in held), len(at)), FAR), 0, []
        if ring:
            g2[:, [0, -1]] = 0
        for t in held:
            for p in t.parts:
                r, q, g = (np.frombuffer(p[c], kind) for c, kind in (("r", np.int32), ("q", np.int64), ("g2", np.int64)))
                g2[r + base, q + edge] = g
            base += t.h
        d2, base = row_distances(g2, at, np.arange(width)).astype(np.int64), 0
        for t in held:
            for p in t.parts:
                out.append((t.map_id, t.tr, p["tc"], t.band, t.h, p["w"], d2[base : base + t.h, p["tc"] * size : p["tc"] * size + p["w"]].tobytes()))
            base += t.h
        return pd.DataFrame(out, columns=["map_id", "tr", "tc", "band", "h", "w", "d2"])

    key = ["map_id", "tr", "band"]
    spark = tiled.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # few bytes and much work
    rows = parts.repartition(tasks, *key).groupBy(*key).agg(F.first("h").alias("h"), F.first("width").alias("width"), F.collect_list(F.struct("tc", "w", "r", "q", "g2")).alias("parts"))
    bands = together(rows, "width", merge, "map_id long, tr int, tc int, band int, h int, w int, d2 binary")
    whole = bands.groupBy(*TILE).agg(F.sum("h").cast("int").alias("h"), F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("band", "d2"))).alias("a"))
    return whole.select(*TILE, "h", "w", F.expr("aggregate(a, cast('' as binary), (x, y) -> concat(x, y.d2))").alias("d2"))


def distance_cells(dist: DataFrame, size: int = SIZE) -> DataFrame:
    """map_id, row, col, d2 (null where there is no obstacle) of ``distances``."""

    def make(t) -> pd.DataFrame:
        d = np.frombuffer(t.d2, np.int64)
        r, c = np.divmod(np.arange(len(d), dtype=np.int32), t.w)
        d2 = pd.array(np.minimum(d, 2**31 - 1).astype(np.int32), "Int32")
        d2[d >= FAR] = pd.NA
        return pd.DataFrame({"map_id": t.map_id, "row": r + t.tr * size, "col": c + t.tc * size, "d2": d2})

    return each(dist, make, "map_id long, row int, col int, d2 int")


# --- nearest nodes ------------------------------------------------------------------------------------------------


def settle(free: np.ndarray, seeds: np.ndarray, rim: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Each free cell's least key, steps * 2^32 + node order, from seeds (a raster of keys) and known cells around the tile."""
    h, w = free.shape
    key = np.full((h + 2, w + 2), FAR)
    inner = key[1:-1, 1:-1]
    inner[:] = np.where(free, seeds, FAR)
    r, c, k = rim
    np.minimum.at(key, (r + 1, c + 1), k)
    while True:
        best = np.minimum(np.minimum(key[:-2, 1:-1], key[2:, 1:-1]), np.minimum(key[1:-1, :-2], key[1:-1, 2:])) + STEP
        better = free & (best < inner)
        if not better.any():
            return inner.copy()
        inner[better] = best[better]


def nearest_nodes(cells: DataFrame, nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """map_id, row, col, label, hops of every cell: the node that a search from all nodes at once reaches first.

    cells(map_id, row, col, free), nodes(map_id, node_id, row, col). Steps go to the four neighbours over free cells. The
    search takes nodes in the order of node_id and cells in the order they were found, which gives each cell the least node
    order of those at the least number of steps. A message says the label of its node too, so no cell is joined with names. label is -1 (hops -1) where no node reaches, -2 where the cell isn't free;
    nodes on such cells, or outside, reach nothing. Of nodes on one cell, the first gives the order and the last the label.
    """
    return tile_nearest(tiles(cells, size), nodes, size)


def tile_nearest(tiled: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``nearest_nodes`` of ``tiles``."""
    at = place(nodes.select(F.col("map_id").cast("long").alias("map_id"), F.col("node_id").cast("int").alias("node_id"), "row", "col"), size).filter("row >= 0 AND col >= 0")
    at = at.groupBy(*TILE, "row", "col").agg(F.min("node_id").alias("order"), F.max("node_id").alias("label"))
    seeds = at.groupBy(*TILE).agg(F.collect_list(F.struct(local(size).alias("at"), "order", "label")).alias("seeds"))
    tiled = cut(tiled.join(bulky(seeds), TILE, "left"))

    def solved(t, inbox) -> np.ndarray:
        free = mask(t.free, t.h, t.w, size)
        start = np.full((t.h, t.w), FAR)
        for s in () if t.seeds is None else t.seeds:
            r, c = divmod(s["at"], size)
            if r < t.h and c < t.w:
                start[r, c] = s["order"]
        got = () if inbox is None else inbox
        rim = np.array([(m["row"], m["col"], m["key"]) for m in got], np.int64).reshape(-1, 3).T
        return settle(free, start, (rim[0] - t.tr * size, rim[1] - t.tc * size, rim[2]))

    def named(t, key: np.ndarray) -> np.ndarray:
        """The labels of keys: each one's order is that of a node in the tile or of a message, which both say its label."""
        said = np.array(sorted({(x["order"], x["label"]) for x in (() if t.seeds is None else t.seeds)} | {(m["key"] % STEP, m["label"]) for m in (() if t.inbox is None else t.inbox)}), np.int64).reshape(-1, 2)
        return said[np.searchsorted(said[:, 0], key % STEP), 1]

    def send(t) -> pd.DataFrame:
        key, out = solved(t, t.inbox), []
        for dr, dc, r, c in ((-1, 0, np.zeros(t.w, int), np.arange(t.w)), (1, 0, np.full(t.w, t.h - 1), np.arange(t.w)), (0, -1, np.arange(t.h), np.zeros(t.h, int)), (0, 1, np.arange(t.h), np.full(t.h, t.w - 1))):
            some = key[r, c] < FAR
            out.append(pd.DataFrame({"map_id": t.map_id, "tr": t.tr + dr, "tc": t.tc + dc, "row": r[some] + t.tr * size, "col": c[some] + t.tc * size, "key": key[r, c][some], "label": named(t, key[r, c][some])}))
        return pd.concat(out)

    message = "map_id long, tr int, tc int, row int, col int, key long, label int"
    per_tile = lambda m: m.groupBy(*TILE).agg(F.collect_list(F.struct("row", "col", "key", "label")).alias("inbox"))
    none = F.lit(None).cast("array<struct<row:int,col:int,key:bigint,label:int>>").alias("inbox")
    there = tiled.select(*TILE)
    new = cut(each(tiled.filter("seeds IS NOT NULL").select("*", none), send, message).join(there, TILE, "left_semi"))
    sent = None
    while not new.isEmpty():
        sent = new if sent is None else sent.union(new)
        awake = sent.join(new.select(*TILE).distinct(), TILE, "left_semi")
        told = sent.groupBy(*TILE, "row", "col").agg(F.min("key").alias("told"))
        said = each(tiled.join(per_tile(awake), TILE), send, message).join(there, TILE, "left_semi")
        new = cut(said.join(bulky(told), [*TILE, "row", "col"], "left").filter("told IS NULL OR key < told").drop("told"))
    last = tiled.join(per_tile(sent), TILE, "left") if sent is not None else tiled.select("*", none)

    def show(t) -> pd.DataFrame:
        key, free = solved(t, t.inbox).ravel(), mask(t.free, t.h, t.w, size).ravel()
        r, c = np.divmod(np.arange(len(key), dtype=np.int32), t.w)
        there = key < FAR
        label = np.where(free, -1, -2)
        label[there] = named(t, key[there])
        return pd.DataFrame({"map_id": t.map_id, "row": r + t.tr * size, "col": c + t.tc * size, "label": label.astype(np.int32), "hops": np.where(there, key // STEP, -1).astype(np.int32)})

    return bulky(each(last, show, "map_id long, row int, col int, label int, hops int"))


# --- coverage -----------------------------------------------------------------------------------------------------


def coverage(cells: DataFrame, nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """By map: free_space_coverage (share of the free cells in regions with a node), average_distance_to_node and
    max_distance_to_node over those regions' cells, and coverage_efficiency (coverage by node).

    cells(map_id, row, col, free) hold every cell, nodes(map_id, row, col) one row a node. Free is the map's own free space,
    not inflated. No free cell or no node: 0 and nulls. A node on a cell that isn't free covers no region, and distances go
    to it as to any other; one outside its map is an error.
    """
    return tile_coverage(cut(tiles(cells, size)), nodes, size)


def tile_coverage(tiled: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``coverage`` of ``tiles``, which are read several times."""
    at = cut(place(nodes.select(F.col("map_id").cast("long").alias("map_id"), "row", "col"), size))
    known = at.join(tiled.select("map_id").distinct(), "map_id", "left_semi").join(tiled.select(*TILE, "h", "w"), TILE, "left")
    inside = (F.col("row") - F.col("tr") * size < F.col("h")) & (F.col("col") - F.col("tc") * size < F.col("w"))
    lost = known.filter(~F.coalesce(inside, F.lit(False))).limit(1).collect()
    if lost:
        raise ValueError(f"map {lost[0]['map_id']}: a node lies outside the map")
    labels, parts = tile_regions(tiled, size)
    held = at.distinct().groupBy(*TILE).agg(F.collect_list(local(size)).alias("at"))
    marked = cut(tiled.select(*TILE, "h", "w").join(held, TILE, "left"))

    def without(t) -> pd.DataFrame:
        """The tile with its nodes as the only cells that aren't free."""
        free = np.ones((t.h, size), bool)
        free[:, t.w :] = False
        if t.at is not None:
            free.ravel()[np.asarray(t.at, np.int64)] = False
        return pd.DataFrame({"map_id": [t.map_id], "tr": [t.tr], "tc": [t.tc], "h": [t.h], "w": [t.w], "free": [np.flatnonzero(free).astype(np.int32)]})

    to_node = tile_distances(cut(each(marked, without, "map_id long, tr int, tc int, h int, w int, free array<int>")), size)

    def sums(t) -> pd.DataFrame:
        label, d = _labels(t).ravel(), np.sqrt(np.frombuffer(t.d2, np.int64).astype(float)).astype(np.float32).astype(float)
        known, back = np.unique(label, return_inverse=True)
        nodes_ = np.zeros(len(known), np.int64)
        most = np.full(len(known), -1.0)
        np.maximum.at(most, back, d)
        if t.at is not None:
            r, c = np.divmod(np.asarray(t.at, np.int64), size)
            np.add.at(nodes_, back[r * t.w + c], 1)
        out = pd.DataFrame({"map_id": t.map_id, "tr": t.tr, "tc": t.tc, "label": known, "total": np.bincount(back, d), "most": most, "nodes": nodes_})
        return out[out["label"] >= 0]

    tile = labels.join(bulky(to_node.select(*TILE, "d2")), TILE).join(bulky(marked.select(*TILE, "at")), TILE)
    stats = each(tile, sums, "map_id long, tr int, tc int, label long, total double, most double, nodes long").join(bulky(parts), [*TILE, "label"])
    region = stats.groupBy("map_id", "component").agg(F.sum("cells").alias("cells"), F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("nodes").alias("nodes"))
    covered = F.col("nodes") > 0
    by_map = region.groupBy("map_id").agg(F.sum("cells").alias("free"), F.sum(F.when(covered, F.col("cells"))).alias("covered"), F.sum(F.when(covered, F.col("total"))).alias("total"), F.max(F.when(covered, F.col("most"))).alias("most"))
    count = at.groupBy("map_id").agg(F.count("*").alias("n"))
    out = tiled.select("map_id").distinct().join(by_map, "map_id", "left").join(count, "map_id", "left")
    share = F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.col("covered") / F.col("free"), F.lit(0.0)))
    return out.select("map_id", share.alias("free_space_coverage"), F.when(F.col("n").isNotNull(), F.col("total") / F.col("covered")).alias("average_distance_to_node"), F.when(F.col("n").isNotNull(), F.col("most")).alias("max_distance_to_node"), F.coalesce(share / F.col("n"), F.lit(0.0)).alias("coverage_efficiency"))
