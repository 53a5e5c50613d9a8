"""Nodes at distance maxima of free space, over tiles: no task holds a map.

A sweep places nodes at the maxima that lie far from obstacles and from all nodes; of maxima in one box of ``limit`` cells the
first in row-major order stands. That choice goes by rounds: a maximum with no earlier open one in its box is taken, and
the open ones in its box fall away. A tile decides for itself from its neighbours' rims, as wide as two boxes' halves. Sweeps
repeat on the maps where something was placed, with the distances to the new nodes, until no place is far from all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .shapes import STATE, numbered, state_cells, window, windows
from .tiles import SIZE, TILE, each, local, place, tile_distances, tiles


def maxima(dist: DataFrame, limit: int) -> DataFrame:
    """STATE of the cells of ``tiles.distances`` that are over ``limit``, and not less than any of their eight neighbours."""

    def send(t) -> pd.DataFrame:
        own, out = np.frombuffer(t.d2, np.int64).reshape(t.h, t.w), []
        pick = {-1: slice(-1, None), 0: slice(None), 1: slice(0, 1)}
        for dr in pick:
            for dc in pick:  # to the tile at (tr - dr, tc - dc), for which this one lies at (dr, dc)
                part = own[pick[dr], pick[dc]]
                out.append((t.map_id, t.tr - dr, t.tc - dc, dr, dc, *part.shape, part.tobytes()))
        return pd.DataFrame(out, columns=["map_id", "tr", "tc", "dr", "dc", "ph", "pw", "part"])

    sent = each(dist, send, "map_id long, tr int, tc int, dr int, dc int, ph int, pw int, part binary")
    rims = sent.groupBy(*TILE).agg(F.collect_list(F.struct("dr", "dc", "ph", "pw", "part")).alias("parts"))

    def make(t) -> pd.DataFrame:
        d = np.full((t.h + 2, t.w + 2), -1, np.int64)
        for p in t.parts:
            r, c = (0 if p[x] < 0 else n + 1 if p[x] > 0 else 1 for x, n in (("dr", t.h), ("dc", t.w)))
            d[r : r + p["ph"], c : c + p["pw"]] = np.frombuffer(p["part"], np.int64).reshape(p["ph"], p["pw"])
        top = np.max([d[a : a + t.h, b : b + t.w] for a in range(3) for b in range(3)], axis=0)
        own = d[1:-1, 1:-1]
        peak = (own == top) & (np.sqrt(own).astype(np.float32) > np.float32(limit))
        return pd.DataFrame({"map_id": [t.map_id], "tr": [t.tr], "tc": [t.tc], "h": [t.h], "w": [t.w], "bits": [np.packbits(peak).tobytes()]})

    return each(rims.join(dist.select(*TILE, "h", "w"), TILE), make, STATE)


def _least(a: np.ndarray, k: int) -> np.ndarray:
    """The least value within k cells either way; k cells less on every side."""
    for axis in (0, 1):
        a = np.lib.stride_tricks.sliding_window_view(a, 2 * k + 1, axis=axis).min(axis=-1)
    return a


def first_in_box(state: DataFrame, k: int, size: int = SIZE) -> DataFrame:
    """map_id, row, col of the set cells that are taken in row-major order, each unless one within k rows and columns was."""
    if 2 * k > size:
        raise ValueError("a box must not be wider than a tile")

    def make(t) -> pd.DataFrame:
        cells = window(t, 2 * k)
        at = np.arange(cells.size).reshape(cells.shape)
        mid, inner = ((slice(n, n + t.h + m), slice(n, n + t.w + m)) for n, m in ((k, 2 * k), (2 * k, 0)))
        taken = cells[mid] & (_least(np.where(cells, at, cells.size), k) == at[mid])
        left = cells[inner] & _least(~taken, k)
        return pd.DataFrame({"map_id": [t.map_id], "tr": [t.tr], "tc": [t.tc], "h": [t.h], "w": [t.w], "bits": [np.packbits(left).tobytes()], "taken": [np.packbits(taken[k : k + t.h, k : k + t.w]).tobytes()], "open": [bool(left.any())]})

    def any_(t) -> pd.DataFrame:
        return pd.DataFrame({"map_id": [t.map_id], "tr": [t.tr], "tc": [t.tc], "h": [t.h], "w": [t.w], "bits": [t.bits], "open": [any(t.bits)]})

    now, found = cut(each(state, any_, STATE + ", open boolean")), []
    while not (awake := now.filter("open").select(*TILE)).isEmpty():
        # tiles without open cells have nothing to send either
        now = cut(each(windows(now.filter("open").drop("open", "taken"), 2 * k, size, awake), make, STATE + ", taken binary, open boolean"))
        found.append(state_cells(now.select(*TILE, "h", "w", F.col("taken").alias("bits")), size))
    return reduce(DataFrame.union, found) if found else state_cells(state.limit(0), size)


def sampled(cells: DataFrame, limit: int, size: int = SIZE, nodes: DataFrame | None = None) -> DataFrame:
    """map_id, node_id, row, col: the nodes placed in cells(map_id, row, col, free), numbered from 0 in the order of placing.

    ``nodes(map_id, row, col)`` are there before, and not returned. ``limit``, in cells, is at most ``size``.
    """
    return sampled_tiles(tiles(cells, size), limit, size, nodes)


def sampled_tiles(tiled: DataFrame, limit: int, size: int = SIZE, nodes: DataFrame | None = None) -> DataFrame:
    """``sampled`` of ``tiles``."""

    def without(tiled: DataFrame, points: DataFrame) -> DataFrame:
        taken = place(points, size).groupBy(*TILE).agg(F.collect_list(local(size)).alias("taken"))
        free = F.when(F.col("taken").isNull(), F.col("free")).otherwise(F.array_except("free", "taken"))
        return tiled.join(taken, TILE, "left").select(*TILE, "h", "w", free.alias("free"))

    now = cut(tiled if nodes is None else without(tiled, nodes.select(F.col("map_id").cast("long").alias("map_id"), "row", "col")))
    found = []
    while True:
        new = cut(first_in_box(maxima(cut(tile_distances(now, size)), limit), limit // 2, size))
        if new.isEmpty():
            break
        found.append(new.withColumn("at", F.lit(len(found)).cast("long") * F.lit(1 << 52) + F.col("row").cast("long") * F.lit(1 << 26) + F.col("col")))
        now = cut(without(now.join(new.select("map_id").distinct(), "map_id", "left_semi"), new))
    every = reduce(DataFrame.union, found) if found else new.withColumn("at", F.lit(0).cast("long"))
    return numbered(every, "at", shift=32).select("map_id", F.col("number").alias("node_id"), "row", "col")
