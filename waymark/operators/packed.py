"""Rasters packed as one binary a map, so that cells never cross an exchange: distances, blocked cells, values on lines.

packed(map_id, height, width, walls): obstacle cells as row * width + col. distances(map_id, height, width, d2, far): d2 is a
row-major little-endian int32 raster; far says that the map has no obstacle. Lines are dealt to a map's raster in parts of
``PART`` lines, so a busy map is many tasks; the raster goes to each part once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import line_cells
from ..shared import bulky
from .kernels import squared_distance

PART = 20_000
DISTANCES = "map_id long, height int, width int, d2 binary, far boolean"


def pack_walls(obstacles: DataFrame, height: int, width: int) -> DataFrame:
    """packed rows of obstacles(map_id, row, col) on maps of one size: the only exchange of cells, and of obstacles alone."""
    at = (F.col("row") * width + F.col("col")).cast("int")
    return obstacles.groupBy(F.col("map_id").cast("long").alias("map_id")).agg(F.collect_set(at).alias("walls")).select("map_id", F.lit(height).alias("height"), F.lit(width).alias("width"), "walls")


HELD = 256  # maps whose rasters a task holds at once


def _slices(batches):
    """Batches of at most ``HELD`` maps: a raster is much larger than the walls it comes from."""
    for b in batches:
        for a in range(0, b.num_rows, HELD):
            yield b.slice(a, HELD)


def _rasters(b: pa.RecordBatch, ring: bool):
    """(map_id, d2, far) of each map of a batch of packed rows."""
    for map_id, h, w, walls in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
        free = np.ones(h * w, bool)
        free[walls.values.to_numpy()] = False
        free = free.reshape(h, w)
        d2 = squared_distance(np.pad(free, 1))[1:-1, 1:-1] if ring else squared_distance(free)
        yield map_id, np.minimum(d2, 2**31 - 1).astype("<i4"), bool(free.all()) and not ring


def _dealt(packed: DataFrame) -> DataFrame:
    """Few bytes and much work a map: enough partitions for all cores."""
    spark = packed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return packed.select("map_id", "height", "width", "walls").repartition(parts, "map_id")


def distances(packed: DataFrame, ring: bool = True) -> DataFrame:
    """Exact squared distances to the nearest obstacle; ``ring``: a border around the map counts as one."""

    def run(batches):
        for b in _slices(batches):
            _, d2, far = zip(*_rasters(b, ring), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([d.tobytes() for d in d2], pa.binary()), pa.array(far, pa.bool_())], ["map_id", "height", "width", "d2", "far"])

    return _dealt(packed).mapInArrow(run, DISTANCES)


def cells(packed: DataFrame, ring: bool = True) -> DataFrame:
    """map_id, row, col, free, d2 (null without obstacles) of every cell of packed maps, a map at a time: rasters stay in the task."""

    def run(batches):
        for b in _slices(batches):
            for map_id, d, far in _rasters(b, ring):
                at = np.arange(d.size, dtype=np.int32)
                shown = pa.nulls(d.size, pa.int32()) if far else pa.array(d.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d.size, map_id, np.int64)), pa.array(at // d.shape[1]), pa.array(at % d.shape[1]), pa.array(d.ravel() > 0), shown], ["map_id", "row", "col", "free", "d2"])

    return _dealt(packed).mapInArrow(run, "map_id long, row int, col int, free boolean, d2 int")


def maxima(packed: DataFrame, above: float = 2.0, ring: bool = True) -> DataFrame:
    """Cells whose distance is the greatest of their 3x3 neighbourhood and over ``above``; plateaus all count."""

    def run(batches):
        for b in _slices(batches):
            for map_id, d, _ in _rasters(b, ring):
                h, w = d.shape
                p = np.pad(d, 1, constant_values=-1)
                top = np.max([p[a : a + h, c : c + w] for a in range(3) for c in range(3)], axis=0)
                r, c = np.nonzero((d == top) & (np.sqrt(d).astype(np.float32) > np.float32(above)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), map_id, np.int64)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(d[r, c].astype(np.int32))], ["map_id", "row", "col", "d2"])

    return _dealt(packed).mapInArrow(run, "map_id long, row int, col int, d2 int")


def walks(r0: np.ndarray, c0: np.ndarray, r1: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, row, col) of the cells on all lines; the closed form of ``geometry.line_cells``."""
    dr, dc = np.abs(r1 - r0), np.abs(c1 - c0)
    n, m = np.maximum(dr, dc), np.minimum(dr, dc)
    line = np.repeat(np.arange(len(n)), n + 1)
    i = np.arange(len(line)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    k = np.where(n[line] == 0, 0, (2 * i * m[line] + n[line] - 1) // np.maximum(1, 2 * n[line]))
    wide = (dc >= dr)[line]
    row = r0[line] + np.sign(r1 - r0)[line] * np.where(wide, k, i)
    return line, row, c0[line] + np.sign(c1 - c0)[line] * np.where(wide, i, k)


def meets(lines: DataFrame, obstacles: DataFrame, drawn: bool = False) -> DataFrame:
    """Adds hit to lines(map_id, r0, c0, r1, c1): whether a cell of the line is among obstacles(map_id, row, col).

    A map's obstacles go to its lines as one array; lines' cells are never rows.
    """
    at = lambda r, c: F.shiftleft(r.cast("long"), 32) + c.cast("long")
    walls = obstacles.groupBy("map_id").agg(F.collect_set(at(F.col("row"), F.col("col"))).alias("walls"))
    cells = F.transform(line_cells(*map(F.col, ("r0", "c0", "r1", "c1")), drawn=drawn), lambda p: at(p["row"], p["col"]))
    return bulky(lines).join(bulky(walls), "map_id", "left").withColumn("hit", F.coalesce(F.arrays_overlap(cells, F.col("walls")), F.lit(False))).drop("walls")


LINE = "map_id long, line_id long, collides boolean, ok0 boolean, ok1 boolean, clearance double, n_cells long"


def on_lines(lines: DataFrame, dist: DataFrame, *, safety: float, resolution: float) -> DataFrame:
    """LINE rows of lines(map_id, line_id, r0, c0, r1, c1) on the maps of ``dist``; lines of other maps are left out.

    collides: a cell on the line is blocked (closer than safety, in 32-bit floats) or an end outside the map. ok0, ok1:
    the ends are inside and free. clearance: mean distance over the line's cells inside the map; n_cells their number.
    """
    plain = lines.select(F.col("map_id").cast("long").alias("map_id"), F.col("line_id").cast("long").alias("line_id"), *[F.col(c).cast("int").alias(c) for c in ("r0", "c0", "r1", "c1")])
    parts = plain.groupBy("map_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = plain.join(parts, "map_id").withColumn("part", F.pmod(F.xxhash64("line_id"), F.col("parts")).cast("int")).drop("parts")
    copies = dist.join(parts, "map_id").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("map_id", "part", "height", "width", "d2")

    def run(key: tuple, x: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(maps):
            return pd.DataFrame(columns=["map_id", "line_id", "collides", "ok0", "ok1", "clearance", "n_cells"])
        h, w = int(maps["height"].iat[0]), int(maps["width"].iat[0])
        far = np.sqrt(np.frombuffer(maps["d2"].iat[0], "<i4")).reshape(h, w)
        blocked = far.astype(np.float32) < np.float32(safety / resolution)
        r0, c0, r1, c1 = (x[c].to_numpy(np.int64) for c in ("r0", "c0", "r1", "c1"))

        def free(r, c):
            inside = (r >= 0) & (r < h) & (c >= 0) & (c < w)
            return inside, inside & ~blocked[np.where(inside, r, 0), np.where(inside, c, 0)]

        (in0, ok0), (in1, ok1) = free(r0, c0), free(r1, c1)
        hit, total, n = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for a in range(0, len(x), 5000):
            line, row, col = walks(*(v[a : a + 5000] for v in (r0, c0, r1, c1)))
            inside = (row >= 0) & (row < h) & (col >= 0) & (col < w)
            line, row, col = line[inside], row[inside], col[inside]
            size = len(x[a : a + 5000])
            hit[a : a + 5000] = np.bincount(line, blocked[row, col], size)
            total[a : a + 5000] = np.bincount(line, far[row, col], size)
            n[a : a + 5000] = np.bincount(line, minlength=size)
        mean = np.divide(total, n, out=np.full(len(x), np.nan), where=n > 0)
        return pd.DataFrame({"map_id": x["map_id"], "line_id": x["line_id"], "collides": (hit > 0) | ~in0 | ~in1, "ok0": ok0, "ok1": ok1, "clearance": mean, "n_cells": n})

    return dealt.groupBy("map_id", "part").cogroup(copies.groupBy("map_id", "part")).applyInPandas(run, LINE)
