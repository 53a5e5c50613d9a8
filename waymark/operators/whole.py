"""Maps that fit into one tile, whole and many at a time: what tiles do by rounds, without an exchange between cells.

A map of at most ``WHOLE`` cells, one tile of the usual width, is one row and goes to one task; maps of one size are stacked to
arrays (maps, height, width) of about ``SENT`` cells. Larger maps go over tiles as ever, whatever the tiles' width. Both
forms give the same rows; the tests hold them against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bulky, cut
from . import kernels
from .tiles import FAR, SENT, SIZE, STEP, TILE, label_tile, tiles

WHOLE = SIZE * SIZE
SQUARES = "map_id long, tr int, tc int, h int, w int, bits binary"


def _squares(tiled: DataFrame, size: int) -> DataFrame:
    """SQUARES rows of ``tiles``: the free cells as bits, ``size`` to a row whatever the tile's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, 4 * SENT // size**2)
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                free = b.column("free")
                at = np.repeat(np.arange(b.num_rows), free.value_lengths().to_numpy())
                flat = np.zeros((b.num_rows, size * size), bool)
                flat[at, free.flatten().to_numpy()] = True
                bits = pa.array([x.tobytes() for x in np.packbits(flat, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*TILE, "h", "w")), bits], [*TILE, "h", "w", "bits"])

    return tiled.select(*TILE, "h", "w", "free").mapInArrow(run, SQUARES)


def tasks(df: DataFrame) -> int:
    """Few bytes and much work a map."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)


def _packed(maps: DataFrame, size: int, whole: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    maps = cut(maps.select(F.col("map_id").cast("long").alias("map_id"), "height", "width", "walls"))
    few = F.col("height").cast("long") * F.col("width") <= whole
    sized, large = maps.select("map_id", "height", "width", few.alias("few")), None
    if not maps.filter(~few).isEmpty():
        cells = maps.filter(~few).withColumn("at", F.explode(F.expr("sequence(0, height * width - 1)")))
        cells = cells.select("map_id", F.expr("at div width").cast("int").alias("row"), (F.col("at") % F.col("width")).alias("col"), (~F.array_contains("walls", F.col("at"))).alias("free"))
        large = cut(tiles(cells, size))
    return maps.filter(few).repartition(tasks(maps), "map_id"), large, sized


def parted(cells: DataFrame, size: int = SIZE, whole: int | None = None, nulls: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(map_id, height, width, parts) of the maps of at most ``whole`` cells, ``tiles`` of all others (None: there are none),
    and map_id, height, width, few (it is one of the first) of every map. cells(map_id, row, col, free), or packed maps (map_id, height, width, walls: row * width + col), whose cells
    are no rows unless they are too many. ``nulls``: a map without an id stays.
    """
    if "walls" in cells.columns:
        return _packed(cells if nulls else cells.filter("map_id IS NOT NULL"), size, WHOLE if whole is None else whole)
    tiled = cut(tiles(cells, size) if nulls else tiles(cells.filter("map_id IS NOT NULL"), size))
    sized = tiled.groupBy("map_id").agg(F.max(F.col("tr") * size + F.col("h")).cast("int").alias("height"), F.max(F.col("tc") * size + F.col("w")).cast("int").alias("width"))
    sized = sized.withColumn("few", F.col("height").cast("long") * F.col("width") <= (WHOLE if whole is None else whole))
    if sized.filter("NOT few").isEmpty():
        large, mine = None, tiled
    else:
        large, mine = (cut(tiled.join(bulky(sized.filter("few")), "map_id", how)) for how in ("left_anti", "left_semi"))
    one = _squares(mine, size).repartition(tasks(tiled), "map_id").groupBy("map_id")
    rows = one.agg(F.max(F.col("tr") * size + F.col("h")).cast("int").alias("height"), F.max(F.col("tc") * size + F.col("w")).cast("int").alias("width"), F.collect_list(F.struct("tr", "tc", "bits")).alias("parts"))
    return rows, large, sized


def _stack(rows: list, h: int, w: int, size: int) -> np.ndarray:
    if hasattr(rows[0], "walls"):
        free = np.ones((len(rows), h * w), bool)
        for k, r in enumerate(rows):
            free[k, np.asarray(r.walls, np.int64)] = False
        return free.reshape(-1, h, w)
    up, across = -(-h // size) * size, -(-w // size) * size
    out = np.zeros((len(rows), up, across), bool)
    for k, r in enumerate(rows):
        for p in r.parts:
            a, b = p["tr"] * size, p["tc"] * size
            out[k, a : a + size, b : b + size] = np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=size * size).reshape(size, size)
    return out[:, :h, :w]


def stacked(rows: DataFrame, size: int, make: Callable[[list, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``make`` gives for (rows of maps of one height and width, their free cells as one array)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (h, w), same in b.groupby(["height", "width"]):
                step = max(1, SENT // (int(h) * int(w)))
                for a in range(0, len(same), step):
                    held = list(same.iloc[a : a + step].itertuples(index=False))
                    yield make(held, _stack(held, int(h), int(w), size))

    return rows.mapInPandas(run, schema)


def clear(free: np.ndarray, least: float) -> np.ndarray:
    """The cells ``least`` or more from an obstacle, a border around the map counted as one; compared in 32-bit floats."""
    d2 = kernels.squared_distance(np.pad(free, ((0, 0), (1, 1), (1, 1))))[:, 1:-1, 1:-1]
    return np.sqrt(d2).astype(np.float32) >= np.float32(least)


def name(t) -> int | None:
    """The map's id; pandas makes floats of a column with nulls."""
    return None if pd.isna(t.map_id) else int(t.map_id)


def cells_of(held: list, cells: np.ndarray) -> pd.DataFrame:
    """map_id, row, col of the set cells of a stack."""
    k, r, c = np.nonzero(cells)
    return pd.DataFrame({"map_id": np.array([t.map_id for t in held], np.int64)[k], "row": r.astype(np.int32), "col": c.astype(np.int32)})


def lines_of(held: list, lines: list[list], key: str, kind: type) -> pd.DataFrame:
    """map_id, ``key``, i, row, col of each map's lines of points."""
    n = np.array([len(x) for per in lines for x in per], np.int64)
    at = np.repeat(np.arange(len(n)), n)
    ids = np.repeat(np.array([t.map_id for t in held], np.int64), [len(per) for per in lines])
    number = np.concatenate([np.arange(len(per), dtype=np.int32) for per in lines])
    points = np.concatenate([np.asarray(x, kind).reshape(-1, 2) for per in lines for x in per] or [np.zeros((0, 2), kind)])
    i = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return pd.DataFrame({"map_id": ids[at], key: number[at], "i": i.astype(np.int32), "row": points[:, 0], "col": points[:, 1]})


def covered(held: list, free: np.ndarray) -> pd.DataFrame:
    """COVERED rows of maps with nodes at(row, col, n): a cell that holds nodes, and how many."""
    at, n = np.zeros(free.shape, bool), np.zeros(len(free), np.int64)
    for k, t in enumerate(held):
        for p in () if t.at is None else t.at:
            at[k, p["row"], p["col"]] = True
            n[k] += p["n"]
    return cover(held, free, at, n)


def cover(held: list, free: np.ndarray, at: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """COVERED rows of maps whose cells ``at`` hold ``n`` nodes in all."""
    m, h, w = free.shape
    label = label_tile(np.pad(free, ((0, 0), (0, 1), (0, 0))).reshape(-1, w)).reshape(m, h + 1, w)[:, :h]  # a wall between two maps
    far = np.sqrt(kernels.squared_distance(~at).astype(float)).astype(np.float32).astype(float)
    nodes = np.zeros(m * (h + 1) * w, bool)
    nodes[label[at & free]] = True
    inside = free & nodes[np.maximum(label, 0)]
    rows = []
    for k, t in enumerate(held):
        d, total = far[k][inside[k]], int(free[k].sum())
        share = len(d) / total if total and n[k] else 0.0
        rows.append((name(t), share, float(d.sum()) / len(d) if len(d) else None, float(d.max()) if len(d) else None, share / int(n[k]) if n[k] else 0.0))
    return pd.DataFrame(rows, columns=["map_id", "free_space_coverage", "average_distance_to_node", "max_distance_to_node", "coverage_efficiency"]).astype({"map_id": "Int64"})


COVERED = "map_id long, free_space_coverage double, average_distance_to_node double, max_distance_to_node double, coverage_efficiency double"


def settled(held: list, free: np.ndarray) -> pd.DataFrame:
    """map_id, row, col, label, hops of ``tiles.nearest_nodes`` of maps with nodes seeds(row, col, order, label)."""
    m, h, w = free.shape
    key = np.full((m, h + 2, w + 2), FAR)
    inner, said = key[:, 1:-1, 1:-1], []
    for k, t in enumerate(held):
        for p in () if t.seeds is None else t.seeds:
            r, c = p["row"], p["col"]
            if 0 <= r < h and 0 <= c < w and free[k, r, c]:
                inner[k, r, c] = p["order"]
                said.append((k, p["order"], p["label"]))
    while True:
        best = np.minimum(np.minimum(key[:, :-2, 1:-1], key[:, 2:, 1:-1]), np.minimum(key[:, 1:-1, :-2], key[:, 1:-1, 2:])) + STEP
        better = free & (best < inner)
        if not better.any():
            break
        inner[better] = best[better]
    there, label = inner < FAR, np.where(free, -1, -2).astype(np.int32)
    names = np.array(sorted(said), np.int64).reshape(-1, 3)
    at = np.nonzero(there)
    label[at] = names[np.searchsorted(names[:, 0] * STEP + names[:, 1], at[0] * STEP + inner[at] % STEP), 2]
    k, r, c = (x.ravel() for x in np.indices(free.shape, np.int32))
    ids = pd.array([name(t) for t in held], "Int64")
    return pd.DataFrame({"map_id": ids[k], "row": r, "col": c, "label": label.ravel(), "hops": np.where(there, inner // STEP, -1).astype(np.int32).ravel()})
