"""Raster operators over cells(map_id, row, col, value): threshold, distance, inflation, maxima."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bulky

KEY = ["map_id", "row", "col"]
TASK_CELLS = 64_000_000


def threshold(cells: DataFrame, limit: int = 127) -> DataFrame:
    """Adds free: value above the limit, strictly."""
    return cells.withColumn("free", F.col("value") > limit)


def free_ratio(cells: DataFrame, limit: int = 127) -> DataFrame:
    """Cells, free cells and whether all are free, by map."""
    t = threshold(cells, limit)
    return t.groupBy("map_id").agg(F.count("*").alias("n_cells"), F.sum(F.col("free").cast("long")).alias("n_free"), F.bool_and("free").alias("all_free"))


def distance(cells: DataFrame, limit: int = 127, ring: bool = True, most: int = TASK_CELLS) -> DataFrame:
    """map_id, row, col, free, d2: squared distance to the nearest cell that isn't free, exact, in integers.

    Maps of up to ``most`` cells are one grouped-map task each; if the largest has more (counted first), all go by rows
    in ``distance_by_rows``, which holds no map in a task but took over 20 s for 1,000 maps of 48 x 64 cells.
    """
    from .build import spread
    from .kernels import squared_distance

    kind = dict(cells.dtypes)["map_id"]
    if (cells.groupBy("map_id").count().agg(F.max("count")).first()[0] or 0) > most:
        return distance_by_rows(cells, limit, ring).withColumn("d2", F.col("d2").cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        free = np.zeros((r.max() + 1, c.max() + 1), bool)
        free[r, c] = pdf["value"].to_numpy() > limit
        walls = not free.all()
        d2 = squared_distance(np.pad(free, 1))[1:-1, 1:-1] if ring else squared_distance(free)
        out = pdf[["map_id", "row", "col"]].assign(free=free[r, c])
        return out.assign(d2=pd.Series(d2[r, c], dtype="Int32") if ring or walls else pd.Series([None] * len(out), dtype="Int32"))

    return spread(cells.select(*KEY, "value")).groupBy("map_id").applyInPandas(run, f"map_id {kind}, row int, col int, free boolean, d2 int")


def distance_by_rows(cells: DataFrame, limit: int = 127, ring: bool = True) -> DataFrame:
    """For maps too large for one task: map_id, row, col, free, d2: squared distance to the nearest cell that isn't free, exact, in integers.

    Separable: nearest obstacle in the column from two running windows, then, for each row, the least of gap squared
    plus column distance squared, inside the row's array. Two exchanges, by (map, column) and (map, row); no self-join.
    ring: a border of obstacles around the map counts. Without it, and without obstacles, d2 is null.
    """
    t = threshold(cells, limit)
    up = Window.partitionBy("map_id", "col").orderBy("row")
    down = Window.partitionBy("map_id", "col").orderBy(F.col("row").desc())
    wall = F.when(~F.col("free"), F.col("row"))
    above, below = F.last(wall, ignorenulls=True).over(up), F.last(wall, ignorenulls=True).over(down)
    gap = F.least(F.col("row") - above, below - F.col("row"))
    g = t.select(*KEY, "free", gap.alias("gap"))
    rows = g.groupBy("map_id", "row").agg(F.collect_list(F.struct("col", "gap", "free")).alias("line"))
    walls = F.filter("line", lambda x: x["gap"].isNotNull())
    # columns with a wall, once for a row; then each cell looks through them
    rows = rows.withColumn("walls", walls)
    nearest = F.transform("line", lambda x: F.struct(x["col"].alias("col"), x["free"].alias("free"), F.array_min(F.transform("walls", lambda y: y["gap"] * y["gap"] + (y["col"] - x["col"]) * (y["col"] - x["col"]))).alias("d2")))
    out = rows.select("map_id", "row", F.inline(nearest))
    if ring:
        size = cells.groupBy("map_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
        edge = F.least(F.col("row") + 1, F.col("h") - F.col("row"), F.col("col") + 1, F.col("w") - F.col("col"))
        out = out.join(size, "map_id").withColumn("d2", F.least("d2", edge * edge)).withColumn("d2", F.when(F.col("free"), F.col("d2")).otherwise(0)).drop("h", "w")
    return out.select(*KEY, "free", "d2")


def inflate(dist: DataFrame, safety: float = 0.1, resolution: float = 0.05) -> DataFrame:
    """Adds blocked: distance below safety / resolution, compared in 32-bit floats."""
    return dist.withColumn("blocked", F.coalesce(F.sqrt("d2").cast("float") < F.lit(safety / resolution).cast("float"), F.lit(False)))


def border_band(cells: DataFrame, safety: float = 0.1, resolution: float = 0.05) -> DataFrame:
    """blocked for maps that are free everywhere: a band along the border.

    Cells that carry their map's height and width need no exchange.
    """
    m = F.ceil(F.lit(safety) / F.lit(resolution)).cast("int")
    if "height" in cells.columns and "width" in cells.columns:
        out = cells.withColumn("h", F.col("height")).withColumn("w", F.col("width"))
    else:
        out = bulky(cells).join(cells.groupBy("map_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")), "map_id")
    return out.select(*KEY, ((F.col("row") < m) | (F.col("col") < m) | (F.col("row") >= F.col("h") - m) | (F.col("col") >= F.col("w") - m)).alias("blocked"))


def local_maxima(dist: DataFrame, above: float = 2.0) -> DataFrame:
    """Cells whose distance is the greatest of their 3x3 neighbourhood and over ``above``; plateaus all count."""
    rows = Window.partitionBy("map_id", "row").orderBy("col").rowsBetween(-1, 1)
    cols = Window.partitionBy("map_id", "col").orderBy("row").rowsBetween(-1, 1)
    m = dist.withColumn("m", F.max("d2").over(rows)).withColumn("m", F.max("m").over(cols))
    return m.filter((F.col("d2") == F.col("m")) & (F.sqrt("d2").cast("float") > F.lit(above).cast("float"))).select(*KEY, "d2")


def disk(points: DataFrame, radius: int) -> DataFrame:
    """Cells within ``radius`` of points(map_id, row, col), clipped at 0 by the caller's join."""
    offsets = F.filter(F.flatten(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda a: F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda b: F.struct(a.alias("dr"), b.alias("dc"))))), lambda o: o["dr"] * o["dr"] + o["dc"] * o["dc"] <= radius * radius)
    out = points.select("map_id", F.col("row").alias("r"), F.col("col").alias("c"), F.explode(offsets).alias("o"))
    return out.select("map_id", (F.col("r") + F.col("o.dr")).alias("row"), (F.col("c") + F.col("o.dc")).alias("col")).distinct()
