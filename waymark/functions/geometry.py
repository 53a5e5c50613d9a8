"""Scalar geometry as Column expressions: transforms, units, line walks, resampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_to_world(row: Column, col: Column, resolution, x_offset, y_offset, rotation) -> Column:
    """struct(x, y, z) in metres: scale, turn, shift; rows run down, so y is negative before the shift."""
    x, y = col * resolution, -row * resolution
    c, s = F.cos(rotation), F.sin(rotation)
    return F.struct((x * c - y * s + x_offset).alias("x"), (x * s + y * c + y_offset).alias("y"), F.lit(0.0).alias("z"))


def world_to_pixel(x: Column, y: Column, resolution, x_offset, y_offset, rotation) -> Column:
    """struct(row, col): the inverse, rounded half to even."""
    dx, dy = x - x_offset, y - y_offset
    c, s = F.cos(rotation), F.sin(rotation)
    return F.struct(F.rint(-(dy * c - dx * s) / resolution).cast("int").alias("row"), F.rint((dx * c + dy * s) / resolution).cast("int").alias("col"))


def to_pixels(metres: Column, resolution) -> Column:
    """Metres in pixels; an error where the resolution is unset or not positive."""
    r = F.lit(resolution) if not isinstance(resolution, Column) else resolution
    return F.when(r > 0, metres / r).otherwise(F.raise_error(F.lit("resolution must be set and positive")).cast("double"))


def to_pixels_int(metres: Column, resolution) -> Column:
    """Whole pixels, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(to_pixels(metres, resolution)).cast("int"))


def line_cells(r0: Column, c0: Column, r1: Column, c1: Column, drawn: bool = False) -> Column:
    """array<struct(row, col)> of the cells on the walk from (r0, c0) to (r1, c1), both included.

    Step i of n = max(|dr|, |dc|) has moved i cells on the longer axis and (2 i m + n - 1) div 2n on the other, m being
    its length. The walk isn't symmetric, so the direction matters. ``drawn`` lines round halves up: (2 i m + n) div 2n.
    """
    dr, dc = F.abs(r1 - r0), F.abs(c1 - c0)
    n, m = F.greatest(dr, dc), F.least(dr, dc)

    def cell(i: Column) -> Column:
        minor = F.when(n == 0, F.lit(0)).otherwise(F.floor((2 * i * m + n - (0 if drawn else 1)) / (2 * n)).cast("int"))
        wide = dc >= dr
        return F.struct((r0 + F.signum(r1 - r0).cast("int") * F.when(wide, minor).otherwise(i)).cast("int").alias("row"), (c0 + F.signum(c1 - c0).cast("int") * F.when(wide, i).otherwise(minor)).cast("int").alias("col"))

    return F.transform(F.sequence(F.lit(0), n), cell)


def upsample(x0: Column, y0: Column, x1: Column, y1: Column, longest: Column) -> Column:
    """array<struct(x, y)>: both ends, and evenly spaced points where they lie further apart than ``longest``."""
    d = F.hypot(x1 - x0, y1 - y0)
    n = F.when(d <= longest, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(d / longest).cast("int")))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((x0 + (x1 - x0) * i / n).alias("x"), (y0 + (y1 - y0) * i / n).alias("y")))


def clip(v: Column, most) -> Column:
    """A command limited to +-most."""
    return F.greatest(F.least(v, F.lit(most)), F.lit(-most))


def route_vectors(points: Column, count: int = 11) -> Column:
    """array<array<double>>: rows (x, y, next x, next y) over the first ``count`` points, the last one repeated."""
    padded = F.slice(F.concat(points, F.array_repeat(F.element_at(points, -1), count)), 1, count)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 2)), lambda i: F.array(padded[i]["x"], padded[i]["y"], padded[i + 1]["x"], padded[i + 1]["y"]))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey value of a colour."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def point_array(p: Column) -> Column:
    return F.array(p["x"], p["y"], p["z"])


def array_point(a: Column) -> Column:
    return F.struct(a[0].alias("x"), a[1].alias("y"), a[2].alias("z"))
