"""Rasters put on another grid: every target pixel asks for the source pixels around the place it maps back to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("nearest", "bilinear")


def target_grid(spark, rows: int, cols: int, affine: tuple[float, float, float, float, float, float]) -> DataFrame:
    """row, col, x, y: the middles of a grid's pixels on its affine's plane, made in parallel."""
    a, b, c, d, e, f = map(float, affine)
    at = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    r, k = F.col("row") + 0.5, F.col("col") + 0.5
    return at.select("row", "col", (a * k + b * r + c).alias("x"), (d * k + e * r + f).alias("y"))


def to_pixels(x: Column, y: Column, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Row and column, with fractions, of a point on an affine's plane; whole numbers are the middles of pixels."""
    a, b, c, d, e, f = map(float, affine)
    det = a * e - b * d
    return (a * (y - f) - d * (x - c)) / det - 0.5, (e * (x - c) - b * (y - f)) / det - 0.5


def resampled(source: DataFrame, targets: DataFrame, bands: list[str], method: str = "bilinear", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, bands of targets (keys, row, col, at_row, at_col: places in the source) from source (keys, row, col, bands); keys tell
    rasters apart. nearest: the pixel that holds the place, the one after it halfway between two. bilinear: of the four around it,
    those that have a value, by their weights. Without any, NULL. A source may be any size: each target sends one or four rows to it."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method!r}")
    c, at, place = F.col, [*keys, "row", "col"], [*keys, "_row", "_col"]
    back = [*keys, c("_row").alias("row"), c("_col").alias("col")]
    if method == "nearest":
        asked = targets.select(*keys, c("row").alias("_row"), c("col").alias("_col"), F.floor(c("at_row") + 0.5).alias("row"), F.floor(c("at_col") + 0.5).alias("col"))
        return asked.join(source.select(*at, *bands), at, "left").select(*back, *bands)
    r0, c0 = F.floor("at_row"), F.floor("at_col")
    fr, fc = c("at_row") - r0, c("at_col") - c0
    corner = lambda dr, dc: F.struct((r0 + dr).alias("row"), (c0 + dc).alias("col"), ((fr if dr else 1 - fr) * (fc if dc else 1 - fc)).alias("w"))
    asked = targets.select(*keys, c("row").alias("_row"), c("col").alias("_col"), F.explode(F.array(*[corner(dr, dc) for dr in (0, 1) for dc in (0, 1)])).alias("s")).select(*place, "s.*")
    met = asked.join(source.select(*at, *bands), at, "left")
    mean = lambda b: F.try_divide(F.sum(c("w") * c(b)), F.sum(F.when(c(b).isNotNull(), c("w")))).alias(b)
    return met.groupBy(*place).agg(*[mean(b) for b in bands]).select(*back, *bands)
