"""Checks on proposed object masks against a water prior; masks are rows (mask_id, row, col)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seeded(masks: DataFrame, prior: DataFrame, seeds: DataFrame, chip_px: int, max_grow: float = 6.0, min_water: float = 0.35) -> DataFrame:
    """mask_id, area_px, water_share of the masks that pass: not over half of the chip, not more than max_grow times
    their seed's area, enough water. seeds: mask_id, seed_px."""
    wet = prior.select("row", "col").distinct().withColumn("wet", F.lit(1.0))
    area = masks.join(wet, ["row", "col"], "left").groupBy("mask_id").agg(F.count(F.lit(1)).alias("area_px"), F.avg(F.coalesce("wet", F.lit(0.0))).alias("water_share"))
    fine = (F.col("area_px") <= 0.5 * chip_px) & (F.col("area_px") <= max_grow * F.col("seed_px")) & (F.col("water_share") >= min_water)
    return area.join(seeds, "mask_id").where(fine).select("mask_id", "area_px", "water_share")


def unseeded(masks: DataFrame, prior: DataFrame, overlap: float = 0.5) -> DataFrame:
    """mask_id, area_px, water_share of the masks of which enough is water."""
    wet = prior.select("row", "col").distinct().withColumn("wet", F.lit(1.0))
    found = masks.join(wet, ["row", "col"], "left").groupBy("mask_id").agg(F.count(F.lit(1)).alias("area_px"), F.avg(F.coalesce("wet", F.lit(0.0))).alias("water_share"))
    return found.where(F.col("water_share") >= overlap)


def best_by_score(masks: DataFrame, score: str = "score", keys: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """keys, mask_id of the highest score; of equal ones the smallest id."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col("mask_id"))).alias("b")
    return masks.groupBy(*keys).agg(best).select(*keys, "b.mask_id")


def union(masks: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """row, col of all pixels in any of the (kept) masks."""
    some = masks if kept is None else masks.join(kept.select("mask_id"), "mask_id", "left_semi")
    return some.select("row", "col").distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row", "col").distinct().join(b.select("row", "col"), ["row", "col"], "left_anti")


def segment(pixels: DataFrame, segmenter=None, schema: str = "mask_id long, row long, col long", keys: tuple[str, ...] = ("chip",)) -> DataFrame:
    """Masks from a model given as a function of a chip's pixels (a pandas frame); without one, the chip's water is its mask."""
    if segmenter is None:
        return pixels.where("water").select(F.xxhash64(*keys).alias("mask_id"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    return pixels.groupBy(*keys).applyInPandas(segmenter, schema)
