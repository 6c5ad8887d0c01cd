"""Cloud-free median composites over scene pixels (scene, row, col, qa, bands...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import raster
from strandline.storage import stored


def clear_fractions(pixels: DataFrame, sensor: str = "landsat", keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """keys, clear_fraction, n_pixels."""
    is_clear = F.coalesce(raster.clear(F.col("qa"), sensor), F.lit(False))
    return pixels.groupBy(*keys).agg(F.avg(is_clear.cast("double")).alias("clear_fraction"), F.count(F.lit(1)).alias("n_pixels"))


def usable_pixels(pixels: DataFrame, bands: list[str], sensor: str = "landsat", scale: float | None = None, offset: float | None = None, min_clear: float = raster.MIN_CLEAR, required: bool = False) -> DataFrame:
    """Reflectances, NULL where not clear or not valid; scenes below the least clear fraction go. Without scale and offset
    the bands are digital numbers of the sensor. required: none left is an error, as `required_scenes` tells it."""
    own = raster.sensor_scale(sensor)
    scale, offset = own[0] if scale is None else scale, own[1] if offset is None else offset
    scenes = required_scenes(pixels, sensor, min_clear) if required else clear_fractions(pixels, sensor).where(F.col("clear_fraction") >= min_clear)
    scenes = scenes.select("scene")
    is_clear = F.coalesce(raster.clear(F.col("qa"), sensor), F.lit(False))
    return pixels.join(scenes, "scene", "left_semi").withColumns({b: raster.reflectance(F.col(b), is_clear, scale, offset) for b in bands})


def median_composite(pixels: DataFrame, bands: list[str], keys: tuple[str, ...] = ("row", "col"), required: bool = True, **options) -> DataFrame:
    """Median over scenes of each band for each pixel, missing values left out; n_scenes that took part there. Without a usable
    scene there is nothing to compose, which is an error unless required is false."""
    usable = usable_pixels(pixels, bands, required=required, **options)
    some = F.coalesce(*[F.col(b) for b in bands])
    return usable.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands], F.count_distinct(F.when(some.isNotNull(), F.col("scene"))).alias("n_scenes"))


def required_scenes(pixels: DataFrame, sensor: str = "landsat", min_clear: float = raster.MIN_CLEAR) -> DataFrame:
    """scene, clear_fraction of the scenes that a composite takes; without any scene, or none that is clear enough, an error."""
    found = stored(clear_fractions(pixels, sensor))  # a row for each scene, read here and by the composite
    n = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("clear_fraction") >= min_clear).alias("clear")).first()
    if not n["n"]:
        raise ValueError("no scenes in the range")
    if not n["clear"]:
        raise ValueError(f"none of {n['n']} scenes is clear in {min_clear:.0%} of its pixels")
    return found.where(F.col("clear_fraction") >= min_clear).select("scene", "clear_fraction")


def with_water(composite: DataFrame, threshold: float = 0.0, index: str = "mndwi") -> DataFrame:
    """The composite with its water index and mask; anything but 'mndwi' means ndwi."""
    value = raster.mndwi(F.col("green"), F.col("swir")) if index == "mndwi" else raster.ndwi(F.col("green"), F.col("nir"))
    return composite.withColumn("index", value).withColumn("water", raster.water_mask(F.col("index"), threshold))


def search(scenes: DataFrame, bbox: tuple[float, float, float, float], start, end, sensor: str, max_cloud: float = 20.0, limit: int | None = 25) -> DataFrame:
    """Scenes of a sensor that meet a box and a range of dates with less cloud than asked, least cloudy first, of which the
    first `limit` are taken, so that a limit keeps the clearest ones."""
    west, south, east, north = bbox
    found = scenes.where((F.col("sensor") == sensor) & F.col("dt").between(F.lit(start), F.lit(end)) & (F.col("cloud") < max_cloud) & (F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south))
    found = found.orderBy(F.coalesce("cloud", F.lit(100.0)), "scene_id")
    return found if limit is None else found.limit(limit)


def min_max(pixels: DataFrame, bands: list[str], keys: tuple[str, ...] = ("scene",), gamma: float = 1.0, stop: bool = False) -> DataFrame:
    """Bands scaled to 0..1 by their least and largest value in each group, to the power gamma; missing is 0. stop: a band whose
    mean would not be over 0, which is one of a single value, and the bands after it have none (NULL) in that group."""
    ends = pixels.groupBy(*keys).agg(*[f(b).alias(f"{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))])
    out, going = pixels.join(ends, list(keys)), F.lit(True)
    for b in bands:
        going = going & F.coalesce(F.col(f"hi_{b}") > F.col(f"lo_{b}"), F.lit(False))
        v = F.try_divide(F.col(b) - F.col(f"lo_{b}"), F.col(f"hi_{b}") - F.col(f"lo_{b}"))
        scaled = F.coalesce(F.pow(v, F.lit(gamma)), F.lit(0.0))
        out = out.withColumn(b, F.when(going, scaled) if stop else scaled)
    return out.select(*pixels.columns)


def band_statistics(pixels: DataFrame, bands: list[str], keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    return pixels.groupBy(*keys).agg(*[f(b).alias(f"{n}_{b}") for b in bands for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))])
