"""Pixel arithmetic as columns. Missing is NULL throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Band scale and offset, and the valid range of reflectance.
SENSORS = {"landsat": (2.75e-5, -0.2), "sentinel2": (1e-4, 0.0)}
LANDSAT_CLOUD_BITS = 0b11110
SENTINEL_CLEAR = (4, 5, 6, 7)
VALID = (-0.1, 1.6)
MIN_CLEAR = 0.02


def landsat_clear(qa: Column) -> Column:
    return qa.cast("int").bitwiseAND(LANDSAT_CLOUD_BITS) == 0


def sentinel_clear(scl: Column) -> Column:
    return scl.isin(*SENTINEL_CLEAR)


def sensor_scale(sensor: str) -> tuple[float, float]:
    """Scale and offset of a sensor's bands; an unknown sensor is an error."""
    if sensor not in SENSORS:
        raise ValueError(f"sensor must be one of {', '.join(SENSORS)}, not {sensor!r}")
    return SENSORS[sensor]


def clear(quality: Column, sensor: str) -> Column:
    sensor_scale(sensor)
    return landsat_clear(quality) if sensor == "landsat" else sentinel_clear(quality)


def reflectance(value: Column, is_clear: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """value * scale + offset where the pixel is clear and the result is valid; NULL elsewhere."""
    v = value.cast("double") * scale + offset
    return F.when(is_clear & ~F.isnan(v) & v.between(*VALID), v)


def by_sensor(value: Column, quality: Column, sensor: Column) -> Column:
    """Reflectance of digital numbers by the sensor of each row; NULL for sensors that are not known."""
    return F.coalesce(*[F.when(sensor == name, reflectance(value, clear(quality, name), *scale)) for name, scale in SENSORS.items()])


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def mndwi(green: Column, swir: Column) -> Column:
    return normalized_difference(green, swir)


def water_mask(index: Column, threshold: float = 0.0) -> Column:
    """A missing index counts as -1, so it is never water unless the threshold is lower."""
    return F.coalesce(index, F.lit(-1.0)) > threshold


def above(probability: Column, threshold: float = 0.5) -> Column:
    """Whether a probability is over a threshold; a missing one is not."""
    return F.coalesce(probability > threshold, F.lit(False))


def display8(value: Column, stretch: float = 0.3, gamma: float = 1.0) -> Column:
    """0..255 for display: clip(v / stretch, 0, 1) ^ gamma * 255, cut to an integer; missing is 0. Rounded to six digits
    before the cut, so that a power that is off in its last digit doesn't turn 128 into 127."""
    v = F.least(F.greatest(value / stretch, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.round(F.pow(v, F.lit(gamma)) * 255, 6).cast("int"), F.lit(0))


def scaled16(value: Column) -> Column:
    """value * 10000 in 0..65535, cut to an integer; missing is 0."""
    return F.least(F.greatest(F.coalesce(value, F.lit(0.0)) * 10000, F.lit(0.0)), F.lit(65535.0)).cast("int")
