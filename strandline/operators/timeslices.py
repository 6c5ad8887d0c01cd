"""Calendar windows of a date range, and what falls into them."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.operators import ranks

CADENCES = ("annual", "monthly", "seasonal")
MAX_STEPS = 600
MAX_ROI_KM2 = 2500.0


def parse_range(text: str) -> tuple[str, str]:
    start, slash, end = text.partition("/")
    if not slash:
        raise ValueError(f"a range is two dates joined by '/', not {text!r}")
    return tuple(datetime.date.fromisoformat(x.strip()).isoformat() for x in (start, end))


def _date(year: Column, of: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.date_format(of, "MM-dd")), "yyyy-MM-dd")


def windows(spark: SparkSession, start: str, end: str, cadence: str) -> DataFrame:
    """label, start, end. annual: the range's days of the year in each of its years, reaching into the next year
    where the end comes first, none where a day doesn't exist; monthly and seasonal: calendar months and
    quarters cut to the range. An unknown cadence is an error; a range that ends before it starts is empty but
    for annual windows within one year's turn."""
    cadence = cadence.lower()
    if cadence not in CADENCES:
        raise ValueError(f"cadence must be one of {', '.join(CADENCES)}, not {cadence!r}")
    one = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    if cadence == "annual":
        years = one.where(F.year("a") <= F.year("b")).select("a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y"))
        s, e0 = _date(F.col("y"), F.col("a")), _date(F.col("y"), F.col("b"))
        e = F.when(F.date_format("b", "MM-dd") < F.date_format("a", "MM-dd"), _date(F.col("y") + 1, F.col("b"))).otherwise(e0)
        return years.select(F.col("y").cast("string").alias("label"), s.alias("start"), e.alias("end")).where("start is not null and end is not null")
    unit, step, months = ("MM", "1 month", 1) if cadence == "monthly" else ("quarter", "3 month", 3)
    first = F.explode(F.sequence(F.trunc("a", unit), F.col("b"), F.expr(f"interval {step}"))).alias("m")
    at = one.where("a <= b").select("a", "b", first)
    label = F.date_format("m", "yyyy-MM") if cadence == "monthly" else F.concat(F.year("m").cast("string"), F.lit("-Q"), F.quarter("m").cast("string"))
    return at.select(label.alias("label"), F.greatest("m", "a").alias("start"), F.least(F.date_add(F.add_months("m", months), -1), "b").alias("end"))


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """west, south, east, north from four numbers with commas between; anything else is an error."""
    try:
        west, south, east, north = map(float, text.split(","))
    except ValueError:
        raise ValueError(f"a box is four numbers with commas between, not {text!r}") from None
    return west, south, east, north


def bounded_area(bbox: tuple[float, float, float, float], most: float = MAX_ROI_KM2) -> float:
    """The box's area in square kilometres; more than `most` is an error."""
    west, south, east, north = bbox
    km2 = abs(east - west) * geo.KM_PER_DEGREE * math.cos(math.radians((south + north) / 2)) * abs(north - south) * geo.KM_PER_DEGREE
    if km2 > most:
        raise ValueError(f"{km2:.0f} km2; at most {most:.0f} are allowed")
    return km2


def bounded_windows(spark: SparkSession, start: str, end: str, cadence: str, most: int = MAX_STEPS) -> DataFrame:
    """The windows; more than `most` are an error."""
    found = windows(spark, start, end, cadence)
    if (n := found.count()) > most:
        raise ValueError(f"{n} steps; at most {most} are allowed")
    return found


def in_windows(rows: DataFrame, slices: DataFrame, at: str = "dt") -> DataFrame:
    """rows with the label, start and end of each window that holds their date; overlapping windows give a row each.
    Windows are dealt into the months they touch and meet the rows by month, an equality join of which Spark broadcasts
    the windows if they are few."""
    months = slices.where("start <= end").select("label", "start", "end", F.explode(F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("interval 1 month"))).alias("_month"))
    dated = rows.withColumn("_month", F.trunc(at, "MM"))
    return dated.join(months, "_month").where(F.col(at).between(F.col("start"), F.col("end"))).drop("_month")


def scenes_by_window(scenes: DataFrame, slices: DataFrame, max_cloud: float = 20.0, with_cloud: bool = True) -> DataFrame:
    """label, start, end, n_scenes, median_cloud: every window, those without scenes too. Medians are exact, whatever the number
    of scenes; without with_cloud they are left out."""
    good = in_windows(scenes.where(F.col("cloud") < max_cloud).select("dt", "cloud"), slices).select("label", "cloud")
    hit = good.groupBy("label").agg(F.count(F.lit(1)).alias("n_scenes"))
    found = slices.join(hit, "label", "left").select("label", "start", "end", F.coalesce("n_scenes", F.lit(0)).cast("long").alias("n_scenes"))
    if not with_cloud:
        return found
    return found.join(ranks.medians(good, "cloud", ["label"]).withColumnRenamed("median", "median_cloud"), "label", "left").select("label", "start", "end", "n_scenes", "median_cloud")


def step_count(start: Column, end: Column, cadence: str) -> Column:
    """How many calendar steps a range touches: years, quarters or months from its first to its last; none: one step. 0 if a date
    is missing or the range ends before it starts."""
    if cadence not in ("none", *CADENCES):
        raise ValueError(f"cadence must be none or one of {', '.join(CADENCES)}, not {cadence!r}")
    if cadence == "none":
        return F.lit(1)
    years = F.year(end) - F.year(start)
    inside = {"annual": years, "seasonal": years * 4 + F.quarter(end) - F.quarter(start), "monthly": years * 12 + F.month(end) - F.month(start)}[cadence]
    return F.when(start <= end, inside + 1).otherwise(0)


def changes(series: DataFrame, value: str, label: str = "label") -> DataFrame:
    """The series with the difference to the step before and to the first. A series has a row for each window, at most
    MAX_STEPS; more are an error, as one task holds them."""
    few = series.limit(MAX_STEPS + 1).count()
    if few > MAX_STEPS:
        raise ValueError(f"over {MAX_STEPS} steps in a series")
    w = Window.orderBy(label)
    return series.withColumns({"change": F.col(value) - F.lag(value).over(w), "since_first": F.col(value) - F.first(value).over(w)})
