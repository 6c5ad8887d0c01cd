"""Footprint catalogue: filters, datum resolution, rings, control points and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.operators import ranks

#: Datum names as catalogues write them, with the status and code each stands for.
DATUMS = (
    ("wgs84", "native_wgs84", 4326),
    ("wgs 84", "native_wgs84", 4326),
    ("wgs_84", "native_wgs84", 4326),
    ("pulkovo 1942", "shifted", 4284),
    ("pulkovo 1942 (2)", "shifted", 4284),
    ("pulkovo 1942(83)", "shifted", 4179),
)


def overlaps(west: float, south: float, east: float, north: float) -> Column:
    """Boxes xmin, ymin, xmax, ymax that meet the given one; touching counts. Plain comparisons reach the scan."""
    return (F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south)


def contains(west: float, south: float, east: float, north: float) -> Column:
    return (F.col("xmin") <= west) & (F.col("xmax") >= east) & (F.col("ymin") <= south) & (F.col("ymax") >= north)


def meets_exactly(west: float, south: float, east: float, north: float, ring: str = "ring") -> Column:
    """Footprints whose ring, not just its box, meets the given box; touching counts. The boxes are compared first, and reach the scan."""
    return overlaps(west, south, east, north) & geo.meets_box(F.col(ring), F.lit(float(west)), F.lit(float(south)), F.lit(float(east)), F.lit(float(north)))


def in_years(first: int | None = None, last: int | None = None, year: str = "year") -> Column:
    found = F.lit(True)
    if first is not None:
        found = found & (F.coalesce(year, F.lit(0)) >= first)
    if last is not None:
        found = found & (F.coalesce(year, F.lit(9999)) <= last)
    return found


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are."""
    return df.select(*[c for c in wanted if c in df.columns])


def with_listing(df: DataFrame, files: DataFrame, key: str, there: bool = True) -> DataFrame:
    """Rows whose file is (or isn't) in a listing."""
    return df.join(files.select(F.col(key)).distinct(), key, "left_semi" if there else "left_anti")


def resolve_datum(sheets: DataFrame, datum: str = "datum") -> DataFrame:
    """Adds datum_status and epsg: by name, else by a code written as EPSG:n, else WGS84 as a fallback."""
    names = sheets.sparkSession.createDataFrame(DATUMS, "_name string, _status string, _code int")
    code = F.nullif(F.regexp_extract(F.coalesce(datum, F.lit("")), r"(?i)^\s*EPSG:\s*(\d+)\s*$", 1), F.lit("")).try_cast("int")
    status = F.coalesce("_status", F.when(code == 4326, "native_wgs84").when(code.isNotNull(), "shifted"), F.lit("unknown_fallback"))
    joined = sheets.join(F.broadcast(names), F.lower(F.trim(datum)) == F.col("_name"), "left")
    return joined.withColumns({"datum_status": status, "epsg": F.coalesce("_code", code, F.lit(4326))}).drop("_name", "_status", "_code")


def corner_ring(corners: Column) -> Column:
    """map<int, struct<x, y, lat, lon>> to a closed ring in key order; NULL below three usable corners."""
    keys = F.array_sort(F.map_keys(corners))
    points = F.filter(F.transform(keys, lambda k: F.struct(corners[k]["lon"].alias("x"), corners[k]["lat"].alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(F.size(points) >= 3, F.concat(points, F.slice(points, 1, 1)))


def points_to_wgs84(points: Column, code: int = 4284) -> Column:
    """map<key, struct<x, y, lat, lon>> with lat and lon moved to WGS84; points without them keep none."""

    def moved(_key: Column, p: Column) -> Column:
        lon, lat = geo.to_wgs84(p["lon"], p["lat"], code)
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), lat.alias("lat"), lon.alias("lon"))

    return F.transform_values(points, moved)


def four_corners(corners: str = "corners") -> Column:
    """Sheets whose record names all four corners."""
    return F.size(F.col(corners)) >= 4


def sheets_in_box(sheets: DataFrame, west: float, south: float, east: float, north: float, partial: bool = False, corners: str = "corners") -> DataFrame:
    """Sheets whose corners' box holds the given one, or with `partial` only meets it; touching counts. Sheets that don't name four
    corners go, and those without a place. Adds xmin, ymin, xmax, ymax."""
    at = F.map_values(F.col(corners))
    lons, lats = F.transform(at, lambda p: p["lon"]), F.transform(at, lambda p: p["lat"])
    boxed = sheets.where(four_corners(corners)).withColumns({"xmin": F.array_min(lons), "ymin": F.array_min(lats), "xmax": F.array_max(lons), "ymax": F.array_max(lats)})
    return boxed.where(overlaps(west, south, east, north) if partial else contains(west, south, east, north))


def neatlines(sheets: DataFrame, datum: str = "datum", corners: str = "corners", shifts=geo.SHIFTS) -> DataFrame:
    """map_file, cutline: each sheet's border on WGS84 as GeoJSON text, to cut its image with. Sheets whose corners make no ring go."""
    placed = normalised_footprints(sheets, datum, corners, shifts)
    points = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    return placed.select("map_file", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))).alias("cutline"))


def normalised_footprints(sheets: DataFrame, datum: str = "datum", corners: str = "corners", shifts=geo.SHIFTS) -> DataFrame:
    """Sheets on WGS84: datum_status, epsg, ring, xmin, ymin, xmax, ymax and shift_m, how far the first corner moved. Corners
    on a known other datum are shifted one by one, with the set of `shifts` that is best there. Those on a datum without parameters stay where they are and are marked
    as not known. Sheets of fewer than three usable corners go."""
    known = resolve_datum(sheets, datum)
    status, moved = F.col("datum_status"), (F.col("datum_status") == "shifted") & F.col("epsg").isin(*{s[0] for s in shifts})
    known = known.withColumn("datum_status", F.when((status == "shifted") & ~moved, "unknown_fallback").otherwise(status))
    # explode as a fence: each ring is made once, not once for every column that comes from it
    known = known.select("*", F.explode(F.array_compact(F.array(corner_ring(F.col(corners))))).alias("_raw"))
    placed = known.select("*", F.explode(F.array(F.when(moved, geo.ring_to_wgs84(F.col("_raw"), F.col("epsg"), shifts)).otherwise(F.col("_raw")))).alias("ring"))
    x0, y0, x1, y1 = ring_bounds(F.col("ring"))
    a, b = F.get("_raw", F.lit(0)), F.get("ring", F.lit(0))
    return placed.withColumns({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1, "shift_m": geo.shift_metres(a["x"], a["y"], b["x"], b["y"])}).drop("_raw")


def ring_bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def control_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, source_rank, seq, x, y, lat, lon) without missing values, one for each pixel at a tenth, the
    first in source and sequence; groups of fewer than three points are no use for a fit and go."""
    whole = points.where(" and ".join(f"{c} is not null" for c in ("x", "y", "lat", "lon")))
    first = Window.partitionBy(*keys, F.bround("x", 1), F.bround("y", 1)).orderBy("source_rank", "seq")
    once = whole.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    enough = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").select(*keys)
    return once.join(enough, keys, "left_semi")


def status_counts(sheets: DataFrame) -> DataFrame:
    return sheets.groupBy("datum_status").agg(F.count(F.lit(1)).alias("n"))


def shift_statistics(sheets: DataFrame) -> DataFrame:
    """datum_status, n, min_shift, median_shift, max_shift; medians are exact, whatever the number of sheets."""
    spread = sheets.groupBy("datum_status").agg(F.count("shift_m").alias("n"), F.min("shift_m").alias("min_shift"), F.max("shift_m").alias("max_shift"))
    middle = ranks.medians(sheets, "shift_m", ["datum_status"]).select(F.col("datum_status").alias("_status"), F.col("median").alias("median_shift"))
    return spread.join(middle, spread["datum_status"].eqNullSafe(F.col("_status")), "left").select("datum_status", "n", "min_shift", "median_shift", "max_shift")


def acceptance(sheets: DataFrame, least_shift: float = 1.0) -> DataFrame:
    """One row: are all sheets placed, is every datum known, did all shifted sheets move (NULL if none are shifted)."""
    shifted = F.when(F.col("datum_status") == "shifted", F.col("shift_m"))
    return sheets.agg(
        F.coalesce(F.bool_and(F.col("xmin").isNotNull()), F.lit(True)).alias("all_placed"),
        (F.count(F.when(F.col("datum_status") == "unknown_fallback", 1)) == 0).alias("all_known"),
        (F.min(shifted) > least_shift).alias("all_shifted"),
    )


def year_histogram(sheets: DataFrame, n_bins: int = 30, year: str = "year") -> DataFrame:
    """bin (1..n_bins), n: equal bins from the first year to the last, the last bin closed; missing years don't count."""
    y = F.col(year)
    ends = sheets.agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    at = F.when(y == F.col("hi"), n_bins).otherwise(F.floor((y - F.col("lo")) * n_bins / (F.col("hi") - F.col("lo"))).cast("int") + 1)
    return sheets.where(y.isNotNull()).join(F.broadcast(ends)).select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_missing, n_distinct, least, largest of each column, in one pass; values as text."""
    each = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.count_distinct(F.col(c)).alias("n_distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("largest")) for c in columns]
    return df.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def summary(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> DataFrame:
    """column, n, mean, spread (of a sample), least, q25, q50, q75, largest of numeric columns, in one pass. Quartiles have a rank
    within n / accuracy of theirs, and are values that occur; missing values don't count."""
    quartile = lambda c, p: F.percentile_approx(F.col(c).cast("double"), F.lit(p), F.lit(accuracy))
    each = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("spread"), F.min(c).cast("double").alias("least"), *[quartile(c, q / 100).alias(f"q{q}") for q in (25, 50, 75)], F.max(c).cast("double").alias("largest")) for c in columns]
    return df.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def unknown_datums(sheets: DataFrame, most: int = 20) -> DataFrame:
    """map_file, datum of the first `most` sheets by name whose datum isn't known; a report."""
    return sheets.where("datum_status = 'unknown_fallback'").select("map_file", "datum").orderBy("map_file", "datum").limit(most)


def by_year(sheets: DataFrame, missing_first: bool = False) -> DataFrame:
    """Sheets in the order of their years, then names; missing years last, or first as year 0."""
    return sheets.orderBy(F.coalesce("year", F.lit(0)) if missing_first else F.asc_nulls_last("year"), "map_file")


def outcome_counts(manifest: DataFrame, status: str = "status") -> DataFrame:
    """One row: n_ok, n_failed of a batch."""
    return manifest.agg(F.count_if(F.col(status) == "ok").alias("n_ok"), F.count_if(F.col(status).isNull() | (F.col(status) != "ok")).alias("n_failed"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])


def feature_collection(df: DataFrame, ring: str = "ring", properties: list[str] | None = None) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    props = F.struct(*(properties if properties is not None else [c for c in df.columns if c != ring]))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def regions_of_interest(spark: SparkSession, boxes: list[tuple]) -> DataFrame:
    return spark.createDataFrame(boxes, "roi string, west double, south double, east double, north double")
