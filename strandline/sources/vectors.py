"""Polygon sources brought to one form on WGS84: KML placemarks and stored footprints.

A polygon is ring (its shell) and holes; a ring is a closed array of struct<x, y> of at least four points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.functions import text as tx

_BORDER = "struct<LinearRing:array<struct<coordinates:string>>>"
_POLYGON = f"struct<outerBoundaryIs:{_BORDER},innerBoundaryIs:array<{_BORDER}>>"
#: what is read of a placemark; MultiGeometry may hold another one
PLACEMARK = f"name string, Polygon array<{_POLYGON}>, MultiGeometry array<struct<Polygon:array<{_POLYGON}>,MultiGeometry:array<struct<Polygon:array<{_POLYGON}>>>>>"


def _points(coordinates: Column) -> Column:
    """Points of a text 'x,y[,z] x,y[,z] ...'; what isn't a finite number is NULL."""

    def number(t: Column, k: int) -> Column:
        v = F.get(F.split(t, ","), k).try_cast("double")
        return F.when(F.abs(v) < float("inf"), v)

    tokens = F.filter(F.split(coordinates, r"\s+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.struct(number(t, 0).alias("x"), number(t, 1).alias("y")))


def _ring(points: Column) -> Column:
    """The points as a closed ring; NULL if one of them is missing or there are too few."""
    whole = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    first, n = F.slice(points, 1, 1), F.size(points)
    is_closed = F.get(points, F.lit(0)) == F.get(points, n - 1)
    return F.when(whole & (n >= 3 + is_closed.cast("int")), F.when(is_closed, points).otherwise(F.concat(points, first)))


def _rings(texts: Column) -> Column:
    return F.transform(F.transform(texts, _points), _ring)


def placemark_polygons(marks: DataFrame, keep: list[str]) -> DataFrame:
    """keep, polygon (its number in the placemark), ring, holes: every polygon of placemarks with the columns of PLACEMARK.
    Points and lines go, and shells that are empty or hold anything but finite numbers; holes of that kind are left out."""
    none = F.array().cast(f"array<{_POLYGON}>")
    outer = F.flatten(F.transform("MultiGeometry", lambda m: F.coalesce(m["Polygon"], none)))
    inner = F.flatten(F.transform("MultiGeometry", lambda m: F.coalesce(F.flatten(F.transform(m["MultiGeometry"], lambda n: F.coalesce(n["Polygon"], none))), none)))
    polygons = F.concat(*[F.coalesce(p, none) for p in (F.col("Polygon"), outer, inner)])
    each = marks.select(*keep, F.posexplode(polygons).alias("polygon", "_p"))
    shell = F.array(F.get("_p.outerBoundaryIs.LinearRing.coordinates", F.lit(0)))
    borders = F.flatten(F.transform("_p.innerBoundaryIs", lambda b: F.coalesce(b["LinearRing"]["coordinates"], F.array().cast("array<string>"))))
    holes = F.filter(_rings(F.coalesce(borders, F.array().cast("array<string>"))), lambda r: r.isNotNull())
    return each.select(*keep, "polygon", F.get(_rings(shell), F.lit(0)).alias("ring"), holes.alias("holes")).where("ring is not null")


def read_kml(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """source_file, layer, name, fields, polygon, ring, holes: all polygons of the KML files below a folder. Files are split by
    placemarks, so one large file is many tasks' work. fields: names of more plain elements of a placemark; those that a file lacks are NULL there."""
    more = "".join(f", {f} string" for f in fields or [])
    marks = spark.read.format("xml").schema(PLACEMARK + more).option("rowTag", "Placemark").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[kK][mM][lL]").load(path)
    at = F.url_decode(F.col("_metadata.file_path"))
    named = marks.select("*", tx.basename(at).alias("source_file"), tx.stem(at).alias("layer"))
    return placemark_polygons(named, ["source_file", "layer", "name", *(fields or [])])


def placemarks(df: DataFrame, text: str) -> DataFrame:
    """The rows with the columns of PLACEMARK, read from a column that holds a placemark element's text; NULL if it isn't XML."""
    return df.withColumn("_m", F.from_xml(text, PLACEMARK)).select(*[c for c in df.columns if c != text], "_m.*")


def together(*layers: DataFrame) -> DataFrame:
    """All rows of layers whose columns may differ; what a layer lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def polygon_area(ring: Column, holes: Column) -> Column:
    return geo.ring_area(ring) - F.aggregate(holes, F.lit(0.0), lambda total, h: total + geo.ring_area(h))


def on_wgs84(footprints: DataFrame, epsg: int | None = None, ring: str = "ring") -> DataFrame:
    """Footprints given on the plane or datum of a code (none: WGS84) with their rings on WGS84, and the rings' boxes. Codes without
    a way to WGS84 here are an error, so that nothing is placed wrongly."""
    moved = footprints.withColumn(ring, geo.ring_on_wgs84(F.col(ring), 4326 if epsg is None else epsg))
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return moved.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})


def with_overlay_columns(footprints: DataFrame) -> DataFrame:
    """Footprints with source_file, layer and year, which overlays name their cells by: made from map_file where there is no such
    column, a fixed word where there is no map_file either; a missing year comes from the path."""
    has, at = set(footprints.columns), F.col("map_file")
    path = "map_file" in has
    more = {}
    if "source_file" not in has:
        more["source_file"] = tx.basename(at) if path else F.lit("")
    if "layer" not in has:
        more["layer"] = tx.stem(at) if path else F.lit("footprint")
    known = tx.int_year(F.col("year")) if "year" in has else F.lit(None).cast("int")
    more["year"] = F.coalesce(known, tx.path_year(at)) if path else known
    return footprints.withColumns(more)


def load_or_build(spark: SparkSession, path: str, build, epsg: int | None = None) -> DataFrame:
    """Footprints stored at path with their overlay columns, on WGS84. If nothing is stored there, or an empty table, what build() returns is
    written first. epsg: the code of what is stored, where that isn't WGS84."""
    from strandline.sources.readers import cached_table

    found = cached_table(spark, path, build)
    if found.isEmpty():
        build().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return with_overlay_columns(on_wgs84(found, epsg))
