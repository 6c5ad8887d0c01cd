"""All registered queries of the geospatial library and the SQL that checks them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import geo, raster
from strandline.functions import text as tx
from strandline.operators import catalogue, composite, overlap, patches, regions, segments, timeslices
from strandline.plans import views
from strandline.sources import map_files

QUERIES: dict = {}
SQL: dict[str, str] = {}
BANDS = ["green", "swir", "nir"]
RANGE = ("1996-11-15", "1999-02-20")


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def r9(name: str, value: Column | str | None = None, digits: int = 9) -> Column:
    return F.round(F.col(name) if value is None else value, digits).alias(name)


MASKED = f"""{views.SCENE_PX},
good AS (SELECT scene FROM scene_px GROUP BY scene HAVING avg(CASE WHEN qa & 30 = 0 THEN 1.0::DOUBLE ELSE 0 END) >= 0.02),
px AS (SELECT scene, row, col, CASE WHEN qa & 30 = 0 AND green BETWEEN -0.1::DOUBLE AND 1.6::DOUBLE THEN green END AS green, CASE WHEN qa & 30 = 0 AND swir BETWEEN -0.1::DOUBLE AND 1.6::DOUBLE THEN swir END AS swir, CASE WHEN qa & 30 = 0 AND nir BETWEEN -0.1::DOUBLE AND 1.6::DOUBLE THEN nir END AS nir FROM scene_px SEMI JOIN good USING (scene)),
comp AS (SELECT row, col, median(green) AS green, median(swir) AS swir, median(nir) AS nir, count(DISTINCT scene) FILTER (WHERE coalesce(green, swir, nir) IS NOT NULL) AS n_scenes FROM px GROUP BY row, col)"""


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.median_composite(views.scene_px(spark, sf_dir), BANDS, scale=1.0, offset=0.0)


@query(f"WITH {MASKED} SELECT row, col, round(green, 9) AS green, round(swir, 9) AS swir, round(nir, 9) AS nir, n_scenes FROM comp")
def composite_median(spark, sf_dir):
    return _composite(spark, sf_dir).select("row", "col", r9("green"), r9("swir"), r9("nir"), "n_scenes")


@query(f"WITH {MASKED}, w AS (SELECT *, CASE WHEN green + swir <> 0 THEN (green - swir) / (green + swir) END AS index FROM comp) SELECT row, col, round(index, 9) + 0.0::DOUBLE AS index, coalesce(index, -1) > 0 AS water FROM w")
def composite_water(spark, sf_dir):
    return composite.with_water(_composite(spark, sf_dir)).select("row", "col", (F.round("index", 9) + 0.0).alias("index"), "water")  # no negative zero


@query(f"WITH {MASKED} SELECT row, col, round(CASE WHEN green + nir <> 0 THEN (green - nir) / (green + nir) END, 9) AS ndwi FROM comp")
def ndwi(spark, sf_dir):
    return _composite(spark, sf_dir).select("row", "col", r9("ndwi", raster.ndwi(F.col("green"), F.col("nir"))))


@query(f"WITH {views.SCENE_PX} SELECT scene, count(*) AS n, round(avg(CASE WHEN green + swir <> 0 THEN (green - swir) / (green + swir) END), 9) AS mean_mndwi FROM scene_px GROUP BY scene")
def mndwi(spark, sf_dir):
    return views.scene_px(spark, sf_dir).groupBy("scene").agg(F.count(F.lit(1)).alias("n"), r9("mean_mndwi", F.avg(raster.mndwi(F.col("green"), F.col("swir")))))


@query(f"WITH {MASKED} SELECT row, col, {', '.join(f'coalesce(trunc(round(least(greatest({b} / 0.3::DOUBLE, 0), 1) ** 0.8::DOUBLE * 255, 6))::INT, 0) AS {b}' for b in BANDS)} FROM comp")
def rgb_display(spark, sf_dir):
    return _composite(spark, sf_dir).select("row", "col", *[raster.display8(F.col(b), 0.3, 0.8).alias(b) for b in BANDS])


@query(f"WITH {MASKED} SELECT row, col, {', '.join(f'trunc(least(greatest(coalesce({b}, 0) * 10000, 0), 65535))::INT AS {b}' for b in BANDS)} FROM comp")
def uint16_scale(spark, sf_dir):
    return _composite(spark, sf_dir).select("row", "col", *[raster.scaled16(F.col(b)).alias(b) for b in BANDS])


@query(f"WITH {views.SCENE_PX} SELECT scene, round(avg(CASE WHEN qa & 30 = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS clear_fraction, count(*) AS n_pixels FROM scene_px GROUP BY scene")
def scene_clear_fraction(spark, sf_dir):
    return composite.clear_fractions(views.scene_px(spark, sf_dir)).select("scene", r9("clear_fraction"), "n_pixels")


@query(f"WITH {MASKED} SELECT count(DISTINCT scene) AS n_scenes, count(green) AS n_green FROM px")
def scenes_used(spark, sf_dir):
    return composite.usable_pixels(views.scene_px(spark, sf_dir), BANDS, scale=1.0, offset=0.0).agg(F.count_distinct("scene").alias("n_scenes"), F.count("green").alias("n_green"))


@query(f"WITH {views.SCENE_PX}, e AS (SELECT scene, min(green) AS lo, max(green) AS hi FROM scene_px GROUP BY scene) SELECT scene, row, col, count(*) AS n, round(sum(coalesce(((green - lo) / nullif(hi - lo, 0)) ** 2, 0)), 6) AS green FROM scene_px JOIN e USING (scene) GROUP BY scene, row, col")
def minmax_norm(spark, sf_dir):
    return composite.min_max(views.scene_px(spark, sf_dir), ["green"], gamma=2.0).groupBy("scene", "row", "col").agg(F.count(F.lit(1)).alias("n"), r9("green", F.sum("green"), 6))


@query(f"WITH {views.SCENE_PX} SELECT scene, min(swir) AS min_swir, max(swir) AS max_swir, round(avg(swir), 9) AS mean_swir, round(stddev_pop(swir), 9) AS std_swir FROM scene_px GROUP BY scene")
def band_statistics(spark, sf_dir):
    return composite.band_statistics(views.scene_px(spark, sf_dir), ["swir"]).select("scene", "min_swir", "max_swir", r9("mean_swir"), r9("std_swir"))


BOX = (70.5, 65.5, 74.2, 68.1)
MEETS = "xmin <= 74.2 AND xmax >= 70.5 AND ymin <= 68.1 AND ymax >= 65.5"


@query(f"WITH {views.FOOTPRINT} SELECT id, year FROM footprint WHERE {MEETS} AND coalesce(year, 0) >= 1960 AND coalesce(year, 9999) <= 1985")
def footprints_bbox(spark, sf_dir):
    return views.footprints(spark, sf_dir).where(catalogue.overlaps(*BOX) & catalogue.in_years(1960, 1985)).select("id", "year")


@query(f"WITH {views.FOOTPRINT} SELECT id FROM footprint WHERE xmin <= 70.2 AND xmax >= 71.1 AND ymin <= 66.3 AND ymax >= 66.9")
def footprints_contains(spark, sf_dir):
    return views.footprints(spark, sf_dir).where(catalogue.contains(70.2, 66.3, 71.1, 66.9)).select("id")


@query(f"WITH {views.FOOTPRINT} SELECT layer, count(*) AS n FROM footprint WHERE {MEETS} GROUP BY layer")
def footprints_overlap(spark, sf_dir):
    return views.footprints(spark, sf_dir).where(catalogue.overlaps(*BOX)).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {views.FOOTPRINT} SELECT coalesce(year, 0) AS year, count(*) AS n FROM footprint WHERE coalesce(year, 0) >= 0 AND coalesce(year, 9999) <= 1975 GROUP BY 1")
def footprints_year(spark, sf_dir):
    return views.footprints(spark, sf_dir).where(catalogue.in_years(0, 1975)).groupBy(F.coalesce("year", F.lit(0)).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {views.FOOTPRINT} SELECT id, round(abs(xmax - xmin) * 111.32::DOUBLE * cos(radians((ymin + ymax) / 2)) * abs(ymax - ymin) * 111.32::DOUBLE, 6) AS km2 FROM footprint")
def roi_area(spark, sf_dir):
    return views.footprints(spark, sf_dir).select("id", r9("km2", geo.bbox_km2(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")), 6))


@query(f"WITH {views.FOOTPRINT} SELECT id, round(xmin - 10 / (2 * 111.32::DOUBLE * greatest(cos(radians(ymin)), 1e-6)), 9) AS west, round(ymin - 6 / (2 * 111.32::DOUBLE), 9) AS south, round(xmin + 10 / (2 * 111.32::DOUBLE * greatest(cos(radians(ymin)), 1e-6)), 9) AS east, round(ymin + 6 / (2 * 111.32::DOUBLE), 9) AS north FROM footprint")
def center_span_bbox(spark, sf_dir):
    w, s, e, n = geo.centre_span_bbox(F.col("xmin"), F.col("ymin"), F.lit(10.0), F.lit(6.0))
    return views.footprints(spark, sf_dir).select("id", r9("west", w), r9("south", s), r9("east", e), r9("north", n))


def _shifted(spark, sf_dir):
    f = catalogue.resolve_datum(views.footprints(spark, sf_dir))
    x, y = geo.to_wgs84(F.col("xmin"), F.col("ymin"))
    moved = F.col("datum_status") == "shifted"
    return f.withColumn("shift_m", F.when(moved, geo.shift_metres(F.col("xmin"), F.col("ymin"), x, y)).otherwise(0.0))


def _helmert(lon: str, lat: str, source: str) -> str:
    a, f = geo.KRASSOVSKY
    e2, (dx, dy, dz, rx, ry, rz, ppm) = f * (2 - f), geo.PULKOVO_TO_WGS84
    rx, ry, rz, s = *(math.radians(r / 3600) for r in (rx, ry, rz)), 1 + ppm * 1e-6
    A, g = geo.WGS84
    E2, b = g * (2 - g), A * (1 - g)
    d = lambda v: f"({v!r}::DOUBLE)"
    return f"""h0 AS (SELECT *, radians({lat}) AS phi, radians({lon}) AS lam, {d(a)} / sqrt(1 - {d(e2)} * sin(radians({lat})) ** 2) AS n FROM {source}),
h1 AS (SELECT *, n * cos(phi) * cos(lam) AS x, n * cos(phi) * sin(lam) AS y, n * {d(1 - e2)} * sin(phi) AS z FROM h0),
h2 AS (SELECT *, {d(dx)} + {d(s)} * (x + {d(rz)} * y - {d(ry)} * z) AS u, {d(dy)} + {d(s)} * (-{d(rz)} * x + y + {d(rx)} * z) AS v, {d(dz)} + {d(s)} * ({d(ry)} * x - {d(rx)} * y + z) AS w FROM h1),
h3 AS (SELECT *, sqrt(u * u + v * v) AS p, atan2(w * {d(A)}, sqrt(u * u + v * v) * {d(b)}) AS th FROM h2),
moved AS (SELECT *, degrees(atan2(v, u)) AS lon2, degrees(atan2(w + {d((A * A - b * b) / b)} * sin(th) ** 3, p - {d(E2 * A)} * cos(th) ** 3)) AS lat2 FROM h3)"""


STATUS = "CASE WHEN lower(trim(datum)) = 'wgs 84' THEN 'native_wgs84' WHEN lower(trim(datum)) = 'pulkovo 1942' THEN 'shifted' WHEN datum = 'EPSG:4326' THEN 'native_wgs84' ELSE 'unknown_fallback' END"
SHIFTED = f"""{views.FOOTPRINT}, {_helmert('xmin', 'ymin', 'footprint')},
sh AS (SELECT *, {STATUS} AS datum_status, CASE WHEN {STATUS} = 'shifted' THEN sqrt(((lon2 - xmin) * 111320 * cos(radians(ymin))) ** 2 + ((lat2 - ymin) * 111320) ** 2) ELSE 0 END AS shift_m FROM moved)"""


@query(f"WITH {SHIFTED} SELECT datum_status, count(*) AS n FROM sh GROUP BY 1")
def datum_status_counts(spark, sf_dir):
    return catalogue.status_counts(catalogue.resolve_datum(views.footprints(spark, sf_dir)))


@query(f"WITH {SHIFTED} SELECT datum_status, count(shift_m) AS n, round(min(shift_m), 5) AS min_shift, round(median(shift_m), 5) AS median_shift, round(max(shift_m), 5) AS max_shift FROM sh GROUP BY 1")
def shift_stats(spark, sf_dir):
    return catalogue.shift_statistics(_shifted(spark, sf_dir)).select("datum_status", "n", r9("min_shift", digits=5), r9("median_shift", digits=5), r9("max_shift", digits=5))


@query(f"WITH {SHIFTED} SELECT bool_and(xmin IS NOT NULL) AS all_placed, count(*) FILTER (WHERE datum_status = 'unknown_fallback') = 0 AS all_known, min(CASE WHEN datum_status = 'shifted' THEN shift_m END) > 1 AS all_shifted FROM sh")
def qa_acceptance(spark, sf_dir):
    return catalogue.acceptance(_shifted(spark, sf_dir))


@query(f"WITH {views.FOOTPRINT}, {_helmert('xmin', 'ymin', 'footprint')} SELECT id, round(lon2, 9) AS lon, round(lat2, 9) AS lat FROM moved")
def helmert_shift(spark, sf_dir):
    x, y = geo.to_wgs84(F.col("xmin"), F.col("ymin"))
    return views.footprints(spark, sf_dir).select("id", r9("lon", x), r9("lat", y))


@query(f"WITH {views.FOOTPRINT}, {_helmert('xmin', 'ymin', 'footprint')} SELECT id, round(sqrt(((lon2 - xmin) * 111320 * cos(radians(ymin))) ** 2 + ((lat2 - ymin) * 111320) ** 2), 5) AS shift_m FROM moved")
def shift_meters(spark, sf_dir):
    x, y = geo.to_wgs84(F.col("xmin"), F.col("ymin"))
    return views.footprints(spark, sf_dir).select("id", r9("shift_m", geo.shift_metres(F.col("xmin"), F.col("ymin"), x, y), 5))


@query(f"WITH {views.FOOTPRINT} SELECT id, round(6378137 * radians(xmin), 5) AS x, round(6378137 * ln(tan(pi() / 4 + radians(ymin) / 2)), 5) AS y FROM footprint")
def mercator_bounds(spark, sf_dir):
    x, y = geo.mercator(F.col("xmin"), F.col("ymin"))
    return views.footprints(spark, sf_dir).select("id", r9("x", x, 5), r9("y", y, 5))


def _sheets(spark, sf_dir):
    return map_files.parse(views.map_text(spark, sf_dir))


@query(f"WITH {views.SHEETS} SELECT map_file, datum FROM sheets")
def map_parse_datum(spark, sf_dir):
    return _sheets(spark, sf_dir).select("map_file", "datum")


@query(f"""WITH {views.SHEETS} SELECT map_file, 'sheet' || k || '.gif' AS gif_file, year, scale, idx AS "index", 'Transverse Mercator' AS projection, CASE WHEN k % 4 <> 0 THEN (3 * (k % 60))::DOUBLE END AS central_meridian, (1000 + k % 100)::INT AS image_width, (2000 + k % 100)::INT AS image_height FROM sheets""")
def map_parse_header(spark, sf_dir):
    return _sheets(spark, sf_dir).select("map_file", "gif_file", "year", "scale", "index", "projection", F.col("projection_params.central_meridian").alias("central_meridian"), "image_width", "image_height")


@query(f"WITH {views.SHEETS} SELECT map_file, (k % 500)::INT AS x, (k % 400)::INT AS y, round(60 + k % 10 + (k % 60)::DOUBLE / 60, 9) AS lat, round(64 + k % 26 + (k % 50)::DOUBLE / 60, 9) AS lon FROM sheets")
def map_parse_points(spark, sf_dir):
    return _sheets(spark, sf_dir).select("map_file", F.explode("control_points").alias("p")).select("map_file", "p.x", "p.y", r9("lat", F.col("p.lat")), r9("lon", F.col("p.lon")))


CORNERS = f"{views.SHEETS}, corners AS (SELECT map_file, c.i AS corner, c.x, c.y, (CASE c.i WHEN 1 THEN 64 ELSE 65 END + k % 26)::DOUBLE AS lon, (CASE c.i WHEN 3 THEN 64 ELSE 63 END + k % 11)::DOUBLE AS lat FROM sheets, (VALUES (1, 10, 20), (2, 910, 20), (3, 910, 820)) AS c(i, x, y))"


@query(f"WITH {CORNERS} SELECT map_file, corner, x, y, lat, lon FROM corners")
def map_parse_corners(spark, sf_dir):
    # a plain explode would have Spark ask for corners first, by reading every text once more before it is dealt out
    return _sheets(spark, sf_dir).select("map_file", F.explode_outer("corners").alias("corner", "c")).where("corner is not null").select("map_file", "corner", "c.x", "c.y", "c.lat", "c.lon")


@query(f"""WITH {views.SHEETS} SELECT map_file, coalesce(year, path_year) AS year, coalesce(scale, p_size::VARCHAR) AS scale, coalesce(idx, 'Q-' || (k % 7)) AS "index", CASE k % 3 WHEN 0 THEN 'Pulkovo 1942' WHEN 1 THEN 'WGS 84' ELSE 'Pulkovo text' END AS datum FROM sheets""")
def fill_missing(spark, sf_dir):
    return map_files.fill_missing(_sheets(spark, sf_dir)).select("map_file", "year", "scale", "index", "datum")


@query(f"WITH {CORNERS} SELECT map_file, count(*) + 1 AS n_points, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax, 0.5::DOUBLE AS area FROM corners GROUP BY map_file")
def corners_to_ring(spark, sf_dir):
    ring = F.col("ring")
    x0, y0, x1, y1 = catalogue.ring_bounds(ring)
    return _sheets(spark, sf_dir).select("map_file", catalogue.corner_ring(F.col("corners")).alias("ring")).select("map_file", F.size(ring).cast("long").alias("n_points"), x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"), geo.ring_area(ring).alias("area"))


@query(f"WITH {views.SHEETS} SELECT map_file, CASE WHEN k % 500 = 10 AND k % 400 = 20 THEN 3 ELSE 4 END::BIGINT AS n FROM sheets")
def gcp_dedupe(spark, sf_dir):
    sheets = _sheets(spark, sf_dir)
    point = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["lat"].alias("lat"), p["lon"].alias("lon"))
    own = sheets.select("map_file", F.lit(0).alias("source_rank"), F.posexplode(F.transform("control_points", point)).alias("seq", "p"))
    corner = sheets.select("map_file", F.lit(1).alias("source_rank"), F.posexplode(F.transform(F.map_values("corners"), point)).alias("seq", "p"))
    points = own.unionByName(corner).select("map_file", "source_rank", "seq", "p.*")
    return catalogue.control_points(points, ["map_file"]).groupBy("map_file").agg(F.count(F.lit(1)).alias("n"))


NORMAL = f"""{CORNERS}, cn AS (SELECT map_file, corner, lon, lat FROM corners), {_helmert('lon', 'lat', 'cn')}, d AS (SELECT map_file, k % 3 AS kind FROM sheets), pt AS (SELECT moved.*, kind, CASE kind WHEN 0 THEN lon2 ELSE lon END AS px, CASE kind WHEN 0 THEN lat2 ELSE lat END AS py FROM moved JOIN d USING (map_file))"""


@query(f"""WITH {NORMAL} SELECT map_file, CASE any_value(kind) WHEN 0 THEN 'shifted' WHEN 1 THEN 'native_wgs84' ELSE 'unknown_fallback' END AS datum_status, CASE any_value(kind) WHEN 0 THEN 4284 ELSE 4326 END AS epsg, round(min(px), 9) AS xmin, round(min(py), 9) AS ymin, round(max(px), 9) AS xmax, round(max(py), 9) AS ymax,
round(max(CASE WHEN corner = 1 THEN sqrt(((px - lon) * 111320 * cos(radians(lat))) ** 2 + ((py - lat) * 111320) ** 2) END), 5) AS shift_m FROM pt GROUP BY map_file""")
def footprints_normalised(spark, sf_dir):
    found = catalogue.normalised_footprints(_sheets(spark, sf_dir))
    return found.select("map_file", "datum_status", "epsg", r9("xmin"), r9("ymin"), r9("xmax"), r9("ymax"), r9("shift_m", digits=5))


@query(f"WITH {views.SHEETS}, y AS (SELECT coalesce(year, path_year) AS y FROM sheets), e AS (SELECT min(y) AS lo, max(y) AS hi FROM y) SELECT CASE WHEN y = hi THEN 30 ELSE floor((y - lo) * 30 / (hi - lo))::INT + 1 END AS bin, count(*) AS n FROM y, e GROUP BY 1")
def year_histogram(spark, sf_dir):
    return catalogue.year_histogram(map_files.fill_missing(_sheets(spark, sf_dir)))


@query(f"""WITH {views.SHEETS}, l AS (SELECT 'year' AS "column", year::VARCHAR AS v FROM sheets UNION ALL SELECT 'scale', scale FROM sheets) SELECT "column", count(v) AS n, count(*) - count(v) AS n_missing, count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS largest FROM l GROUP BY 1""")
def column_report(spark, sf_dir):
    return catalogue.column_report(_sheets(spark, sf_dir), ["year", "scale"])


@query("""WITH s AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'landsat' ELSE 'sentinel2' END AS sensor, l_partkey * 5 + 7000 AS dn, CASE WHEN l_linenumber % 2 = 1 THEN round(l_discount * 100)::INT ELSE (l_quantity % 11)::INT END AS qa FROM lineitem),
r AS (SELECT sensor, CASE sensor WHEN 'landsat' THEN dn * 2.75e-5::DOUBLE - 0.2::DOUBLE ELSE dn * 1e-4::DOUBLE END AS v, CASE sensor WHEN 'landsat' THEN qa & 30 = 0 ELSE qa IN (4, 5, 6, 7) END AS clear FROM s)
SELECT sensor, count(*) AS n, count(*) FILTER (WHERE clear AND v BETWEEN -0.1::DOUBLE AND 1.6::DOUBLE) AS n_valid, round(avg(v) FILTER (WHERE clear AND v BETWEEN -0.1::DOUBLE AND 1.6::DOUBLE), 6) AS mean FROM r GROUP BY sensor""")
def reflectance_by_sensor(spark, sf_dir):
    c, odd = F.col, F.col("l_linenumber") % 2 == 1
    px = views.table(spark, sf_dir, "lineitem").select(F.when(odd, "landsat").otherwise("sentinel2").alias("sensor"), (c("l_partkey") * 5 + 7000).alias("dn"), F.when(odd, F.round(c("l_discount") * 100)).otherwise(c("l_quantity") % 11).cast("int").alias("qa"))
    value = raster.by_sensor(c("dn"), c("qa"), c("sensor"))
    return px.withColumn("v", value).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), r9("mean", F.avg("v"), 6))


A, B = RANGE
WINDOWS = {
    "annual": f"w AS (SELECT y::VARCHAR AS label, try_cast(y || '-11-15' AS DATE) AS start, try_cast((y + 1) || '-02-20' AS DATE) AS \"end\" FROM range({A[:4]}, {int(B[:4]) + 1}) AS t(y))",
    "monthly": f"w AS (SELECT strftime(m, '%Y-%m') AS label, greatest(m::DATE, DATE '{A}') AS start, least(last_day(m::DATE), DATE '{B}') AS \"end\" FROM generate_series(TIMESTAMP '1996-11-01', TIMESTAMP '{B}', INTERVAL 1 MONTH) AS t(m))",
    "seasonal": f"w AS (SELECT year(m) || '-Q' || quarter(m) AS label, greatest(m::DATE, DATE '{A}') AS start, least((m + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE, DATE '{B}') AS \"end\" FROM generate_series(TIMESTAMP '1996-10-01', TIMESTAMP '{B}', INTERVAL 3 MONTH) AS t(m))",
}


def _cadence(kind: str):
    sql = f"WITH {views.ACQUISITIONS}, {WINDOWS[kind]} SELECT label, start, \"end\", count(dt) AS n_scenes, round(median(cloud), 6) AS median_cloud FROM w LEFT JOIN acquisitions ON dt BETWEEN start AND \"end\" AND cloud < 20 GROUP BY ALL"

    def run(spark, sf_dir):
        found = timeslices.scenes_by_window(views.acquisitions(spark, sf_dir), timeslices.windows(spark, A, B, kind))
        return found.withColumn("median_cloud", F.round("median_cloud", 6))

    run.__name__ = f"cadence_{kind}"
    query(sql)(run)


for _kind in WINDOWS:
    _cadence(_kind)


@query(f"""WITH {WINDOWS['seasonal']}, s AS (SELECT l_shipdate::DATE AS dt, l_orderkey // 48 AS row, l_partkey % 8 AS col, round(l_discount * 100)::INT AS qa, l_tax AS green FROM lineitem)
SELECT label, row, col, median(CASE WHEN qa & 30 = 0 THEN green END) AS green FROM s JOIN w ON dt BETWEEN start AND "end" GROUP BY label, row, col""")
def cadence_composite(spark, sf_dir):
    px = views.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("dt"), F.floor(F.col("l_orderkey") / 48).alias("row"), (F.col("l_partkey") % 8).alias("col"), F.round(F.col("l_discount") * 100).cast("int").alias("qa"), F.col("l_tax").alias("green"))
    sliced = timeslices.in_windows(px, timeslices.windows(spark, A, B, "seasonal"))
    return sliced.groupBy("label", "row", "col").agg(F.median(raster.reflectance(F.col("green"), raster.landsat_clear(F.col("qa")))).alias("green"))


@query(f"""WITH {views.ACQUISITIONS}, {WINDOWS['monthly']}, s AS (SELECT label, count(dt) AS n FROM w LEFT JOIN acquisitions ON dt BETWEEN start AND "end" AND cloud < 20 GROUP BY label)
SELECT label, n, n - lag(n) OVER (ORDER BY label) AS change, n - first(n) OVER (ORDER BY label) AS since_first FROM s""")
def series_change(spark, sf_dir):
    found = timeslices.scenes_by_window(views.acquisitions(spark, sf_dir), timeslices.windows(spark, A, B, "monthly"), with_cloud=False)
    return timeslices.changes(found.select("label", F.col("n_scenes").alias("n")), "n")


W = regions.WIDTH
def _with_labels(more: str, body: str) -> str:
    return f"""WITH RECURSIVE {views.WIDE_MASK}, p AS (SELECT row, col, row * {W} + col AS id FROM wide_mask),
o AS (SELECT id, row + d.r AS row, col + d.c AS col FROM p, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) AS d(r, c)),
e AS (SELECT o.id AS a, p.id AS b FROM o JOIN p ON o.row = p.row AND o.col = p.col),
reach(id, r) AS (SELECT id, id FROM p UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id WHERE reach.r < e.b),
lab AS (SELECT p.row, p.col, m.label FROM p JOIN (SELECT id, min(r) AS label FROM reach GROUP BY id) m USING (id)){"," * bool(more)} {more}
{body}"""


def _labels(spark, sf_dir):
    return regions.label_regions(views.wide_mask(spark, sf_dir), tile=64)


@query(_with_labels("", "SELECT row, col, label FROM lab"))
def label_components(spark, sf_dir):
    return _labels(spark, sf_dir)


@query(_with_labels("", "SELECT label, min(row) AS row0, min(col) AS col0, max(row) + 1 AS row1, max(col) + 1 AS col1, count(*) AS area_px FROM lab GROUP BY label HAVING count(*) >= 6"))
def blob_stats(spark, sf_dir):
    return regions.blobs(_labels(spark, sf_dir), min_area=6).drop("centre_row", "centre_col")


@query(_with_labels("", "SELECT label, round(avg(row), 6) AS centre_row, round(avg(col), 6) AS centre_col FROM lab GROUP BY label"))
def blob_centroids(spark, sf_dir):
    return regions.blobs(_labels(spark, sf_dir)).select("label", r9("centre_row", digits=6), r9("centre_col", digits=6))


SHAPES = """n4 AS (SELECT label, count(*) AS inner_sides FROM (SELECT a.label FROM lab a JOIN lab b ON a.row = b.row AND a.col + 1 = b.col AND a.label = b.label UNION ALL SELECT a.label FROM lab a JOIN lab b ON a.col = b.col AND a.row + 1 = b.row AND a.label = b.label) GROUP BY label),
shp AS (SELECT label, count(*) * 900.0::DOUBLE AS area, (4 * count(*) - 2 * coalesce(any_value(inner_sides), 0)) * 30.0::DOUBLE AS perimeter FROM lab LEFT JOIN n4 USING (label) GROUP BY label)"""
AFFINE = (30.0, 0.0, 500000.0, 0.0, -30.0, 7400000.0)


@query(_with_labels(SHAPES, "SELECT label, area, perimeter FROM shp"))
def lake_area_perimeter(spark, sf_dir):
    return regions.area_perimeter(_labels(spark, sf_dir), affine=AFFINE).select("label", r9("area", digits=3), r9("perimeter", digits=3))


FRACTALS = """edge AS (SELECT * FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) >= 40) AND (SELECT count(*) FROM lab b WHERE b.label = lab.label AND abs(b.row - lab.row) + abs(b.col - lab.col) = 1) < 4),
bx AS (SELECT label, min(row) AS r0, min(col) AS c0, least(max(row) - min(row), max(col) - min(col)) + 1 AS side, count(*) AS n FROM edge GROUP BY label),
sz AS (SELECT label, (1 << k::INT)::INT AS size, r0, c0 FROM bx, unnest(generate_series(0, least(7, floor(log2(side // 2))::BIGINT))) AS t(k) WHERE n >= 8 AND side >= 8),
bc AS (SELECT label, size, count(DISTINCT ((row - r0) // size, (col - c0) // size)) AS boxes FROM edge JOIN sz USING (label) GROUP BY label, size),
fd AS (SELECT label, -regr_slope(ln(boxes), ln(size)) AS fractal_dimension FROM bc GROUP BY label HAVING count(*) >= 3)"""


@query(_with_labels(f"{SHAPES}, {FRACTALS}", "SELECT label, area, perimeter, round(fractal_dimension, 6) AS fractal_dimension FROM shp LEFT JOIN fd USING (label) WHERE area >= 3600"))
def lake_metrics(spark, sf_dir):
    lakes = regions.lake_metrics(_labels(spark, sf_dir), AFFINE, 3600 - 1e-6, fractal_min_pixels=40)
    return lakes.select("label", r9("area", digits=3), r9("perimeter", digits=3), r9("fractal_dimension", digits=6))


@query(_with_labels(f"{SHAPES}, {FRACTALS}, kept AS (SELECT * FROM shp LEFT JOIN fd USING (label) WHERE area >= 3600), h0 AS (SELECT greatest(min(area), 1.0::DOUBLE) AS lo, max(area) AS hi FROM kept), h1 AS (SELECT lo, greatest(hi, lo * 10) AS hi FROM h0), "
    "hb AS (SELECT CASE WHEN area >= hi THEN 11 ELSE floor(round((ln(area) - ln(lo)) / ((ln(hi) - ln(lo)) / 11), 9))::INT + 1 END AS bin, count(*) AS n FROM kept, h1 GROUP BY 1)",
    "SELECT count(*) AS lake_count, sum(area) AS total_area, round(avg(fractal_dimension), 6) AS mean_fractal_dimension, (SELECT string_agg(bin || ':' || n, ',' ORDER BY bin) FROM hb) AS sizes FROM kept"))
def lake_summary(spark, sf_dir):
    lakes = regions.lake_metrics(_labels(spark, sf_dir), AFFINE, 3600 - 1e-6, fractal_min_pixels=40)
    report = regions.lake_report(lakes.withColumn("area", F.round("area", 3)))
    sizes = F.array_join(F.transform("size_distribution", lambda b: F.concat_ws(":", b["bin"], b["n"])), ",").alias("sizes")
    return report.select("lake_count", r9("total_area", digits=3), r9("mean_fractal_dimension", digits=6), sizes)


DEGREES = (0.0006, 0.0, 68.0, 0.0, -0.0003, 67.0)


def _utm(lon: str, lat: str, zone: str, to: str) -> str:
    """Easting and northing as columns x_to, y_to, without false origins."""
    radius, alpha = geo.utm_series()
    f = geo.WGS84[1]
    e = math.sqrt(f * (2 - f))
    d = lambda v: f"({v!r}::DOUBLE)"
    t = f"sinh(atanh(sin(radians({lat}))) - {d(e)} * atanh({d(e)} * sin(radians({lat}))))"
    lam = f"radians({lon} - ({zone} * 6 - 183))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    x = " + ".join([eta, *(f"{d(c)} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, c in enumerate(alpha, 1))])
    y = " + ".join([xi, *(f"{d(c)} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, c in enumerate(alpha, 1))])
    return f"{d(geo.UTM_SCALE * radius)} * ({x}) AS x_{to}, {d(geo.UTM_SCALE * radius)} * ({y}) AS y_{to}"


_a, _, _c, _, _e, _f = (f"({v!r}::DOUBLE)" for v in DEGREES)
METRIC = f"""side AS (SELECT lab.label, {_a} * (lab.col + v.c1) + {_c} AS x1, {_e} * (lab.row + v.r1) + {_f} AS y1, {_a} * (lab.col + v.c2) + {_c} AS x2, {_e} * (lab.row + v.r2) + {_f} AS y2
  FROM lab, (VALUES (0, 0, 0, 1, -1, 0), (0, 1, 1, 1, 0, 1), (1, 1, 1, 0, 1, 0), (1, 0, 0, 0, 0, -1)) AS v(r1, c1, r2, c2, dr, dc) WHERE NOT EXISTS (SELECT 1 FROM lab o WHERE o.label = lab.label AND o.row = lab.row + v.dr AND o.col = lab.col + v.dc)),
mid AS (SELECT (min(x1) + max(x1)) / 2 AS lon, (min(y1) + max(y1)) / 2 AS lat FROM side), zn AS (SELECT *, floor((lon + 180) / 6) % 60 + 1 AS zone FROM mid), z0 AS (SELECT *, {_utm('lon', 'lat', 'zone', '0')} FROM zn),
pj AS (SELECT label, {_utm('x1', 'y1', 'zone', '1')}, {_utm('x2', 'y2', 'zone', '2')}, x_0, y_0 FROM side, z0),
ms AS (SELECT label, abs(sum(((x_1 - x_0) * (y_2 - y_0) - (x_2 - x_0) * (y_1 - y_0)) / 2)) AS area, sum(sqrt((x_2 - x_1) ** 2 + (y_2 - y_1) ** 2)) AS perimeter FROM pj GROUP BY label)"""


@query(_with_labels(METRIC, "SELECT label, round(area, 2) AS area, round(perimeter, 3) AS perimeter FROM ms"))
def lake_metric_area(spark, sf_dir):
    return regions.area_perimeter(_labels(spark, sf_dir), affine=DEGREES, degrees=True).select("label", r9("area", digits=2), r9("perimeter", digits=3))


@query(_with_labels("", "SELECT label, row_number() OVER (ORDER BY label) AS number FROM (SELECT DISTINCT label FROM lab)"))
def label_numbers(spark, sf_dir):
    return regions.numbered(_labels(spark, sf_dir))


@query(_with_labels(SHAPES, "SELECT label, area FROM shp ORDER BY area DESC, label LIMIT 12"))
def lakes_topk(spark, sf_dir):
    return regions.largest(regions.area_perimeter(_labels(spark, sf_dir), affine=AFFINE).select("label", r9("area", digits=3)))


DENSE_SQL = f"""{views.MASK}, edge AS (SELECT image, row, col FROM dense d WHERE (SELECT count(*) FROM dense e WHERE e.image = d.image AND abs(e.row - d.row) + abs(e.col - d.col) = 1) < 4)"""
BOXES = f"""{DENSE_SQL}, bx AS (SELECT image, min(row) AS r0, min(col) AS c0, least(max(row) - min(row), max(col) - min(col)) + 1 AS side, count(*) AS n FROM edge GROUP BY image),
sz AS (SELECT image, (1 << k::INT)::INT AS size, r0, c0 FROM bx, unnest(generate_series(0, least(7, floor(log2(side // 2))::BIGINT))) AS t(k) WHERE n >= 8 AND side >= 8),
bc AS (SELECT image, size, count(DISTINCT ((row - r0) // size, (col - c0) // size)) AS boxes FROM edge JOIN sz USING (image) GROUP BY image, size)"""


def _edge(spark, sf_dir):
    return regions.boundary(views.mask(spark, sf_dir), ["image"])


@query(f"WITH {DENSE_SQL} SELECT image, row, col FROM edge")
def lake_boundary(spark, sf_dir):
    return _edge(spark, sf_dir)


@query(f"WITH {BOXES} SELECT * FROM bc")
def box_counts(spark, sf_dir):
    return regions.box_counts(_edge(spark, sf_dir), ["image"])


@query(f"WITH {BOXES} SELECT image, round(-regr_slope(ln(boxes), ln(size)), 6) AS fractal_dimension FROM bc WHERE boxes > 0 GROUP BY image HAVING count(*) >= 3")
def fractal_dimension(spark, sf_dir):
    return regions.fractal_dimension(regions.box_counts(_edge(spark, sf_dir), ["image"]), ["image"]).select("image", r9("fractal_dimension", digits=6))


@query(f"WITH {views.MASK} SELECT image, count(*) AS area_px, round(avg(row), 6) AS centre_row, round(avg(col), 6) AS centre_col, round(var_pop(row) + 1 / 12::DOUBLE, 6) AS spread FROM dense GROUP BY image")
def mask_moments(spark, sf_dir):
    found = regions.moments(views.mask(spark, sf_dir), ["image"])
    # spread of rows from the axes: a = (l1 + l2) / 2 + (l2 - l1) / 2 * cos(2 angle), axes being 4 sqrt(l)
    l1, l2 = F.pow(F.col("major_axis") / 4, 2), F.pow(F.col("minor_axis") / 4, 2)
    spread = (l1 + l2) / 2 - (l1 - l2) / 2 * F.cos(2 * F.radians("orientation"))
    return found.select("image", "area_px", r9("centre_row", digits=6), r9("centre_col", digits=6), r9("spread", spread, 6))


@query("""WITH a AS (SELECT l_extendedprice AS area FROM lineitem), e0 AS (SELECT greatest(min(area), 1.0::DOUBLE) AS lo, max(area) AS hi FROM a), e AS (SELECT lo, greatest(hi, lo * 10) AS hi FROM e0)
SELECT CASE WHEN area >= hi THEN 11 ELSE floor((ln(area) - ln(lo)) / ((ln(hi) - ln(lo)) / 11))::INT + 1 END AS bin, count(*) AS n FROM a, e WHERE area >= lo GROUP BY 1""")
def size_histogram(spark, sf_dir):
    return regions.size_histogram(views.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("area"))).select(F.col("bin").cast("int").alias("bin"), "n")


MASKS_SQL = "px AS (SELECT l_suppkey AS mask_id, l_orderkey // 64 AS row, (l_orderkey * 7 + l_linenumber * 3) % 96 AS col, l_discount FROM lineitem), masks AS (SELECT DISTINCT mask_id, row, col FROM px), prior AS (SELECT row, col FROM px GROUP BY row, col HAVING max(l_discount) >= 0.06), seeds AS (SELECT mask_id, count(*) AS seed_px FROM px WHERE l_discount < 0.03 GROUP BY 1), ar AS (SELECT mask_id, count(*) AS area_px, avg(CASE WHEN prior.row IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS water_share FROM masks LEFT JOIN prior USING (row, col) GROUP BY mask_id)"


def _masks(spark, sf_dir):
    c = F.col
    px = views.table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("mask_id"), F.floor(c("l_orderkey") / 64).alias("row"), ((c("l_orderkey") * 7 + c("l_linenumber") * 3) % 96).alias("col"), "l_discount")
    prior = px.groupBy("row", "col").agg(F.max("l_discount").alias("most")).where("most >= 0.06D").select("row", "col")
    seeds = px.where("l_discount < 0.03D").groupBy("mask_id").agg(F.count(F.lit(1)).alias("seed_px"))
    return px.select("mask_id", "row", "col").distinct(), prior, seeds


@query(f"WITH {MASKS_SQL} SELECT mask_id, area_px, round(water_share, 9) AS water_share FROM ar JOIN seeds USING (mask_id) WHERE area_px <= 0.5 * 96000 AND area_px <= 3.5 * seed_px AND water_share >= 0.35")
def mask_validate_seeded(spark, sf_dir):
    masks, prior, seeds = _masks(spark, sf_dir)
    return segments.seeded(masks, prior, seeds, 96_000, 3.5).select("mask_id", "area_px", r9("water_share"))


@query(f"WITH {MASKS_SQL} SELECT mask_id, area_px, round(water_share, 9) AS water_share FROM ar WHERE water_share >= 0.5")
def mask_validate_auto(spark, sf_dir):
    masks, prior, _ = _masks(spark, sf_dir)
    return segments.unseeded(masks, prior).select("mask_id", "area_px", r9("water_share"))


@query(f"WITH {MASKS_SQL} SELECT DISTINCT row, col FROM masks WHERE mask_id IN (SELECT mask_id FROM ar WHERE water_share >= 0.5)")
def mask_union(spark, sf_dir):
    masks, prior, _ = _masks(spark, sf_dir)
    return segments.union(masks, segments.unseeded(masks, prior))


GRID_SQL = "cells AS (SELECT x * 100 + y AS id, x::DOUBLE AS xmin, y::DOUBLE AS ymin, x + 1.5::DOUBLE AS xmax, y + 1.5::DOUBLE AS ymax FROM range(64, 91) AS a(x), range(63, 75) AS b(y))"


@query(f"""WITH {views.FOOTPRINT}, {GRID_SQL}, h AS (SELECT c.id, f.layer, f.file FROM cells c LEFT JOIN footprint f ON c.xmin <= f.xmax AND f.xmin <= c.xmax AND c.ymin <= f.ymax AND f.ymin <= c.ymax)
SELECT id, coalesce(string_agg(DISTINCT layer, ',' ORDER BY layer), '') AS layers, count(DISTINCT file) AS n_files, count(layer) AS overlap_count FROM h GROUP BY id""")
def overlap_sets(spark, sf_dir):
    xs, ys = spark.range(64, 91).select(F.col("id").alias("x")), spark.range(63, 75).select(F.col("id").alias("y"))
    cells = xs.join(F.broadcast(ys)).select((F.col("x") * 100 + F.col("y")).alias("id"), F.col("x").cast("double").alias("xmin"), F.col("y").cast("double").alias("ymin"), (F.col("x") + 1.5).alias("xmax"), (F.col("y") + 1.5).alias("ymax"))
    found = overlap.overlap_sets(cells, views.footprints(spark, sf_dir))
    return found.select("id", F.array_join("layers", ",").alias("layers"), F.size("files").cast("long").alias("n_files"), "overlap_count")


@query(f"""WITH RECURSIVE {views.FOOTPRINT}, st AS (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi FROM (SELECT xmin AS x FROM footprint UNION SELECT xmax FROM footprint)),
ev AS (SELECT lo, hi, ymin AS y, 1 AS k FROM st JOIN footprint ON xmin <= lo AND xmax >= hi UNION ALL SELECT lo, hi, ymax, -1 FROM st JOIN footprint ON xmin <= lo AND xmax >= hi),
eg AS (SELECT lo, hi, y, sum(k)::BIGINT AS k FROM ev GROUP BY ALL),
pc AS (SELECT * FROM (SELECT lo AS x0, hi AS x1, y AS y0, lead(y) OVER w AS y1, sum(k) OVER w AS n FROM eg WINDOW w AS (PARTITION BY lo ORDER BY y)) WHERE n > 0),
fr AS (SELECT row_number() OVER (ORDER BY x0, y0) AS id, x0, x1, y0, y1, n, string_agg(f.id, ',' ORDER BY f.id) AS s FROM pc JOIN footprint f ON f.xmin <= x0 AND f.xmax >= x1 AND f.ymin <= y0 AND f.ymax >= y1 GROUP BY x0, x1, y0, y1, n),
e0 AS (SELECT a.id AS a, b.id AS b FROM fr a JOIN fr b ON a.x1 = b.x0 AND a.s = b.s AND a.y0 < b.y1 AND b.y0 < a.y1), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
reach(id, r) AS (SELECT id, id FROM fr UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id WHERE reach.r < e.b),
cl AS (SELECT cell, min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax, sum(6378137 * radians(x1 - x0) * 6378137 * (ln(tan(pi() / 4 + radians(y1) / 2)) - ln(tan(pi() / 4 + radians(y0) / 2)))) AS area, any_value(n) AS n, min(x0) AS mx, arg_min((x0 + x1) / 2, (x0, y0)) AS px, arg_min((y0 + y1) / 2, (x0, y0)) AS py FROM fr JOIN (SELECT id, min(r) AS cell FROM reach GROUP BY id) USING (id) GROUP BY cell)
SELECT round(c.xmin, 6) AS xmin, round(c.ymin, 6) AS ymin, round(c.xmax, 6) AS xmax, round(c.ymax, 6) AS ymax, round(any_value(area), 1) AS area_m2, any_value(n)::BIGINT AS overlap_count, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers, count(DISTINCT file) AS n_files
FROM cl c JOIN footprint f ON f.xmin < px AND px < f.xmax AND f.ymin < py AND py < f.ymax WHERE area > 1 GROUP BY cell, c.xmin, c.ymin, c.xmax, c.ymax""")
def overlap_cells(spark, sf_dir):
    found = overlap.atomic_cells(views.footprints(spark, sf_dir).drop("year"), min_area=1.0)
    return found.select(*[r9(c, digits=6) for c in ("xmin", "ymin", "xmax", "ymax")], r9("area_m2", digits=1), "overlap_count", F.array_join("layers", ",").alias("layers"), F.size("files").cast("long").alias("n_files"))


PATCH_SQL = f"{views.MASK}, pp AS (SELECT image, pi, pj, row - pi * 4 AS pr, col - pj * 4 AS pc, row, col FROM dense, range(0, 3) AS a(pi), range(0, 5) AS b(pj) WHERE row >= pi * 4 AND row < pi * 4 + 8 AND col >= pj * 4 AND col < pj * 4 + 8)"


@query(f"WITH {PATCH_SQL} SELECT image, pi, pj, pr, pc FROM pp")
def patchify(spark, sf_dir):
    return patches.patchify(views.mask(spark, sf_dir), *views.IMAGE, 8, 4).select("image", "pi", "pj", "pr", "pc")


@query(f"WITH {PATCH_SQL}, r AS (SELECT image, pi * 4 + pr AS row, pj * 4 + pc AS col, arg_max(pi * 10 + pj, pi * 10 + pj) AS v FROM pp GROUP BY ALL) SELECT image, row, col, v FROM r")
def unpatchify(spark, sf_dir):
    cut = patches.patchify(views.mask(spark, sf_dir), *views.IMAGE, 8, 4).withColumn("v", F.col("pi") * 10 + F.col("pj"))
    return patches.unpatchify(cut, "v", ("image",), 4)


@query(f"WITH {views.SCENE_PX}, im AS (SELECT row // 48 AS image, row % 48 AS row, col, green FROM scene_px), pp AS (SELECT image, pi, green FROM im, range(0, 11) AS a(pi) WHERE row >= pi * 4 AND row < pi * 4 + 8) SELECT image, pi, round(avg(CASE WHEN green > 0.01 THEN 1.0::DOUBLE ELSE 0 END), 9) AS share FROM pp GROUP BY image, pi HAVING avg(CASE WHEN green > 0.01 THEN 1.0::DOUBLE ELSE 0 END) > 0.75")
def useful_patches(spark, sf_dir):
    px = views.scene_px(spark, sf_dir).select(F.floor(F.col("row") / 48).alias("image"), (F.col("row") % 48).alias("row"), "col", (F.col("green") > 0.01).cast("int").alias("v"))
    return patches.useful(patches.patchify(px, 48, 8, 8, 4), "v", 0.75, ("image", "pi")).select("image", "pi", r9("share"))


@query(f"""WITH {views.MASK}, d AS (SELECT r, c FROM range(-1, 2) AS a(r), range(-1, 2) AS b(c)), er AS (SELECT image, row + r AS row, col + c AS col FROM dense, d GROUP BY 1, 2, 3 HAVING count(*) = 9) SELECT DISTINCT image, row + r AS row, col + c AS col FROM er, d""")
def morph_open(spark, sf_dir):
    return patches.morph_open(views.touched(spark, sf_dir), keys=("image",))


@query(f"""WITH {views.SCENE_PX}, c AS (SELECT scene, (qa & 30 = 0)::INT AS t, (green > swir)::INT AS p FROM scene_px), s AS (SELECT scene, k, count(*) FILTER (WHERE t = k AND p = k)::DOUBLE / nullif(count(*) FILTER (WHERE t = k OR p = k), 0) AS iou FROM c, (VALUES (0), (1)) AS v(k) GROUP BY scene, k) SELECT scene, round(avg(iou), 9) AS iou FROM s GROUP BY scene""")
def iou_mean(spark, sf_dir):
    px = views.scene_px(spark, sf_dir).select("scene", raster.landsat_clear(F.col("qa")).cast("int").alias("t"), (F.col("green") > F.col("swir")).cast("int").alias("p"))
    return patches.mean_iou(px, "t", "p", ("scene",)).select("scene", r9("iou"))


@query("SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.6 THEN 'train' WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8 THEN 'val' ELSE 'test' END AS split FROM orders")
def hash_split(spark, sf_dir):
    return patches.hash_split(views.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.6, "val": 0.2, "test": 0.2})


@query(f"WITH {views.FOOTPRINT} SELECT id, substr(md5(concat_ws('|', xmin::INT::VARCHAR, ymin::INT::VARCHAR, '{A}', 'landsat')), 1, 12) AS key FROM footprint")
def cache_keys(spark, sf_dir):
    return views.footprints(spark, sf_dir).select("id", tx.cache_key(F.col("xmin").cast("int"), F.col("ymin").cast("int"), F.lit(A), F.lit("landsat")).alias("key"))


def queries() -> dict:
    from strandline.plans import inputs, shapes  # noqa: F401  they register their queries here

    return QUERIES


def oracle_sql() -> dict[str, str]:
    from strandline.plans import inputs, shapes  # noqa: F401

    return SQL
