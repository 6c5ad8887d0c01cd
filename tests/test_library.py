"""Operators and functions that no registered query covers, on small inputs with known results."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from strandline import storage
from strandline.functions import geo, raster
from strandline.functions import text as tx
from strandline.operators import catalogue, composite, overlap, patches, regions, segments, timeslices
from strandline.sources import map_files, readers
from strandline.streaming import daily_counts


def values(spark, *columns, rows="1"):
    return [tuple(r) for r in spark.sql(f"SELECT * FROM VALUES ({rows}) AS t(c)").select(*columns).collect()]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


# functions


def test_utm_of_known_points(spark):
    x, y = geo.utm(F.lit(69.0), F.lit(0.0), geo.utm_zone(F.lit(69.0)))
    assert one(spark, x, y, geo.utm_zone(F.lit(69.0)), geo.utm_zone(F.lit(-180.0)), geo.utm_zone(F.lit(179.9))) == (pytest.approx(500_000), pytest.approx(0), 42, 1, 60)
    # the meridian arc from the equator to 45 degrees is 4984944.378 m on this ellipsoid
    x, y = geo.utm(F.lit(9.0), F.lit(45.0), F.lit(32))
    assert one(spark, x, y) == (pytest.approx(500_000, abs=1e-6), pytest.approx(0.9996 * 4_984_944.378, abs=2e-3))
    south = geo.utm(F.lit(9.0), F.lit(-45.0), F.lit(32))[1]
    assert one(spark, south)[0] == pytest.approx(10_000_000 - 0.9996 * 4_984_944.378, abs=2e-3)


def test_metric_area_of_a_degree_raster(spark):
    pixels = spark.createDataFrame([(r, c, 1) for r in range(10) for c in range(10)], "row long, col long, label int")
    got = regions.area_perimeter(pixels, affine=(0.001, 0, 68.0, 0, -0.001, 66.9), degrees=True).first()
    want = 0.01 * 111_320 * 0.3923 * 0.01 * 111_320
    assert got.area == pytest.approx(want, rel=0.02) and got.perimeter == pytest.approx(2 * 0.01 * 111_320 * 1.3923, rel=0.02)


def test_tiles_pixels_and_grids(spark):
    assert one(spark, *geo.tile_xy(F.lit(0.0), F.lit(0.0), 1), *geo.tile_xy(F.lit(180.0), F.lit(-85.06), 3), *geo.tile_xy(F.lit(68.5), F.lit(66.9), 10)) == (1, 1, 7, 7, 706, 253)
    assert one(spark, geo.geo_to_pixel(F.lit(2.5), F.lit(0.0), F.lit(10.0), F.lit(100)), geo.grid_size(F.lit(0.0), F.lit(1.0), 0.3), geo.grid_size(F.lit(0.0), F.lit(0.1), 1.0)) == (25, 3, 1)
    assert one(spark, *geo.ordered_bbox(F.lit(3.0), F.lit(1.0)), geo.degrees_minutes(F.lit(60.0), F.lit(30.0))) == (1.0, 3.0, 60.5)


def test_pixels_units_and_thresholds(spark):
    assert one(spark, *geo.pixel_centre(F.lit(0), F.lit(1), (30.0, 0, 500.0, 0, -30.0, 900.0)), *geo.area_units(F.lit(2_000_000.0))) == (545.0, 885.0, 2.0, 200.0)
    assert one(spark, raster.above(F.lit(0.7)), raster.above(F.lit(0.5)), raster.above(F.lit(None).cast("double"))) == (True, False, False)


def test_labels_and_strings(spark):
    assert one(spark, tx.area_label(F.lit(2_500_000.0)), tx.area_label(F.lit(900.0)), tx.length_label(F.lit(1500.0)), tx.length_label(F.lit(12.0))) == ("2.50 km2", "900 m2", "1.50 km", "12 m")
    assert one(spark, tx.int_year(F.lit("1984.0")), tx.int_year(F.lit("")), tx.int_year(F.lit("nan")), tx.int_year(F.lit("1984"))) == (1984, None, None, 1984)
    assert one(spark, tx.hover_line(F.lit("a"), F.lit(1980), F.lit("f")), tx.hover_line(F.lit("a"), F.lit(None), F.lit("f"))) == ("a (1980) — f", "a — f")
    lines = F.array(tx.hover_line(F.lit(" a "), F.lit(1980), F.lit("x/y/f.tif")), tx.hover_line(F.lit(None), F.lit(1970), F.lit("")))
    assert one(spark, lines, tx.hover_text(F.lit(2), F.array(F.lit("p"), F.lit("q")))) == (["a (1980) — f.tif", "(1970)"], "<b>Overlaps: 2</b><br>p<br>q")
    assert one(spark, tx.date_token(F.lit("LC08_20200131_x")), tx.date_token(F.lit("none")), tx.stem(F.lit("/a/b.c.tif")), tx.path_year(F.lit("/m (1950-1960)/x"))) == ("20200131", None, "b.c", 1950)
    assert one(spark, tx.tile_url("http://t", F.lit("/a b.tif"))) == ("http://t?url=%2Fa+b.tif&rescale=0,3000",)


def test_sensors_have_their_own_scale(spark):
    rows = [("landsat", 10_000, 0), ("landsat", 10_000, 2), ("sentinel2", 5_000, 4), ("sentinel2", 5_000, 9), ("other", 1, 0)]
    df = spark.createDataFrame(rows, "sensor string, dn int, qa int")
    got = [r[0] for r in df.select(raster.by_sensor(F.col("dn"), F.col("qa"), F.col("sensor"))).collect()]
    assert got == [pytest.approx(0.075), None, pytest.approx(0.5), None, None]
    with pytest.raises(ValueError):
        raster.clear(F.col("qa"), "other")
    assert one(spark, raster.display8(F.lit(0.15)), raster.display8(F.lit(9.0)), raster.display8(F.lit(None).cast("double"))) == (127, 255, 0)


# time slices and limits


def test_request_limits():
    assert timeslices.parse_range("2020-01-01/2020-02-01") == ("2020-01-01", "2020-02-01")
    assert timeslices.parse_bbox("70, 65.5,71,66") == (70.0, 65.5, 71.0, 66.0)
    for text in ("1,2,3", "a,b,c,d", ""):
        with pytest.raises(ValueError):
            timeslices.parse_bbox(text)
    assert timeslices.bounded_area((70.0, 66.0, 70.5, 66.5)) == pytest.approx(0.5 * 111.32 * 0.5 * 111.32 * 0.4028, rel=1e-3)
    with pytest.raises(ValueError):
        timeslices.bounded_area((60.0, 60.0, 70.0, 70.0))


def test_windows_meet_rows_by_month(spark):
    rnd = random.Random(3)
    days = [datetime.date(2019, 1, 1) + datetime.timedelta(rnd.randrange(900)) for _ in range(200)] + [None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, dt date")
    slices = spark.createDataFrame([("a", datetime.date(2019, 1, 15), datetime.date(2019, 6, 2)), ("b", datetime.date(2019, 6, 2), datetime.date(2019, 6, 2)), ("c", datetime.date(2020, 2, 1), datetime.date(2019, 2, 1)), ("d", datetime.date(2019, 5, 31), datetime.date(2021, 1, 1))], "label string, start date, end date")
    want = sorted((i, s.label) for i, d in enumerate(days) if d for s in slices.collect() if s.start <= d <= s.end)
    assert sorted((r.i, r.label) for r in timeslices.in_windows(rows, slices).collect()) == want


def test_a_series_is_bounded(spark):
    with pytest.raises(ValueError):
        timeslices.changes(spark.range(700).select(F.col("id").alias("label"), "id"), "id")


# composites and scenes


def test_a_composite_needs_a_clear_scene(spark):
    px = spark.createDataFrame([(1, 0, 0, 2, 0.1), (1, 0, 1, 2, 0.1), (2, 0, 0, 0, 0.2)], "scene long, row long, col long, qa int, green double")
    assert [r.scene for r in composite.required_scenes(px).collect()] == [2]
    for none in (px.where("scene = 1"), px.limit(0)):
        with pytest.raises(ValueError):
            composite.required_scenes(none)


def test_scene_search(spark):
    day = datetime.date(2020, 5, 1)
    rows = [(1, "landsat", day, 5.0, 70.0, 65.0, 71.0, 66.0), (2, "landsat", day, 1.0, 70.0, 65.0, 71.0, 66.0), (3, "landsat", day, 50.0, 70.0, 65.0, 71.0, 66.0), (4, "sentinel2", day, 1.0, 70.0, 65.0, 71.0, 66.0), (5, "landsat", day, 1.0, 80.0, 65.0, 81.0, 66.0), (6, "landsat", datetime.date(2021, 1, 1), 1.0, 70.0, 65.0, 71.0, 66.0)]
    df = spark.createDataFrame(rows, "scene_id long, sensor string, dt date, cloud double, xmin double, ymin double, xmax double, ymax double")
    assert [r.scene_id for r in composite.search(df, (70.5, 65.5, 72, 67), "2020-01-01", "2020-12-31", "landsat").collect()] == [2, 1]
    assert [r.scene_id for r in composite.search(df, (70.5, 65.5, 72, 67), "2020-01-01", "2020-12-31", "landsat", limit=1).collect()] == [2]


# catalogue


SHEET = "map_file string, datum string, year int, corners map<int,struct<x:int,y:int,lat:double,lon:double>>"


def sheets(spark):
    square = {1: (0, 0, 66.0, 68.0), 2: (9, 0, 66.0, 69.0), 3: (9, 9, 67.0, 69.0), 4: (0, 9, 67.0, 68.0)}
    rows = [("a", " Pulkovo 1942 ", 1960, square), ("b", "wgs_84", None, square), ("c", "?", 1950, {k: square[k] for k in (1, 2, 3)}), ("d", "WGS84", 1940, {k: square[k] for k in (1, 2)}), ("e", "Pulkovo 1942(83)", 1970, square), ("f", "EPSG:3857", 1970, square), ("g", None, 1971, None)]
    return spark.createDataFrame(rows, SHEET)


def test_footprints_are_shifted_to_wgs84(spark):
    got = {r.map_file: r for r in catalogue.normalised_footprints(sheets(spark)).collect()}
    assert {k: r.datum_status for k, r in got.items()} == {"a": "shifted", "b": "native_wgs84", "c": "unknown_fallback", "e": "shifted", "f": "unknown_fallback"}
    assert got["a"].shift_m == pytest.approx(107, abs=3) and 20 < got["e"].shift_m < 250 and got["b"].shift_m == got["c"].shift_m == got["f"].shift_m == 0
    assert len(got["a"].ring) == 5 and got["a"].ring[0] == got["a"].ring[4] and len(got["c"].ring) == 4
    assert (got["b"].xmin, got["b"].ymin, got["b"].xmax, got["b"].ymax) == (68.0, 66.0, 69.0, 67.0) and abs(got["a"].xmin - 68) < 0.01
    accepted = catalogue.acceptance(catalogue.normalised_footprints(sheets(spark))).first()
    assert (accepted.all_placed, accepted.all_known, accepted.all_shifted) == (True, False, True)


def test_points_of_a_sheet_are_moved(spark):
    got = sheets(spark).where("map_file in ('a', 'g')").orderBy("map_file").select(catalogue.points_to_wgs84(F.col("corners")).alias("c")).collect()
    assert got[1].c is None and {k: (v.x, v.y) for k, v in got[0].c.items()} == {1: (0, 0), 2: (9, 0), 3: (9, 9), 4: (0, 9)}
    assert all(0 < abs(v.lon - (68 if k in (1, 4) else 69)) < 0.01 for k, v in got[0].c.items())


def test_catalogue_reports(spark):
    df = sheets(spark)
    assert sorted(r.map_file for r in df.where(catalogue.four_corners()).collect()) == ["a", "b", "e", "f"]
    assert [r.map_file for r in catalogue.by_year(df).collect()] == ["d", "c", "a", "e", "f", "g", "b"]
    assert [r.map_file for r in catalogue.by_year(df, missing_first=True).collect()][0] == "b"
    assert sum(r.n for r in catalogue.year_histogram(df, 3).collect()) == 6
    report = {r.column: tuple(r)[1:] for r in catalogue.column_report(df, ["year", "datum"]).collect()}
    assert report["year"] == (6, 1, 5, "1940", "1971") and report["datum"][:2] == (6, 1)
    assert catalogue.missing_counts(df, ["year", "datum"]).first().asDict() == {"year": 1, "datum": 1}
    batch = spark.createDataFrame([("ok",), ("failed",), (None,), ("ok",)], "status string")
    assert tuple(catalogue.outcome_counts(batch).first()) == (2, 2)
    listing = spark.createDataFrame([("a",), ("x",)], "map_file string")
    assert [r.map_file for r in catalogue.with_listing(df, listing, "map_file").collect()] == ["a"]
    assert catalogue.with_listing(df, listing, "map_file", there=False).count() == 6
    assert catalogue.present(df, ["year", "nothing"]).columns == ["year"]
    roi = catalogue.regions_of_interest(spark, [("r", 1.0, 2.0, 3.0, 4.0)]).first()
    assert (roi.roi, roi.north) == ("r", 4.0)


def test_features_are_geojson(spark):
    df = catalogue.normalised_footprints(sheets(spark)).where("map_file = 'b'")
    got = catalogue.feature_collection(df, properties=["map_file", "year"]).first().feature
    assert got == '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[68.0,66.0],[69.0,66.0],[69.0,67.0],[68.0,67.0],[68.0,66.0]]]},"properties":{"map_file":"b"}}'


# regions


def test_numbers_follow_the_first_pixels(spark):
    labels = spark.createDataFrame([(5,), (5,), (900,), (17,), (-3,)], "label long")
    assert {r.label: r.number for r in regions.numbered(labels).collect()} == {-3: 1, 5: 2, 17: 3, 900: 4}


def test_lake_report_and_floes(spark):
    lakes = spark.createDataFrame([(1, 10.0, None), (2, 20.0, 1.2), (3, 400.0, 1.4)], "label long, area double, fractal_dimension double")
    got = regions.lake_report(lakes, edges=[0.0, 15.0, 500.0]).first()
    assert (got.lake_count, got.total_area, got.mean_fractal_dimension) == (3, 430.0, pytest.approx(1.3)) and [tuple(x) for x in got.size_distribution] == [(1, 1), (2, 2)]
    assert regions.lake_report(lakes, metrics=()).columns == ["lake_count", "total_area"]
    none = regions.lake_report(lakes.limit(0)).first()
    assert (none.lake_count, none.total_area, none.mean_fractal_dimension, none.size_distribution) == (0, 0.0, None, [])
    with pytest.raises(ValueError):
        regions.lake_metrics(lakes, metrics=("volume",))
    bar = spark.createDataFrame([(r, c, 1) for r in range(2) for c in range(12)] + [(r, c, 2) for r in range(20, 24) for c in range(6)], "row long, col long, label int")
    shapes = {r.label: r for r in regions.moments(bar).collect()}
    assert shapes[1].major_axis / shapes[1].minor_axis == pytest.approx(6) and shapes[1].orientation == pytest.approx(0, abs=1e-6)
    assert [r.label for r in regions.elongated(regions.moments(bar), 100).collect()] == [2]
    joined = regions.with_metrics(spark.createDataFrame([(1,), (9,)], "label long"), lakes)
    assert {r.label: r.area for r in joined.collect()} == {1: 10.0, 9: None}


def test_cells_do_not_depend_on_the_grid(spark):
    rnd = random.Random(4)
    boxes = [(i, f"l{i % 3}", f"f{i}", x / 4, y / 4, (x + rnd.randint(1, 9)) / 4, (y + rnd.randint(1, 9)) / 4) for i in range(25) for x, y in [(rnd.randint(0, 20), rnd.randint(0, 20))]]
    boxes.append((99, "l0", "twin", *boxes[0][3:]))
    df = spark.createDataFrame(boxes, "id long, layer string, file string, xmin double, ymin double, xmax double, ymax double")
    # flood fill over quarter-degree squares
    cover = {(x, y): frozenset(b[0] for b in boxes if b[3] <= x / 4 < b[5] and b[4] <= y / 4 < b[6]) for x in range(32) for y in range(32)}
    left, want = {k for k, v in cover.items() if v}, []
    while left:
        first = min(left)
        todo, seen = [first], {first}
        while todo:
            x, y = todo.pop()
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left and q not in seen and cover[q] == cover[first]:
                    seen.add(q)
                    todo.append(q)
        left -= seen
        files = sorted(b[2] for b in boxes if b[0] in cover[first])
        want.append((min(x for x, _ in seen) / 4, min(y for _, y in seen) / 4, len(cover[first]), tuple(files)))
    for size in (0.5, 1.0, 7.0):
        got = overlap.atomic_cells(df, size).collect()
        assert sorted((r.xmin, r.ymin, r.overlap_count, tuple(r.files)) for r in got) == sorted(want), size
    assert overlap.atomic_cells(df.limit(0)).count() == 0


def test_cells_of_repeated_rows_and_missing_ids(spark):
    schema = "id long, layer string, file string, xmin double, ymin double, xmax double, ymax double, year int"
    one, two = (1, "a", "x/f", 0.0, 0.0, 2.0, 1.0, 1980), (2, "b", "g", 1.0, 0.0, 2.0, 1.0, None)
    cells = lambda rows: sorted((r.xmin, r.xmax, r.overlap_count, r.files, r.lines) for r in overlap.atomic_cells(spark.createDataFrame(rows, schema)).collect())
    assert cells([one, one, two, two]) == [(0.0, 1.0, 2, ["x/f"], ["a (1980) — f"]), (1.0, 2.0, 4, ["g", "x/f"], ["a (1980) — f", "b — g"])]
    nameless = [(None, *one[1:]), (None, *two[1:])]
    assert [c[:3] for c in cells(nameless)] == [(0.0, 1.0, 1), (1.0, 2.0, 2)]
    beside = [(1, "a", "f", 0.0, 0.0, 1.0, 1.0, None), (2, "b", "g", 1.0, 0.0, 2.0, 1.0, None)]
    assert [c[:3] for c in cells(beside * 2)] == [(0.0, 1.0, 2), (1.0, 2.0, 2)]
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 1, 2, 3]), "a", f"f{k}", float(x), float(y), float(x + rnd.randint(1, 3)), float(y + rnd.randint(1, 3)), 1) for k in range(8) for x, y in [(rnd.randint(0, 4), rnd.randint(0, 4))]] * 2
    got = overlap.atomic_cells(spark.createDataFrame(rows, schema)).collect()
    painted = {(x, y): [r for r in rows if r[3] <= x < r[5] and r[4] <= y < r[6]] for x in range(8) for y in range(8)}
    want = {}
    for cover in painted.values():
        if cover:
            key = (len(cover), tuple(sorted({r[2] for r in cover})))
            want[key] = want.get(key, 0) + 1
    degrees = {}
    for r in got:  # the squares of one cover may be several cells; their number of squares is not kept, but each cover has a cell
        degrees[r.overlap_count, tuple(r.files)] = True
    assert set(degrees) == set(want)


# patches and segments


def test_patch_helpers(spark):
    px = spark.createDataFrame([(0, 0, "a", 200.0), (0, 1, "a", 100.0), (0, 0, "b", 0.5)], "row long, col long, image string, v double")
    assert {(r.image, r.col): r.v for r in patches.unit_range(px, ["v"], ("image",)).collect()} == {("a", 0): pytest.approx(200 / 255), ("a", 1): pytest.approx(100 / 255), ("b", 0): 0.5}
    assert [(r.row, r.col) for r in patches.crop(px.where("image = 'a'"), 0, 1, 5, 5).collect()] == [(0, 0)]
    images, masks = spark.createDataFrame([("p1", 1), ("p2", 2)], "name string, v int"), spark.createDataFrame([("p2", 9), ("p3", 8)], "name string, v int")
    assert [tuple(r) for r in patches.paired(images, masks).collect()] == [("p2", 2, 9)]
    scores = spark.createDataFrame([(0.5,), (1.0,), (0.7,)], "iou double")
    assert tuple(patches.mean_over_images(scores).first()) == (2, pytest.approx(0.6))
    assert sorted(map(tuple, patches.value_counts(px, "v", ("image",)).collect())) == [("a", 100.0, 1), ("a", 200.0, 1), ("b", 0.5, 1)]


def test_opening_by_a_larger_square_and_several_times(spark):
    pixels = {(r, c) for r in range(12) for c in range(12)} | {(20, c) for c in range(30)}
    mask = spark.createDataFrame(sorted(pixels), "row long, col long")
    for size, times in ((5, 1), (3, 2), (5, 3)):
        k = times * (size // 2)
        inner = {p for p in pixels if all((p[0] + i, p[1] + j) in pixels for i in range(-k, k + 1) for j in range(-k, k + 1))}
        want = {(r + i, c + j) for r, c in inner for i in range(-k, k + 1) for j in range(-k, k + 1)}
        assert {tuple(r) for r in patches.morph_open(mask, size, times).collect()} == want


def test_segments(spark):
    a = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 1)], "mask_id long, row long, col long")
    assert [tuple(r) for r in segments.difference(a.where("mask_id = 1"), a.where("mask_id = 2")).collect()] == [(0, 0)]
    assert sorted(tuple(r) for r in segments.union(a).collect()) == [(0, 0), (0, 1)]
    scored = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.9), (7, 3, 0.9), (8, 4, 0.1)], "object_id long, mask_id long, score double")
    assert sorted(tuple(r) for r in segments.best_by_score(scored).collect()) == [(7, 2), (8, 4)]
    chips = spark.createDataFrame([("c", 0, 0, True), ("c", 0, 1, False)], "chip string, row int, col int, water boolean")
    assert [(r.row, r.col) for r in segments.segment(chips).collect()] == [(0, 0)]

    def all_of_it(pdf):
        return pdf.assign(mask_id=5)[["mask_id", "row", "col"]]

    assert segments.segment(chips, all_of_it).count() == 2


# sources and sinks


def test_images_beside_map_files(spark):
    made = spark.createDataFrame([("/m/a.map", "X.gif"), ("/m/b.map", "y.gif"), ("/n/c.map", "z.gif")], "map_file string, gif_file string")
    listing = spark.createDataFrame([("/m/x.GIF",), ("/m/X.gif",), ("/m/Y.GIF",), ("/m/z.gif",)], "path string")
    assert {r.map_file: r.gif_path for r in map_files.resolve_images(made, listing).collect()} == {"/m/a.map": "/m/X.gif", "/m/b.map": "/m/Y.GIF", "/n/c.map": None}


def test_repeated_map_files_stay_as_they_are(spark):
    files = spark.createDataFrame([("/m (1950)/a.map", "x\nscale:5 index:Q-1\nWGS 84,b")] * 3, "map_file string, text string")
    assert [(r.scale, r["index"], r.datum, r.year) for r in map_files.fill_missing(map_files.parse(files)).collect()] == [("5", "Q-1", "WGS 84", 1950)] * 3


def test_band_files_and_geojson(spark, tmp_path):
    files = spark.createDataFrame([("/s/L_1_B5.tif",), ("/s/L_1_B3.tif",), ("/s/L_2_B5.tif",)], "path string")
    assert [tuple(r) for r in readers.band_sets(files, {"B3": "B3"}).collect()] == [("/s/L_1_B5.tif", "/s/L_1_B3.tif")]
    (tmp_path / "f.json").write_text('{"features": [{"geometry": {"coordinates": [[[1, 2], [3, 9], [0, 4]]]}}]}')
    assert tuple(readers.geojson_bounds(spark, str(tmp_path / "f.json")).first()) == (0.0, 2.0, 3.0, 9.0)


def test_tables_are_written_and_read_again(spark, tmp_path):
    df = sheets(spark).select("map_file", "year", "corners")
    readers.write_table(df, f"{tmp_path}/t", ["year"])
    back = readers.read_footprints(spark, f"{tmp_path}/t")
    assert back.count() == 7 and {r.cog for r in back.collect()} == {f"{x}.tif" for x in "abcdefg"}
    readers.write_csv(df, f"{tmp_path}/c")
    nested = readers.read_csv(spark, f"{tmp_path}/c", {"corners": "map<string,struct<x:int,y:int,lat:double,lon:double>>"})
    assert {r.map_file: r.corners and len(r.corners) for r in nested.collect()} == {"a": 4, "b": 4, "c": 3, "d": 2, "e": 4, "f": 4, "g": None}
    made = []
    for _ in range(2):
        assert readers.cached_table(spark, f"{tmp_path}/k", lambda: made.append(1) or df).count() == 7
    assert made == [1]
    done = spark.createDataFrame([("a", "ok"), ("b", "failed")], "map_file string, status string")
    assert readers.not_done(df, done, "map_file").count() == 6


def test_listing_is_sorted_and_limited(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.map").write_text("x")
    assert [r.map_file[-5:] for r in map_files.listed(map_files.read_map_files(spark, str(tmp_path)), 2).collect()] == ["a.map", "b.map"]


def test_download_products(spark):
    rows = [("s1", True, [("x_B4.TIF", True), ("x_B5.TIF", True), ("x_QA.TIF", False)]), ("s2", False, [("y_B4.TIF", True)])]
    scenes = spark.createDataFrame(rows, "scene_id string, bulk boolean, secondary array<struct<name:string,available:boolean>>")
    assert sorted(tuple(r) for r in readers.products(scenes, ["B4", "QA"]).collect()) == [("s1", "x_B4.TIF")]
    assert readers.products(scenes).count() == 2


def test_intermediate_tables_need_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_stream_counts_by_day(spark, tmp_path):
    rows = [(datetime.datetime(2020, 1, 1, 3), 1.0), (datetime.datetime(2020, 1, 1, 9), 3.0), (datetime.datetime(2020, 1, 20), 5.0)]
    spark.createDataFrame(rows, "ts timestamp, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{tmp_path}/in")
    run = daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((str(r.start)[:10], r.n, r.mean_value) for r in spark.table("days").collect()) == [("2020-01-01", 2, 2.0), ("2020-01-20", 1, 5.0)]
