import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import geo, raster
from strandline.operators import catalogue, graph, overlap, patches, regions, timeslices
from strandline.sources import map_files, readers, vectors


def slices(spark, *args):
    return [(r.label, str(r.start), str(r.end)) for r in timeslices.windows(spark, *args).orderBy("label").collect()]


def test_annual_windows_reach_into_the_next_year(spark):
    assert slices(spark, "2021-11-01", "2022-02-01", "annual") == [("2021", "2021-11-01", "2022-02-01"), ("2022", "2022-11-01", "2023-02-01")]


def test_annual_windows_skip_days_that_do_not_exist(spark):
    assert [x[0] for x in slices(spark, "2020-02-29", "2024-06-01", "annual")] == ["2020", "2024"]


def test_monthly_windows_are_cut_to_the_range(spark):
    assert slices(spark, "2023-12-15", "2024-03-10", "monthly") == [("2023-12", "2023-12-15", "2023-12-31"), ("2024-01", "2024-01-01", "2024-01-31"), ("2024-02", "2024-02-01", "2024-02-29"), ("2024-03", "2024-03-01", "2024-03-10")]


def test_windows_of_odd_ranges(spark):
    assert slices(spark, "2024-05-05", "2024-05-05", "seasonal") == [("2024-Q2", "2024-05-05", "2024-05-05")]
    assert slices(spark, "2024-05-05", "2024-05-04", "monthly") == []
    with pytest.raises(ValueError):
        timeslices.windows(spark, "2024-01-01", "2024-02-01", "weekly")
    with pytest.raises(ValueError):
        timeslices.bounded_windows(spark, "1900-01-01", "1960-01-01", "monthly")
    with pytest.raises(ValueError):
        timeslices.parse_range("2024-01-01")


def test_datum_shift_is_about_108_metres(spark):
    x, y = geo.to_wgs84(F.lit(68.5), F.lit(66.9))
    assert spark.range(1).select(geo.shift_metres(F.lit(68.5), F.lit(66.9), x, y)).first()[0] == pytest.approx(107.6, abs=0.2)


def test_missing_and_cloudy_pixels(spark):
    rows = [(0, 0.5, 0.1), (2, 0.5, 0.1), (0, None, 0.1), (0, 2.0, 0.1), (0, 0.0, 0.0), (1, -0.1, 0.1), (0, float("nan"), 0.1)]
    df = spark.createDataFrame(rows, "qa int, green double, swir double")
    r = raster.reflectance(F.col("green"), raster.landsat_clear(F.col("qa")))
    assert [x[0] for x in df.select(r).collect()] == [0.5, None, None, None, 0.0, -0.1, None]
    index = raster.mndwi(r, F.col("swir"))
    assert [x[0] for x in df.select(raster.water_mask(index)).collect()] == [True, False, False, False, False, False, False]


def grid(spark, pixels):
    return spark.createDataFrame(pixels or [(0, 0)], "row long, col long").limit(len(pixels))


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [3, 7, 64])
def test_labels_equal_flood_fill(spark, connectivity, tile):
    rnd = random.Random(connectivity)
    pixels = {(r, c) for r in range(20) for c in range(20) if rnd.random() < 0.45}
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    want, left = {}, set(pixels)
    while left:
        first = min(left)
        todo, seen = [first], {first}
        while todo:
            r, c = todo.pop()
            for dr, dc in near:
                if (p := (r + dr, c + dc)) in pixels and p not in seen:
                    seen.add(p)
                    todo.append(p)
        want |= {p: first[0] * regions.WIDTH + first[1] for p in seen}
        left -= seen
    got = regions.label_regions(grid(spark, sorted(pixels)), connectivity, tile)
    assert {(r.row, r.col): r.label for r in got.collect()} == want


def test_no_pixels_give_no_labels(spark):
    assert regions.label_regions(grid(spark, [])).count() == 0


def test_ring_with_a_hole(spark):
    pixels = [(r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)]
    labels = grid(spark, pixels).withColumn("label", F.lit(1))
    got = regions.area_perimeter(labels).first()
    assert (got.area, got.perimeter) == (24.0, 24.0)
    assert regions.boundary(labels, ["label"]).count() == 20


def test_square_has_a_straight_boundary(spark):
    pixels = [(r, c) for r in range(32) for c in range(32)]
    d = regions.lake_metrics(grid(spark, pixels).withColumn("label", F.lit(1))).first().fractal_dimension
    assert 0.9 < d < 1.3  # five sizes only: 124, 60, 28, 12 and 4 boxes
    assert regions.lake_metrics(grid(spark, pixels[:100]).withColumn("label", F.lit(1))).first().fractal_dimension is None


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.components(links.limit(0)).count() == 0


def test_box_join_finds_each_pair_once(spark):
    rnd = random.Random(5)
    boxes = [(i, x, y, x + rnd.random() * 3, y + rnd.random() * 3) for i in range(60) for x, y in [(rnd.randint(0, 10) / 2, rnd.randint(0, 10) / 2)]]
    df = spark.createDataFrame(boxes, "id long, xmin double, ymin double, xmax double, ymax double")
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert sorted((r.left_id, r.right_id) for r in overlap.box_join(df, df).collect()) == want


def test_patches_round_trip(spark):
    px = spark.createDataFrame([(r, c, float(r * 100 + c)) for r in range(8) for c in range(8)], "row long, col long, v double")
    cut = patches.patchify(px, 8, 8, 4, 2)
    assert cut.select("pi", "pj").distinct().count() == 9 and cut.count() == 9 * 16
    assert sorted(map(tuple, patches.unpatchify(cut, "v", step=2).collect())) == sorted(map(tuple, px.collect()))


def test_polygon_fill(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    df = spark.createDataFrame([(1, ring)], f"id int, ring {readers.RING}")
    assert sorted((r.row, r.col) for r in patches.fill_polygon(df, ["id"]).collect()) == [(r, c) for r in range(3) for c in range(4)]


MAP = """OziExplorer Map Data File
title
a.gif
1 ,Map Code,
Pulkovo 1942,WGS 84,0,0,x
scale:1000 index:P-1 year:1961
Projection Setup,0,69,1.0,500000,0
IWH,Map Image Width/Height,10
Point01,xy,1,2,in,deg,60,30,N,70,15,W
Point02,xy,bad,2,in,deg,60,30,N,70,15,E
MMPXY,1,5,6
MMPLL,2,70.0,60.0
scale:2000 index:P-2 year:1962"""


def test_map_files(spark, tmp_path):
    at = tmp_path / "dir with space (1982-1983)"
    at.mkdir()
    (at / "a.map").write_text(MAP)
    (at / "b.map").write_bytes(b"one\ntwo\xff\n")
    (at / "c.MAP").write_text(MAP)
    files = map_files.read_map_files(spark, str(tmp_path))
    got = {r.map_file.rsplit("/", 1)[1]: r for r in map_files.parse(files).collect()}
    assert sorted(got) == ["a.map", "b.map"]
    a, b = got["a.map"], got["b.map"]
    assert (a.gif_file, a.year, a.scale, a["index"], a.datum, a.image_width) == ("a.gif", 1962, "2000", "P-2", "Pulkovo 1942", None)
    assert [tuple(p) for p in a.control_points] == [(1, 2, 60.5, 70.25)]
    assert {k: tuple(v) for k, v in a.corners.items()} == {1: (5, 6, None, None), 2: (None, None, 60.0, 70.0)}
    assert b.datum is None and b.control_points == [] and b.corners == {}
    filled = {r.map_file.rsplit("/", 1)[1]: r for r in map_files.fill_missing(map_files.parse(files)).collect()}
    assert filled["b.map"].year == 1982


def test_datums(spark):
    df = spark.createDataFrame([(" WGS 84 ",), ("Pulkovo 1942",), ("epsg:4284",), ("?",), (None,)], "datum string")
    got = [(r.datum_status, r.epsg) for r in catalogue.resolve_datum(df).collect()]
    assert sorted(got) == sorted([("native_wgs84", 4326), ("shifted", 4284), ("shifted", 4284), ("unknown_fallback", 4326), ("unknown_fallback", 4326)])


def test_kml_and_annotations(spark, tmp_path):
    (tmp_path / "l.kml").write_text("<kml><Document><Placemark><name>a</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 1,0,0 1,1,0 0,0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>")
    got = vectors.read_kml(spark, str(tmp_path)).collect()
    assert [(r.layer, r.name, len(r.ring)) for r in got] == [("l", "a", 4)]
    (tmp_path / "v.json").write_text('{"k": {"filename": "f", "regions": [{"shape_attributes": {"all_points_x": [0, 1, 1], "all_points_y": [0, 0, 1]}}, {"shape_attributes": {}}]}}')
    assert [(r.image, r.filename, r.region, len(r.ring)) for r in readers.read_annotations(spark, str(tmp_path / "v.json")).collect()] == [("k", "f", 0, 3)]
