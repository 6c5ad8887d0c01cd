"""KML with holes and nested groups, stored footprints on other planes, exact medians, boxes of very different sizes."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.operators import catalogue, overlap, ranks, timeslices
from strandline.sources import readers, vectors


def border(points, tag="outerBoundaryIs"):
    return f"<{tag}><LinearRing><coordinates>\n {points}\n\t</coordinates></LinearRing></{tag}>"


SQUARE = "0,0,0 4,0,0 4,4,0 0,4,0 0,0,0"
HOLE = border("1,1 2,1 2,2 1,2 1,1", "innerBoundaryIs")


def test_kml_files(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    group = f"<MultiGeometry><Polygon>{border(SQUARE)}</Polygon><MultiGeometry><Polygon>{border('9,9 10,9 10,10')}{HOLE}</Polygon></MultiGeometry></MultiGeometry>"
    marks = [
        f"<name>hole</name><year>1950</year><Polygon>{border(SQUARE)}{HOLE}{border('3,3 x,3 3,4', 'innerBoundaryIs')}</Polygon>",
        f"<name>group</name>{group}",
        "<name>point</name><Point><coordinates>1,1</coordinates></Point>",
        f"<name>nan</name><Polygon>{border('0,0 NaN,1 1,1 0,0')}</Polygon>",
        f"<name>far</name><Polygon>{border('0,0 Infinity,1 1,1 0,0')}</Polygon>",
        f"<name>two</name><Polygon>{border('0,0 1,1 0,0')}</Polygon>",
        f"<name>empty</name><Polygon>{border('')}</Polygon>",
        "<name>bare</name>",
    ]
    (deep / "my layer.kml").write_text("<kml><Document><Folder>" + "".join(f"<Placemark>{m}</Placemark>" for m in marks) + "</Folder></Document></kml>")
    (tmp_path / "UP.KML").write_text(f"<kml><Placemark><name>up</name><Polygon>{border(SQUARE)}</Polygon></Placemark></kml>")
    (tmp_path / "none.kml").write_text("<kml></kml>")
    (tmp_path / "other.txt").write_text(f"<kml><Placemark><Polygon>{border(SQUARE)}</Polygon></Placemark></kml>")
    found = vectors.read_kml(spark, str(tmp_path), ["year"])
    area = vectors.polygon_area(F.col("ring"), F.col("holes"))
    got = found.select("source_file", "layer", "name", "year", "polygon", F.size("holes"), F.size("ring"), area).collect()
    assert sorted(tuple(r) for r in got) == [
        ("UP.KML", "UP", "up", None, 0, 0, 5, 16.0),
        ("my layer.kml", "my layer", "group", None, 0, 0, 5, 16.0),
        ("my layer.kml", "my layer", "group", None, 1, 1, 4, -0.5),
        ("my layer.kml", "my layer", "hole", "1950", 0, 1, 5, 15.0),
    ]


def test_placemark_texts(spark):
    rows = [(1, f"<Placemark><Polygon>{border(SQUARE)}</Polygon></Placemark>"), (2, "no xml <"), (3, None), (4, "")]
    got = vectors.placemark_polygons(vectors.placemarks(spark.createDataFrame(rows, "id long, t string"), "t"), ["id"])
    assert [(r.id, r.polygon, len(r.ring), r.holes) for r in got.collect()] == [(1, 0, 5, [])]
    assert vectors.placemark_polygons(vectors.placemarks(spark.createDataFrame([], "id long, t string"), "t"), ["id"]).count() == 0


def test_layers_join_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, layer string"), spark.createDataFrame([("y", 1950)], "layer string, year int")
    assert sorted((r.id or 0, r.layer, r.year) for r in vectors.together(a, b).collect()) == [(0, "y", 1950), (1, "x", None)]


def test_footprints_of_other_planes(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((70, 64), (71, 64), (71, 66), (70, 64))])
    here = spark.range(1).select("id", ring.alias("ring"))
    for code, away in ((3857, geo.mercator), (3413, geo.polar)):
        moved = here.withColumn("ring", F.transform("ring", lambda p: F.struct(*[v.alias(n) for v, n in zip(away(p["x"], p["y"]), "xy", strict=True)])))  # noqa: B023
        r = vectors.on_wgs84(moved, code).first()
        assert [(round(p.x, 9), round(p.y, 9)) for p in r.ring] == [(70, 64), (71, 64), (71, 66), (70, 64)]
        assert (round(r.xmin, 9), round(r.ymin, 9), round(r.xmax, 9), round(r.ymax, 9)) == (70, 64, 71, 66)
    shifted = vectors.on_wgs84(here, 4284).first().ring[0]
    assert 50 < abs(shifted.x - 70) * 48800 + abs(shifted.y - 64) * 111320 < 300
    with pytest.raises(ValueError):
        vectors.on_wgs84(here, 9999)


def test_overlay_columns(spark, tmp_path):
    rows = [("/m (1950-1960)/a.b.map", None, 1.0), ("/m/c.map", 1971, 2.0), (None, None, 3.0)]
    df = spark.createDataFrame(rows, "map_file string, year int, x double").withColumn("ring", geo.box_ring(F.col("x"), F.lit(2), F.lit(0.0), F.lit(1)))
    got = vectors.with_overlay_columns(df).orderBy("x").collect()
    assert [(r.source_file, r.layer, r.year) for r in got] == [("a.b.map", "a.b", 1950), ("c.map", "c", 1971), (None, None, None)]
    r = vectors.with_overlay_columns(df.select("x")).first()
    assert (r.source_file, r.layer, r.year) == ("", "footprint", None)
    made = []

    def build():
        made.append(1)
        return df

    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/f")
    for _ in range(2):  # an empty table is built once more, a full one isn't
        again = vectors.load_or_build(spark, f"{tmp_path}/f", build)
        assert again.count() == 3 and {"source_file", "layer", "xmin"} <= set(again.columns)
    assert made == [1]


def test_downloads(spark):
    secondary = "array<struct<entity_id:string,product_id:string,display_id:string,bulk:boolean,groups:array<string>>>"
    rows = [
        ("a", "p", True, "dds", [("a1", "q1", "x_B4.TIF", True, ["g", "h"]), ("a2", "q2", "x_B5_B4.TIF", False, ["k"])]),
        ("a", "p", True, "dds", None),
        ("b", "p", True, "folder", [("b1", "q1", "y_B4.TIF", True, None)]),
        ("c", "p", False, "dds", [("c1", "q1", "z_B5.TIF", True, ["h"])]),
        ("d", None, None, None, []),
    ]
    given = spark.createDataFrame(rows, f"entity_id string, product_id string, bulk boolean, system string, secondary {secondary}")
    got = lambda *a: sorted(tuple(r) for r in readers.downloads(given, *a).collect())
    assert got("bundle") == [("a", "p")]
    assert got("band", ["B4", "B5"]) == [("a1", "q1"), ("b1", "q1"), ("c1", "q1")]
    assert got("band") == []
    assert got("all") == [("a", "p"), ("a1", "q1"), ("b1", "q1")]
    assert got("band_group") == [("a1", "g"), ("a1", "h"), ("c1", "h")]
    assert got("band_group", [" h ", "none"]) == [("a1", "h"), ("c1", "h")]
    with pytest.raises(ValueError):
        got("other")


def test_sheets_in_box_and_their_neatlines(spark):
    corner = lambda x, y: (0, 0, y, x)
    four = {1: corner(70.0, 64.0), 2: corner(72.0, 64.0), 3: corner(72.0, 66.0), 4: corner(70.0, 66.0)}
    rows = [("a", "WGS 84", four), ("b", "WGS 84", {k: four[k] for k in (1, 2, 3)}), ("c", "x", {k: (0, 0, None, None) for k in four}), ("d", None, None), ("e", "WGS 84", {k: (0, 0, y + 1.5, x + 2) for k, (_, _, y, x) in four.items()})]
    sheets = spark.createDataFrame(rows, "map_file string, datum string, corners map<int,struct<x:int,y:int,lat:double,lon:double>>")
    names = lambda df: sorted(r.map_file for r in df.collect())
    assert names(catalogue.sheets_in_box(sheets, 70, 64, 72, 66)) == ["a"]
    assert names(catalogue.sheets_in_box(sheets, 71, 65, 72.5, 66)) == []
    assert names(catalogue.sheets_in_box(sheets, 71, 65, 72, 65.5, partial=True)) == ["a", "e"]
    lines = {r.map_file: r.cutline for r in catalogue.neatlines(sheets).collect()}
    assert sorted(lines) == ["a", "b", "e"]
    assert lines["a"] == '{"type":"Polygon","coordinates":[[[70.0,64.0],[72.0,64.0],[72.0,66.0],[70.0,66.0],[70.0,64.0]]]}'
    resolved = catalogue.resolve_datum(sheets)
    assert [tuple(r) for r in catalogue.unknown_datums(resolved, 1).collect()] == [("c", "x")]


def test_step_counts_equal_the_windows(spark):
    for start, end in (("2019-11-30", "2021-02-01"), ("2020-01-01", "2020-01-01"), ("2020-03-31", "2020-04-01")):
        for cadence in ("monthly", "seasonal", "annual"):
            steps = spark.range(1).select(timeslices.step_count(F.lit(start).cast("date"), F.lit(end).cast("date"), cadence)).first()[0]
            years = int(end[:4]) - int(start[:4]) + 1
            assert steps == (years if cadence == "annual" else timeslices.windows(spark, start, end, cadence).count())
    day = F.lit("2020-01-01").cast("date")
    assert spark.range(1).select(timeslices.step_count(day, F.date_sub(day, 1), "monthly"), timeslices.step_count(F.lit(None).cast("date"), day, "annual"), timeslices.step_count(day, day, "none")).first()[:] == (0, 0, 1)
    with pytest.raises(ValueError):
        timeslices.step_count(day, day, "weekly")


def test_objects_by_image(spark):
    regions = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "image string, region int")
    assert sorted((r.image or "", r.n_objects) for r in readers.objects_by_image(regions).collect()) == [("", 3), ("a", 2), ("b", 1)]


def test_medians_equal_a_plain_version(spark):
    random.seed(5)
    rows = [(random.choice([None, 1, 2]), random.choice(["a", "b"]), random.choice([None, float("nan"), 0.0, random.gauss(0, 5), 7.0, 7.0])) for _ in range(3000)]
    rows += [(9, "one", 4.0), (9, "none", None), (9, "pair", 1.0), (9, "pair", 2.0)] + [(8, "hot", 1.0)] * 1000 + [(8, "hot", float(k)) for k in range(2, 999)]
    df = spark.createDataFrame(rows, "k int, s string, v double").repartition(7)
    groups = {}
    for k, s, v in rows:
        if v is not None and v == v:
            groups.setdefault((k, s), []).append(v)
    got = {(r.k, r.s): r.median for r in ranks.medians(df, "v", ["k", "s"]).collect()}
    assert got == {g: statistics.median(v) for g, v in groups.items()}
    assert ranks.medians(df, "v", []).first().median == statistics.median([v for g in groups.values() for v in g])
    assert ranks.medians(df.limit(0), "v", ["k"]).count() == 0


def test_boxes_of_all_sizes_meet(spark):
    random.seed(3)
    sides = [0.0, 0.5, 1.0, 3.0, 20.0, 90.0, 360.0]
    made = []
    for k in range(250):
        w, h = random.choice(sides), random.choice(sides)
        x, y = random.randint(-360, 360 - int(w)) / 2, random.randint(-180, 180) / 2
        made.append((k, x, y, x + w, y + h))
    boxes = spark.createDataFrame(made, "id int, xmin double, ymin double, xmax double, ymax double")
    for touches in (True, False):
        under = (lambda a, b: a <= b) if touches else (lambda a, b: a < b)
        want = sorted((a[0], b[0]) for a in made for b in made if under(a[1], b[3]) and under(b[1], a[3]) and under(a[2], b[4]) and under(b[2], a[4]))
        assert sorted(tuple(r) for r in overlap.box_join(boxes, boxes, 1.0, touches).collect()) == want
    world = spark.createDataFrame([(1, -180.0, -90.0, 180.0, 90.0)], boxes.schema)
    assert overlap._dealt(world, spark.createDataFrame([(9,)], "top int"), "left", 1.0).count() <= 60
    assert overlap.box_join(boxes.limit(0), boxes).count() == 0
