import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.operators import regions, resample

POINTS = [(lon, lat) for lon in (-179.5, -45.0, 0.0, 68.5, 123.25) for lat in (55.0, 66.9, 70.0, 80.0, 89.5)]


def test_polar_plane(spark):
    df = spark.createDataFrame(POINTS, "lon double, lat double")
    x, y = geo.polar(F.col("lon"), F.col("lat"))
    lon, lat = geo.polar_to_lonlat(F.col("x"), F.col("y"))
    rows = df.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    for r in rows:
        assert abs(r.lat - r.lat2) * 111e3 < 1e-6 and abs((r.lon - r.lon2 + 180) % 360 - 180) * 111e3 * math.cos(math.radians(r.lat)) < 1e-6
    # a point of the plane of code 3413 by a second way: the scale is 1 where the plane is true, and the pole is the middle
    at70 = [r for r in rows if r.lat == 70.0]
    n = 6378137.0 / math.sqrt(1 - (geo._eccentricity()[1] * math.sin(math.radians(70))) ** 2)
    step = df.limit(1).select(*[v.alias(k) for k, v in zip("xy", geo.polar(F.lit(0.001), F.lit(70.0)), strict=True)]).first()
    there = next(r for r in at70 if r.lon == 0.0)
    assert math.isclose(math.hypot(step.x - there.x, step.y - there.y), n * math.cos(math.radians(70)) * math.radians(0.001), rel_tol=1e-6)


def test_equal_area_plane(spark):
    df = spark.createDataFrame([p for p in POINTS if abs(p[0] - 60) < 70], "lon double, lat double")
    x, y = geo.equal_area(F.col("lon"), F.col("lat"), F.lit(60.0), F.lit(70.0))
    lon, lat = geo.equal_area_to_lonlat(F.col("x"), F.col("y"), 60.0, 70.0)
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lat - r.lat2) * 111e3 < 1e-5 and abs(r.lon - r.lon2) * 111e3 * math.cos(math.radians(r.lat)) < 1e-5
    # areas: a small box's is that of the ellipsoid there
    corners = [(60.0, 75.0), (60.01, 75.0), (60.01, 75.01), (60.0, 75.01)]
    at = spark.createDataFrame(corners, "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    area = abs(sum(p.x * q.y - q.x * p.y for p, q in zip(at, [*at[1:], at[0]], strict=True))) / 2
    a, e = geo._eccentricity()
    s, d = math.sin(math.radians(75.005)), math.radians(0.01)
    assert math.isclose(area, a * a * (1 - e * e) / (1 - e * e * s * s) ** 2 * math.cos(math.radians(75.005)) * d * d, rel_tol=1e-6)


def test_bounds_with_points_on_the_edges(spark):
    box = [F.lit(v) for v in (-60.0, 75.0, 30.0, 80.0)]
    x0, y0, x1, y1 = (spark.range(1).select(*geo.densified_bounds(*box, geo.polar)).first())
    corners = spark.createDataFrame([(-60.0, 75.0), (-60.0, 80.0), (30.0, 75.0), (30.0, 80.0)], "lon double, lat double").select(*[v.alias(k) for k, v in zip("xy", geo.polar(F.col("lon"), F.col("lat")), strict=True)]).collect()
    assert y0 < min(r.y for r in corners) - 1000 and x1 >= max(r.x for r in corners) and x0 <= min(r.x for r in corners) and y1 >= max(r.y for r in corners) - 1e-6


def test_lakes_beyond_the_zones_and_on_a_given_plane(spark):
    pixels = spark.createDataFrame([(1, r, c) for r in range(4) for c in range(4)], "label long, row long, col long")
    affine = (0.01, 0, 20.0, 0, -0.001, 86.0)
    far = regions.area_perimeter(pixels, affine=affine, degrees=True).first()
    a, e = geo._eccentricity()
    s = math.sin(math.radians(85.998))
    want = a * a * (1 - e * e) / (1 - e * e * s * s) ** 2 * math.cos(math.radians(85.998)) * math.radians(0.04) * math.radians(0.004)
    assert math.isclose(far.area, want, rel_tol=1e-5)
    given = regions.area_perimeter(pixels, affine=affine, degrees=True, plane=geo.polar).first()
    assert 0.9 < given.area / want < 1.1 and given.area != far.area


@pytest.mark.parametrize("method", resample.METHODS)
def test_resampling(spark, method):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(9, 11))
    rows = [(r, c, float(x)) for (r, c), x in np.ndenumerate(v) if (r, c) not in ((4, 4), (4, 5))] + [(4, 4, None)]
    source = spark.createDataFrame(rows, "row long, col long, v double")
    grid = resample.target_grid(spark, 7, 5, (20.0, 3.0, -5.0, -1.0, -14.0, 90.0))
    r, c = resample.to_pixels(F.col("x"), F.col("y"), (10.0, 0.0, 0.0, 0.0, -10.0, 90.0))
    targets = grid.select("row", "col", r.alias("at_row"), c.alias("at_col"))
    got = {(x.row, x.col): x.v for x in resample.resampled(source, targets, ["v"], method).collect()}
    v[4, 4] = v[4, 5] = np.nan
    for t in targets.collect():
        x, y = 20 * (t.col + 0.5) + 3 * (t.row + 0.5) - 5, -(t.col + 0.5) - 14 * (t.row + 0.5) + 90
        ar, ac = (90 - y) / 10 - 0.5, x / 10 - 0.5
        assert math.isclose(ar, t.at_row, abs_tol=1e-9) and math.isclose(ac, t.at_col, abs_tol=1e-9)
        near = [(math.floor(ar + 0.5), math.floor(ac + 0.5), 1.0)] if method == "nearest" else [(math.floor(ar) + i, math.floor(ac) + j, (1 - abs(ar - math.floor(ar) - i)) * (1 - abs(ac - math.floor(ac) - j))) for i in (0, 1) for j in (0, 1)]
        known = [(v[i, j], w) for i, j, w in near if 0 <= i < 9 and 0 <= j < 11 and not math.isnan(v[i, j]) and w > 0]
        want = sum(x * w for x, w in known) / sum(w for _, w in known) if known else None
        assert (want is None and got[t.row, t.col] is None) or math.isclose(got[t.row, t.col], want, abs_tol=1e-9)
    with pytest.raises(ValueError, match="cubic"):
        resample.resampled(source, targets, ["v"], "cubic")
