import math

import numpy as np

from strandline.operators import warps

POINT = "sheet long, at int, x double, y double, lon double, lat double"


def sheets():
    rnd, rows = np.random.default_rng(3), []
    for sheet, n in enumerate((3, 6, 9, 40)):
        xy = rnd.uniform(0, 5000, size=(n, 2))
        for k, (x, y) in enumerate(xy.tolist()):
            bend = 1e-9 * x * y * (sheet > 1)
            rows.append((sheet, k, x, y, 60 + 2e-4 * x + 1e-5 * y + bend + rnd.normal(0, 1e-5), 67 - 1e-4 * y + 2e-5 * x - bend + rnd.normal(0, 1e-5)))
    rows += [(7, k, float(k), 2.0 * k, 60.0 + k, 67.0) for k in range(5)]  # in a line
    rows += [(8, 0, 1.0, 1.0, 60.0, 67.0), (8, 1, 2.0, 5.0, 60.0, 67.0), (3, 99, None, 1.0, 60.0, 67.0)]
    return rows


def plain(rows, sheet, order, without=None):
    own = [r for r in rows if r[0] == sheet and r[2] is not None]
    x, y = (np.array([r[k] for r in own]) / 5000 for k in (2, 3))
    a = np.stack([x**p * y**q for p, q in warps.TERMS[order]], 1)
    b = np.array([r[4:] for r in own])
    use = [k for k in range(len(own)) if k != without]
    fit = np.linalg.lstsq(a[use], b[use], rcond=None)[0]
    return b - a @ fit


def test_affine_fits_equal_least_squares(spark):
    rows = sheets()
    df = spark.createDataFrame(rows, POINT)
    fits = warps.affine_fit(df, ["sheet"])
    got = {(r.sheet, r["at"]): (r.d_lon, r.d_lat) for r in warps.affine_residuals(df, fits, ["sheet"]).collect()}
    for sheet in (0, 1, 2, 3):
        for k, want in enumerate(plain(rows, sheet, 1)):
            assert np.allclose(got[sheet, k], want, atol=1e-9)
    known = {r.sheet: r for r in fits.collect()}
    assert known[7].lon_x is None and known[8].lat_0 is None and known[3].n == 40


def test_second_order_fits_and_left_out_errors(spark):
    rows = sheets()
    out = warps.polynomial_fit(spark.createDataFrame(rows, POINT), ["sheet"])
    got = {(r.sheet, r["at"]): r for r in out.collect()}
    assert len(got) == len(rows) - 1
    for sheet in (2, 3):
        for k, want in enumerate(plain(rows, sheet, 2)):
            assert np.allclose((got[sheet, k].d_lon, got[sheet, k].d_lat), want, atol=1e-9)
            assert np.allclose((got[sheet, k].loo_lon, got[sheet, k].loo_lat), plain(rows, sheet, 2, k)[k], atol=1e-7)
    assert got[0, 0].d_lon is None and got[7, 1].d_lon is None
    assert max(abs(got[1, k].d_lon) for k in range(6)) < 1e-9 and got[1, 0].loo_lon is None  # six points settle six terms
    report = {r.sheet: r for r in warps.fit_report(out, ["sheet"]).collect()}
    assert report[3].n == 40 and report[3].rms < report[3].loo_rms and report[3].worst >= report[3].rms


def test_thin_plate_surface_goes_through_its_points(spark):
    rows = [r for r in sheets() if r[0] == 2]
    xy = np.array([r[2:4] for r in rows])
    r2 = ((xy[:, None] - xy) ** 2).sum(2)
    df = spark.createDataFrame(rows, POINT)
    terms = warps.thin_plate_terms(df, df.withColumnRenamed("at", "id"), ["sheet"]).collect()
    got = np.zeros_like(r2)
    for t in terms:
        got[t.id, t["at"]] = t.term
    assert np.allclose(got, np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1)) / 2, 0)) and math.isclose(got[0, 1], got[1, 0])


def test_the_best_shift_by_area(spark):
    from pyspark.sql import functions as F

    from strandline.functions import geo

    wide, fine, other = (10.0, 0, 0, 0, 0, 0, 0), (20.0, 0, 0, 0, 0, 0, 0), (30.0, 0, 0, 0, 0, 0, 0)
    shifts = ((4284, (20, 35, -169, 82), 5.0, wide), (4284, (60, 60, 80, 70), 1.0, fine), (4179, (9, 41, 28, 55), 2.0, other), (4284, (60, 60, 80, 70), 1.0, other))
    rows = [(4284, 65.0, 65.0), (4284, 30.0, 50.0), (4284, -175.0, 66.0), (4284, 0.0, 0.0), (4179, 65.0, 65.0), (4326, 65.0, 65.0), (4284, None, None)]
    df = spark.createDataFrame(rows, "code int, lon double, lat double")
    got = [r.dx for r in df.select(F.get(geo.best_parameters(F.col("code"), F.col("lon"), F.col("lat"), shifts), F.lit(0)).alias("dx")).collect()]
    assert got == [20.0, 10.0, 10.0, 20.0, 30.0, None, 20.0]  # where no area holds the place, the finest set
