"""Thin-plate surfaces and warped sheets against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import resample, sheets


def plain_surface(points):
    """The surface through (a, b, s, t), in the coordinates as they are."""
    at = np.array(points, float)
    mid, span = (at[:, :2].min(0) + at[:, :2].max(0)) / 2, np.ptp(at[:, :2], axis=0).max()
    uv = (at[:, :2] - mid) / span
    k = lambda d2: np.where(d2 > 0, d2 * np.log(np.where(d2 > 0, d2, 1)) / 2, 0)
    n = len(at)
    system = np.zeros((n + 3, n + 3))
    for i in range(n):
        system[i, :n] = k(((uv[i] - uv) ** 2).sum(1))
        system[i, n:] = system[n:, i] = (1, *uv[i])
    w = np.linalg.lstsq(system, np.vstack([at[:, 2:], np.zeros((3, 2))]), rcond=None)[0]

    def f(a, b):
        p = (np.array([a, b]) - mid) / span
        return tuple(k(((p - uv) ** 2).sum(1)) @ w[:n] + w[n] + p @ w[n + 1 :])

    return f


def test_surfaces_equal_a_plain_version(spark):
    random.seed(11)
    rows = []
    for sheet in (1, 2, None):
        for _ in range(12):
            a, b = random.uniform(7e6, 7.1e6), random.uniform(9e6, 9.1e6)
            rows.append((sheet, a, b, a / 50 + random.gauss(0, 20), -b / 60 + random.gauss(0, 20)))
    same = [(3, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 3.0, 5.0), (3, 1.0, 0.0, 4.0, 3.0), (3, 0.0, 1.0, 2.0, 4.0)]
    bad = [(4, 0.0, 0.0, 1.0, 1.0), (4, 1.0, 1.0, 2.0, 2.0), (4, 2.0, 2.0, 3.0, 3.0), (5, 0.0, 0.0, 1.0, 1.0), (6, 0.0, 0.0, None, 1.0), (6, 0.0, 1.0, 1.0, 1.0), (6, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows + same + bad, "sheet int, a double, b double, s double, t double")
    fits = sheets.thin_plate_fit(df, ["sheet"])
    assert {r.sheet: r.n for r in fits.collect()} == {1: 12, 2: 12, 3: 3}
    asked = [(k, *random.choice([(7.02e6, 9.03e6), (7.08e6, 9.01e6)])) for k in (1, 2)] + [(r[0], r[1], r[2]) for r in rows if r[0]]
    found = sheets.on_surface(spark.createDataFrame(asked, "sheet int, x double, y double").join(fits, "sheet"), "x", "y").collect()
    assert len(found) == len(asked)
    for sheet in (1, 2):
        plain = plain_surface([r[1:] for r in rows if r[0] == sheet])
        for r in found:
            if r.sheet == sheet:
                assert np.allclose((r.s, r.t), plain(r.x, r.y), atol=1e-6)
    exact = {(r[0], r[1], r[2]): r[3:] for r in rows}
    assert all(np.allclose((r.s, r.t), exact[r.sheet, r.x, r.y], atol=1e-6) for r in found if (r.sheet, r.x, r.y) in exact)
    means = sheets.on_surface(spark.createDataFrame([(3, 0.0, 0.0)], "sheet int, x double, y double").join(fits, "sheet"), "x", "y").first()
    assert np.allclose((means.s, means.t), (2.0, 3.0))
    assert sheets.thin_plate_fit(df.limit(0), ["sheet"]).count() == 0
    with pytest.raises(Exception, match="over 5 control points"):
        sheets.thin_plate_fit(df, ["sheet"], most=5).collect()


def test_a_bent_sheet_is_warped_and_cut(spark):
    random.seed(2)
    height, width, res = 20, 26, 9.0
    ground = lambda x, y: (7_800_000 + 10 * x + 1.5 * y, 9_900_000 - 10 * y + 0.7 * x)
    gcps = [(x, y, *(v + random.uniform(-6, 6) for v in ground(x, y))) for x in (0, 13, 26) for y in (0, 10, 20)]
    back = lambda x, y: (math.degrees(x / 6378137), math.degrees(2 * math.atan(math.exp(y / 6378137)) - math.pi / 2))
    points = spark.createDataFrame([("m", x, y, *back(a, b)) for x, y, a, b in gcps], "sheet string, x int, y int, lon double, lat double")
    image = {(r, k): r * 100 + k for r in range(height) for k in range(width) if (r, k) != (7, 7)}
    pixels = spark.createDataFrame([("m", r, k, v) for (r, k), v in image.items()], "sheet string, row long, col long, v int")
    corners = [ground(*p) for p in ((2, 2), (2, 18), (24, 18), (24, 2), (2, 2))]
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in (back(*p) for p in corners)])
    cut = spark.range(1).select(F.lit("m").alias("sheet"), ring.alias("ring"))
    got = {(r.row, r.col): (r.v, r.alpha) for r in sheets.warp(pixels, points, cut, ["sheet"], ["v"], res).collect()}
    plain, want = plain_surface([(a, b, x, y) for x, y, a, b in gcps]), {}
    xs, ys = zip(*corners, strict=True)
    for row in range(math.floor(-max(ys) / res), math.floor(-min(ys) / res) + 1):
        for col in range(math.floor(min(xs) / res), math.floor(max(xs) / res) + 1):
            x, y = (col + 0.5) * res, -(row + 0.5) * res
            turns = [(p, q) for p, q in zip(corners, corners[1:]) if (p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1])]
            if len(turns) % 2:
                s, t = plain(x, y)
                v = image.get((math.floor(t), math.floor(s)))
                want[row, col] = (v, 0 if v is None else 255)
    assert got == want and len(want) > 300 and (None, 0) in want.values()
    assert sheets.warp(pixels, points, cut.where("false"), ["sheet"], ["v"], res).count() == 0
    smooth = sheets.warp(pixels, points, cut, ["sheet"], ["v"], res, method="bilinear")
    assert smooth.count() == len(want) and smooth.where("v is null").count() == 0


def test_keys_keep_rasters_apart(spark):
    source = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 5.0), ("b", 0, 1, 7.0)], "k string, row long, col long, v double")
    targets = spark.createDataFrame([("a", 3, 4, 0.0, 0.5), ("b", 3, 4, 0.0, 0.5)], "k string, row long, col long, at_row double, at_col double")
    assert sorted(tuple(r) for r in resample.resampled(source, targets, ["v"], keys=("k",)).collect()) == [("a", 3, 4, 1.0), ("b", 3, 4, 6.0)]
    assert sorted(tuple(r) for r in resample.resampled(source, targets, ["v"], "nearest", ("k",)).collect()) == [("a", 3, 4, None), ("b", 3, 4, 7.0)]
