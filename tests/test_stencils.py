import heapq
import math

import numpy as np
import pytest

from strandline.operators import catalogue, composite, regions, stencils

AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def plain_diffusion(v, steps, kappa, gamma, spacing, wide):
    """The whole image at once, pixel by pixel; what isn't a number is outside."""
    for _ in range(steps):
        new = v.copy()
        for r in range(v.shape[0]):
            for c in range(v.shape[1]):
                for dr, dc, apart in ((0, 1, spacing[1]), (0, -1, spacing[1]), (1, 0, spacing[0]), (-1, 0, spacing[0])):
                    if 0 <= r + dr < v.shape[0] and 0 <= c + dc < v.shape[1] and not math.isnan(d := v[r + dr, c + dc] - v[r, c]):
                        new[r, c] += gamma * d / apart * (1 / (1 + (d / kappa) ** 2) if wide else math.exp(-((d / kappa) ** 2)))
        v = new
    return v


@pytest.mark.parametrize(("tile", "halo", "wide"), [(16, 4, False), (64, 3, True), (7, 7, False)])
def test_diffusion_equals_the_whole_image(spark, tile, halo, wide):
    rnd = np.random.default_rng(1)
    v = rnd.normal(100, 60, size=(37, 45))
    v[5:9, 20] = np.nan
    rows = [(r, c, float(x) if not math.isnan(x) else None) for (r, c), x in np.ndenumerate(v) if (r, c) != (30, 3)]
    v[30, 3] = np.nan
    got = stencils.diffused(spark.createDataFrame(rows, "row int, col int, v double"), "v", 9, 80.0, 0.2, (1.0, 2.0), wide, tile, halo).collect()
    want = plain_diffusion(v, 9, 80.0, 0.2, (1.0, 2.0), wide)
    assert len(got) == len(rows)
    assert all(r.v is None if math.isnan(want[r.row, r.col]) else abs(r.v - want[r.row, r.col]) < 1e-9 for r in got)


def blobs():
    """Disks that touch, a long bar, single pixels."""
    disks = ((20, 20, 12), (20, 40, 11), (52, 30, 9), (50, 70, 14), (70, 62, 6))
    inside = {(r, c) for r in range(90) for c in range(100) if any((r - y) ** 2 + (c - x) ** 2 <= d * d for y, x, d in disks) or r in (80, 81, 82) and c > 4}
    return inside | {(0, 0), (0, 2), (88, 99)}


def plain_distances(mask):
    out = {}
    for r, c in mask:
        d = 1
        while all((r + y, c + x) in mask for y in range(-d, d + 1) for x in range(-d, d + 1) if max(abs(y), abs(x)) == d):
            d += 1
        out[r, c] = d
    return out


def plain_flood(d, markers):
    """Pixels in the order of their final costs, from a queue."""
    best, queue = {}, [(-(1 << 30), 0, label, p) for p, label in markers.items()]
    heapq.heapify(queue)
    while queue:
        m, s, label, p = heapq.heappop(queue)
        if p in best:
            continue
        best[p] = label
        for dr, dc in AROUND:
            q = (p[0] + dr, p[1] + dc)
            if q in d and q not in best and q not in markers:
                low = max(m, -d[q])
                heapq.heappush(queue, (low, s + 1 if low == m else 1, label, q))
    return best


@pytest.mark.parametrize("tile", [16, 64])
def test_distances_and_watershed_equal_the_whole_image(spark, tile):
    mask = blobs()
    df = spark.createDataFrame(sorted(mask), "row long, col long")
    d = plain_distances(mask)
    assert {(r.row, r.col): r.d for r in stencils.distances(df, tile).collect()} == d
    cores = {p for p, x in d.items() if x > 0.3 * max(d.values())}
    labels, names = {}, sorted(cores)
    for p in names:
        if p not in labels:
            todo = [p]
            labels[p] = p[0] * regions.WIDTH + p[1]
            while todo:
                r, c = todo.pop()
                for q in ((r + y, c + x) for y, x in AROUND):
                    if q in cores and q not in labels:
                        labels[q] = labels[p]
                        todo.append(q)
    flood = plain_flood(d, labels)
    got = {(r.row, r.col): (r.label, r.line) for r in stencils.watershed(df, 0.3, tile=tile).collect()}
    assert {p: v[0] for p, v in got.items()} == {p: flood.get(p) for p in mask}
    assert len(set(labels.values())) == 4 and got[0, 0] == (None, False)
    for (r, c), (label, line) in got.items():
        near = [flood[r + y, c + x] for y, x in AROUND if (r + y, c + x) in flood]
        assert line == (label is not None and any(x < label for x in near))


def test_stencils_of_nothing(spark):
    none = spark.createDataFrame([], "row long, col long, v double")
    assert stencils.diffused(none, "v").count() == 0
    assert stencils.distances(none).count() == 0
    assert stencils.watershed(none).count() == 0


def test_perimeters_follow_the_middles_of_boundary_pixels(spark):
    disk = {(r, c) for r in range(40) for c in range(40) if (r - 20) ** 2 + (c - 20) ** 2 <= 225}
    bar = {(r, c) for r in (50, 51, 52) for c in range(10)}
    df = spark.createDataFrame([(1, *p) for p in disk] + [(2, *p) for p in bar] + [(3, 90, 90)], "label long, row long, col long")
    got = {r.label: r.perimeter for r in regions.perimeters(df).collect()}

    def plain(mask):
        edge = {p for p in mask if any((p[0] + y, p[1] + x) not in mask for y, x in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        total = 0.0
        for r, c in edge:
            code = 1 + 2 * sum((r + y, c + x) in edge for y, x in ((0, 1), (1, 0), (0, -1), (-1, 0))) + 10 * sum((r + y, c + x) in edge for y, x in ((1, 1), (1, -1), (-1, 1), (-1, -1)))
            total += 1.0 if code in (5, 7, 15, 17, 25, 27) else 2**0.5 if code in (21, 33) else (1 + 2**0.5) / 2 if code in (13, 23) else 0.0
        return total

    assert got[2] == 22.0 and got[3] == 0.0 and math.isclose(got[1], plain(disk)) and abs(got[1] / (2 * math.pi * 15) - 1) < 0.07


def test_lake_metrics_of_simplified_outlines(spark):
    disk = spark.createDataFrame([(r, c) for r in range(90) for c in range(90) if (r - 45) ** 2 + (c - 45) ** 2 <= 1600], "row long, col long")
    labels = regions.label_regions(disk)
    raw, fine = (regions.lake_metrics(labels, (10, 0, 0, 0, -10, 0), simplify_px=px, metrics=()).first() for px in (0.0, 1.0))
    assert raw.perimeter > 1.25 * 2 * math.pi * 400 and abs(fine.perimeter / (2 * math.pi * 400) - 1) < 0.03 and abs(fine.area / raw.area - 1) < 0.03
    degrees = regions.lake_metrics(labels, (0.0002, 0, 68.0, 0, -0.0001, 67.0), simplify_px=1.0, metrics=(), degrees=True).first()
    assert degrees.area > 0 and degrees.perimeter > 0


def test_bands_after_one_without_contrast_are_left_out(spark):
    rows = [(1, 1.0, 5.0, 1.0), (1, 2.0, 5.0, 2.0), (2, 0.0, 1.0, 1.0), (2, 4.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "scene int, a double, b double, c double")
    got = sorted(((r.scene, r.a, r.b, r.c) for r in composite.min_max(df, ["a", "b", "c"], gamma=2.0, stop=True).collect()), key=repr)
    assert got == [(1, 0.0, None, None), (1, 1.0, None, None), (2, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)]


def test_composite_without_a_usable_scene_is_an_error(spark):
    px = spark.createDataFrame([(1, 0, 0, 8, 0.5)], "scene long, row long, col long, qa int, green double")
    with pytest.raises(ValueError, match="none of 1"):
        composite.median_composite(px, ["green"])
    assert composite.median_composite(px, ["green"], required=False).count() == 0


def test_summary_of_numbers(spark):
    df = spark.createDataFrame([(float(k), None if k % 2 else k) for k in range(101)], "x double, n int")
    x, n = catalogue.summary(df, ["x", "n"]).collect()
    assert (x.column, x.n, x["mean"], x.least, x.q25, x.q50, x.q75, x.largest) == ("x", 101, 50.0, 0.0, 25.0, 50.0, 75.0, 100.0) and math.isclose(x.spread, 29.300170647967224)
    assert (n.n, n["mean"], n.q50) == (51, 50.0, 50.0)
