import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandline.operators import subdivision
from tests.test_simplify import meet

SHEET = "id long, layer string, file string, ring array<struct<x: double, y: double>>"


def sheets_of(spark, rings):
    return spark.createDataFrame([(k, f"l{k % 3}", f"f{k}", [(float(x), float(y)) for x, y in [*r, r[0]]]) for k, r in enumerate(rings)], SHEET)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def turned(ring, angle, x, y):
    c, s = math.cos(angle), math.sin(angle)
    return [(x + c * a - s * b, y + s * a + c * b) for a, b in ring]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def inside(ring, x, y):
    n = 0
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        if (a[1] <= y) != (b[1] <= y):
            n += a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) > x
    return n % 2 == 1


def clipped(ring, by):
    """A ring cut by the half-planes of a convex counter-clockwise one."""
    for a, b in zip(by, [*by[1:], by[0]]):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        out = []
        for p, q in zip(ring, [*ring[1:], ring[0]]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1])))
        ring = out
        if not ring:
            return []
    return ring


def overlaid(spark, rings, unit=1e-6, size=1.0, **options):
    cells, sides = subdivision.overlay(sheets_of(spark, rings), unit, size, **options)
    return cells.collect(), sides.collect()


def by_cover(cells):
    out = {}
    for r in cells:
        out[tuple(sorted(r.ids))] = out.get(tuple(sorted(r.ids)), 0) + r.area
    return out


def test_boxes_equal_painted_squares(spark):
    rnd, rings = random.Random(3), []
    for _ in range(14):
        x, y = rnd.randrange(12), rnd.randrange(12)
        rings.append(box(x, y, x + rnd.randrange(1, 7), y + rnd.randrange(1, 7)))
    rings += [rings[0], rings[1]]  # repeated rows
    want = {}
    for x in range(20):
        for y in range(20):
            if cover := tuple(k for k, r in enumerate(rings) if r[0][0] <= x < r[2][0] and r[0][1] <= y < r[2][1]):
                want[cover] = want.get(cover, 0) + 1
    cells, _ = overlaid(spark, rings, unit=0.5, size=3.0)
    assert by_cover(cells) == want
    assert all(r.overlap_count == len(r.ids) and r.files == sorted(f"f{k}" for k in r.ids) for r in cells)


@pytest.mark.parametrize("most", [subdivision.MOST, 6])
def test_turned_sheets_equal_clipped_pairs(spark, most, monkeypatch):
    monkeypatch.setattr(subdivision.squares, "__defaults__", (most,))
    monkeypatch.setattr(subdivision.edges, "__defaults__", (most,))
    rnd = random.Random(4)
    rings = [turned(box(-rnd.uniform(0.3, 1), -rnd.uniform(0.3, 1), rnd.uniform(0.3, 1), rnd.uniform(0.3, 1)), rnd.uniform(0, 6), rnd.uniform(0, 3), rnd.uniform(0, 3)) for _ in range(12)]
    corner = turned([(-1, -1), (1, -1), (1, 0), (0, 0), (0, 1), (-1, 1)], 0.4, 1.5, 1.5)
    cells, sides = overlaid(spark, [*rings, corner], size=0.8)
    for k, ring in enumerate([*rings, corner]):
        assert math.isclose(sum(r.area for r in cells if k in r.ids), area(ring), abs_tol=1e-4)
    for (i, a), (j, b) in combinations(enumerate(rings), 2):
        assert math.isclose(sum(r.area for r in cells if {i, j} <= set(r.ids)), abs(area(p)) if (p := clipped(a, b)) else 0, abs_tol=1e-4)
    for r in cells:
        assert set(r.ids) == {k for k, ring in enumerate([*rings, corner]) if inside(ring, r.x, r.y)}
    lines = list({tuple(sorted([(round(s.x1 * 1e6), round(s.y1 * 1e6)), (round(s.x2 * 1e6), round(s.y2 * 1e6))])) for s in sides})
    assert not any(meet(s, t) for s, t in combinations(lines, 2))
    # a cell's sides go round it, and its point is inside
    for r in cells:
        own = [s for s in sides if s.cell == r.cell]
        assert math.isclose(sum(s.x1 * s.y2 - s.x2 * s.y1 for s in own) / 2, r.area, abs_tol=1e-6)
        assert sum((s.y1 <= r.y) != (s.y2 <= r.y) and s.x1 + (r.y - s.y1) / (s.y2 - s.y1) * (s.x2 - s.x1) > r.x for s in own) % 2 == 1
        chains = {s.cycle for s in own}
        for chain in chains:
            walk = sorted((s.at, (s.x1, s.y1), (s.x2, s.y2)) for s in own if s.cycle == chain)
            assert all(a[2] == b[1] for a, b in zip(walk, [*walk[1:], walk[0]]))


def test_islands_are_holes_of_the_cell_they_lie_in(spark):
    rings = [box(0, 0, 20, 20), box(2, 2, 18, 18), turned(box(-1, -1, 1, 1), 0.5, 6, 6), box(9, 5, 12, 8), box(10, 6, 11, 7), box(30, 0, 31, 1), box(12.5, 5, 13, 6)]
    cells, _ = overlaid(spark, rings, size=5.0)
    got = {k: round(v, 3) for k, v in by_cover(cells).items()}
    assert got == {(0,): 144.0, (0, 1): 256 - 4 - 9 - 0.5, (0, 1, 2): 4.0, (0, 1, 3): 8.0, (0, 1, 3, 4): 1.0, (5,): 1.0, (0, 1, 6): 0.5}
    assert all(set(r.ids) == {k for k, ring in enumerate(rings) if inside(ring, r.x, r.y)} for r in cells)


def test_sheets_without_area_and_none(spark):
    assert overlaid(spark, [])[0] == []
    assert overlaid(spark, [[(0, 0), (1, 1)], [(2, 2)]])[0] == []
    cells, _ = overlaid(spark, [box(0, 0, 1, 1), [(0, 0.5), (2, 0.5)], box(5, 5, 5.001, 5.001)], min_area=0.1)
    assert by_cover(cells) == {(0,): 1.0}


def test_crossed_rings_keep_their_area(spark):
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    star = [(math.cos(4 * math.pi * k / 5) + 5, math.sin(4 * math.pi * k / 5)) for k in range(5)]
    there = [(0, 10), (4, 10), (4, 12), (4, 10), (2, 10), (2, 14), (0, 14)]  # runs to (4, 12) and back
    parts, sides = (df.collect() for df in subdivision.repaired(sheets_of(spark, [bow, star, box(0, 0, 1, 1), there]), 1e-6, 1.0))
    of = {k: sorted(round(p.area, 4) for p in parts if p.id == k) for k in range(4)}
    tip = of[1][0]
    assert of[0] == [1.0, 1.0] and of[2] == [1.0] and of[3] == [8.0] and of[1] == [tip] * 5  # the star's middle is gone round twice
    for p in parts:
        own = [s for s in sides if s.part == p.part]
        assert math.isclose(sum(s.x1 * s.y2 - s.x2 * s.y1 for s in own) / 2, p.area, abs_tol=1e-5)


def test_winding_and_interior_points_of_concave_rings(spark):
    rnd, rings = random.Random(8), []
    for k in range(30):
        steps = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(3 + k % 9))
        rings.append([(rnd.uniform(0.2, 1) * math.cos(t), rnd.uniform(0.2, 1) * math.sin(t)) for t in steps])
    comb = [(0, 0), (9, 0), (9, 5), (8, 5), (8, 1), (1, 1), (1, 5), (0, 5)]
    rings.append([(x, y) for x, y in comb])
    df = sheets_of(spark, rings)
    sides = subdivision.ring_segments(df.withColumn("face", F.col("id")), "ring", 1e-4, ["face"])
    got = {r.face: r for r in subdivision.interior_points(sides).collect()}
    assert all(inside(ring, got[k].x * 1e-4, got[k].y * 1e-4) for k, ring in enumerate(rings) if abs(area(ring)) > 0.05)
    at = df.select("id", subdivision.winding(F.col("ring"), F.lit(0.05), F.lit(0.011)).alias("n")).collect()
    assert all((r.n % 2 == 1) == inside(rings[r.id], 0.05, 0.011) for r in at)
