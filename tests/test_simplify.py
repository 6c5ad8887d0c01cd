import math
import random
from itertools import combinations

import pytest

from strandline.operators import rings, simplify
from tests.test_rings import pixels_of

PLANE = (1, 0, 0, 0, 1, 0)


def off(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy) if (dx or dy) else 0
    t = min(1, max(0, t))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def plain(points, tolerance, force=0):
    """Positions kept, by plain recursion."""
    if len(points) < 3:
        return set()
    far = [off(p, points[0][1], points[-1][1]) for _, p in points[1:-1]]
    best = max(far)
    if best <= tolerance and force <= 0:
        return set()
    k = far.index(best) + 1
    return {points[k][0]} | plain(points[: k + 1], tolerance, force - 1) | plain(points[k:], tolerance, force - 1)


def test_lines_equal_plain_recursion(spark):
    rnd, rows, want = random.Random(1), [], set()
    for line in range(12):
        x, y, own = 1000.0 * line, 0.0, []
        for k in range(rnd.randrange(2, 120)):
            own.append((k, (x, y)))
            x, y = x + rnd.random(), y + rnd.gauss(0, 1)
        if line % 3 == 0:
            own.append((len(own), own[0][1]))
        rows += [(line, k, *p) for k, p in own]
        want |= {(line, k) for k in plain(own, 1.5, 2 if line % 3 == 0 else 0)} | {(line, own[0][0]), (line, own[-1][0])}
    points = spark.createDataFrame(rows, "line long, at long, x double, y double")
    got = {(r.line, r["at"]) for r in simplify.simplified_lines(points, 1.5).collect()}
    assert want <= got  # closed lines may cross themselves, and keep more then
    assert {k for k in got if k[0] % 3} == {k for k in want if k[0] % 3}


def meet(s, t):
    """Whether two segments meet elsewhere than at an end of both."""
    side = lambda p, a, b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    on = lambda p, a, b: side(p, a, b) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    ends = set(s) & set(t)
    if any(on(p, *t) for p in s if p not in ends) or any(on(p, *s) for p in t if p not in ends):
        return True
    return not ends and side(s[0], *t) * side(s[1], *t) < 0 and side(t[0], *s) * side(t[1], *s) < 0


def test_spans_that_cross_are_split_further(spark):
    """A line with a notch, and a second line that goes into the notch: without its corners the first would cross the second."""
    a = [(0, 0), (10, 0), (10, 3), (12, 3), (12, 0), (22, 0)]
    b = [(11, -5), (11, 2), (11, -4.5)][:2]
    rows = [(1, k, float(x), float(y)) for k, (x, y) in enumerate(a)] + [(2, k, float(x), float(y)) for k, (x, y) in enumerate(b)]
    got = simplify.simplified_lines(spark.createDataFrame(rows, "line long, at long, x double, y double"), 5.0).collect()
    lines = {k: [(r.x, r.y) for r in sorted(got, key=lambda r: r["at"]) if r.line == k] for k in (1, 2)}
    segments = [s for v in lines.values() for s in zip(v, v[1:])]
    assert len(lines[1]) > 2 and not any(meet(s, t) for s, t in combinations(segments, 2))


def grid_of(n, value):
    return ["".join(str(value(r, c)) for c in range(n)) for r in range(n)]


def segments_of(found):
    return {(r.label, tuple(sorted([(r.col, r.row), (r.col2, r.row2)]))) for r in found}


def test_a_disk_loses_the_staircase(spark):
    grid = grid_of(130, lambda r, c: int(math.hypot(r - 64.5, c - 64.5) < 60))
    points = rings.ring_points(pixels_of(spark, grid))
    raw = rings.measures(rings.placed(points, PLANE), ["label"]).first()
    fine = rings.measures(rings.placed(simplify.simplified_rings(points, 1.0), PLANE), ["label"]).first()
    assert raw.perimeter > 1.25 * 2 * math.pi * 60 and abs(fine.perimeter / (2 * math.pi * 60) - 1) < 0.03
    assert abs(fine.area / raw.area - 1) < 0.03 and fine.n_points < raw.n_points / 4


@pytest.mark.parametrize("kind", ["bands", "random"])
def test_neighbours_go_on_sharing_borders(spark, kind):
    rnd = random.Random(5)
    blocks = [[rnd.randrange(4) for _ in range(8)] for _ in range(8)]
    value = {"bands": lambda r, c: 1 + (c + round(3 * math.sin(r / 5)) > 20) + (r > 25 + c // 4), "random": lambda r, c: blocks[r // 5][c // 5] if rnd.random() < 0.9 else rnd.randrange(4)}[kind]
    grid = grid_of(40, value)
    points = rings.ring_points(pixels_of(spark, grid))
    before = points.collect()
    after = simplify.simplified_rings(points, 1.2).collect()
    # every side of a region borders one other region or the outside, before and after
    count = lambda found: {s: sum(t == s for _, t in found) for _, s in found}
    both = count([(r.label, tuple(sorted([(r.col, r.row), (r.col2, r.row2)]))) for r in after])
    assert set(both.values()) <= {1, 2}
    shared = {(a.label, b.label) for s in (before,) for a in s for b in s if (a.row, a.col, a.row2, a.col2) == (b.row2, b.col2, b.row, b.col)}
    still = {(a.label, b.label) for s in (after,) for a in s for b in s if (a.row, a.col, a.row2, a.col2) == (b.row2, b.col2, b.row, b.col)}
    assert shared == still and len(after) < len(before)
    lines = [((r.col, r.row), (r.col2, r.row2)) for r in {tuple(sorted([(x.col, x.row), (x.col2, x.row2)])): x for x in after}.values()]
    assert not any(meet(s, t) for s, t in combinations(lines, 2))
    # what is dropped is near what stays
    rings_after = {}
    for r in after:
        rings_after.setdefault(r.ring, []).append(((r.col, r.row), (r.col2, r.row2)))
    assert all(min(off((r.col, r.row), *s) for s in rings_after[r.ring]) <= 1.2 + 1e-9 for r in before)


def test_small_rings_stay(spark):
    after = rings.measures(rings.placed(simplify.simplified_rings(rings.ring_points(pixels_of(spark, ["101", "000", "110"])), 10.0), PLANE), ["label"]).first()
    assert after.area == 4.0
    assert simplify.simplified_rings(rings.ring_points(spark.createDataFrame([], "row long, col long, label long")), 1.0).count() == 0
