import json
import random

from strandline.operators import regions, rings
from strandline.operators.cycles import cycles


def pixels_of(spark, grid):
    """Rows of digits: 0 is outside, other digits are labels."""
    return spark.createDataFrame([(r, c, int(x)) for r, line in enumerate(grid) for c, x in enumerate(line) if x != "0"], "row long, col long, label long")


def plain_rings(grid):
    """Rings walked one side after the other; {(label, hole, area, corners)} as a sorted list."""
    at = {(r, c): int(x) for r, line in enumerate(grid) for c, x in enumerate(line) if x != "0"}
    part = {}
    for p in sorted(at):
        if p not in part:
            todo = [p]
            part[p] = p
            while todo:
                r, c = todo.pop()
                for q in ((r, c + 1), (r + 1, c), (r, c - 1), (r - 1, c)):
                    if at.get(q) == at[r, c] and q not in part:
                        part[q] = p
                        todo.append(q)
    out, steps = {}, ((0, 1), (1, 0), (0, -1), (-1, 0))
    for (r, c), p in part.items():
        for d, (start, near) in enumerate((((r, c), (r - 1, c)), ((r, c + 1), (r, c + 1)), ((r + 1, c + 1), (r + 1, c)), ((r + 1, c), (r, c - 1)))):
            if part.get(near) != p:
                out.setdefault((p, start), set()).add(d)
    left = {(p, v, d) for (p, v), ds in out.items() for d in ds}
    degree, found = {}, []
    for side in {frozenset((v, (v[0] + steps[d][0], v[1] + steps[d][1]))) for _, v, d in left}:
        for v in side:
            degree[v] = degree.get(v, 0) + 1
    while left:
        first = min(left)
        p, v, d = first
        walk = []
        while True:
            left.discard((p, v, d))
            walk.append((v, d))
            v = (v[0] + steps[d][0], v[1] + steps[d][1])
            d = next(x for x in ((d + 3) % 4, d, (d + 1) % 4) if x in out[p, v])
            if (p, v, d) == first:
                break
        area = sum(v[1] * steps[d][0] - v[0] * steps[d][1] for v, d in walk) / 2
        corners = [v for k, (v, d) in enumerate(walk) if walk[k - 1][1] != d or degree[v] > 2]
        found.append((at[p], area < 0, abs(area), len(corners), len(walk)))
    return sorted(found)


GRIDS = {
    "one": ["1"],
    "hole": ["1111", "1001", "1111"],
    "diagonal": ["100", "010", "001"],
    "pinched hole": ["1110", "1011", "1101", "0111"],
    "island in a hole": ["11111", "10001", "10101", "10001", "11111"],
    "neighbours": ["1122", "1122", "3322", "3300"],
    "checkers": ["10101", "01010", "10101"],
    "value in a hole": ["1111", "1221", "1121", "1111"],
}


def test_rings_equal_a_plain_walk(spark):
    """All cases and a random one, on one raster with free pixels between them."""
    rnd = random.Random(7)
    cases = [*GRIDS.values(), ["".join(rnd.choice("01112") for _ in range(30)) for _ in range(24)]]
    grid = [line for case in cases for line in [*(x.ljust(30, "0") for x in case), "0" * 30]]
    points = rings.placed(rings.ring_points(pixels_of(spark, grid)), (1, 0, 0, 0, 1, 0))
    got = sorted((r.label, r.hole, r.area, r.n_points, round(r.perimeter)) for r in rings.measures(points, ["label", "part", "ring", "hole"]).collect())
    assert got == plain_rings(grid)


def test_rings_cross_tile_seams_and_equal_area_perimeter(spark):
    """A ring of water around a tile corner, with an island that is a lake of its own."""
    far = lambda r, c: max(abs(r - 255.5), abs(c - 255.5))
    rows = [(r, c) for r in range(230, 282) for c in range(230, 282) if 10 < far(r, c) < 24 or far(r, c) < 4]
    labels = regions.label_regions(spark.createDataFrame(rows, "row long, col long"))
    got = {r.label: (r.area, r.perimeter, r.n_holes) for r in rings.measures(rings.placed(rings.ring_points(labels), (30, 0, 5, 0, -30, 9)), ["label"]).collect()}
    want = {r.label: (r.area, r.perimeter) for r in regions.area_perimeter(labels, affine=(30, 0, 5, 0, -30, 9)).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and sorted(v[2] for v in got.values()) == [0, 1]


def test_polygons_are_closed_and_become_features(spark):
    points = rings.placed(rings.ring_points(pixels_of(spark, GRIDS["island in a hole"])), (1, 0, 0, 0, 1, 0))
    found = rings.polygons(points)
    (row,) = found.collect()
    assert [[len(ring) for ring in part] for part in row.polygons] == [[5, 5], [5]]
    assert all(ring[0] == ring[-1] for part in row.polygons for ring in part)
    feature = json.loads(rings.features(found, ["label"]).first().feature)
    assert feature["geometry"]["type"] == "MultiPolygon" and feature["geometry"]["coordinates"][1] == [[[2, 2], [3, 2], [3, 3], [2, 3], [2, 2]]] and feature["properties"] == {"label": 1}


def test_no_pixels_no_rings(spark):
    assert rings.ring_points(spark.createDataFrame([], "row long, col long, label long")).count() == 0


def test_cycles_of_many_lengths(spark):
    rnd, rows, want = random.Random(2), [], {}
    names = rnd.sample(range(10**6), 700)
    for n in (1, 2, 3, 7, 8, 64, 100, 257):
        own, names = names[:n], names[n:]
        rows += [(own[k], own[(k + 1) % n]) for k in range(n)]
        low = own.index(min(own))
        want |= {own[k]: (min(own), (k - low) % n, n) for k in range(n)}
    got = {r.node: (r.cycle, r["at"], r.length) for r in cycles(spark.createDataFrame(rows, "node long, next long")).collect()}
    assert got == want


def test_rings_of_parts_inside_and_across_tiles(spark):
    """Tiles of any size give the same rows; touching values, so that other parts' borders cut runs."""
    rnd = random.Random(11)
    grid = ["".join(rnd.choice("00111222") for _ in range(23)) for _ in range(26)]
    pixels = pixels_of(spark, grid)
    whole = sorted(map(tuple, rings.ring_points(pixels).collect()))
    points = rings.placed(rings.ring_points(pixels, tile=8), (1, 0, 0, 0, 1, 0))
    assert sorted((r.label, r.hole, r.area, r.n_points, round(r.perimeter)) for r in rings.measures(points, ["label", "part", "ring", "hole"]).collect()) == plain_rings(grid)
    for tile in (3, 5, 9):
        assert sorted(map(tuple, rings.ring_points(pixels, tile=tile).collect())) == whole


def test_only_parts_at_tile_edges_take_part_in_joins(spark, monkeypatch):
    grid = ["0" * 40] * 12 + ["000011100000" + "0" * 28] * 3 + ["0" * 40] * 3
    joined, real = [], regions.sides
    monkeypatch.setattr(regions, "sides", lambda pixels, keys, *a: joined.append(pixels.count()) or real(pixels, keys, *a))
    rings.ring_points(pixels_of(spark, grid)).collect()
    assert joined == [0]
    rings.ring_points(pixels_of(spark, grid), tile=5).collect()
    assert joined == [0, 9]


def test_points_are_dealt_once_to_become_polygons(spark):
    rnd = random.Random(4)
    points = rings.placed(rings.ring_points(pixels_of(spark, ["".join(rnd.choice("0112") for _ in range(12)) for _ in range(12)])), (1, 0, 0, 0, 1, 0))
    rows = spark.createDataFrame(points.collect(), points.schema)
    found = rings.polygons(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    for row in found.collect():
        of = [r for r in rows.collect() if r.label == row.label]
        want = [[[(p.x, p.y) for p in sorted((p for p in of if p.ring == k), key=lambda p: p["at"])] for _, k in sorted({(p.hole, p.ring) for p in of if p.part == part})] for part in sorted({p.part for p in of})]
        assert [[[tuple(p) for p in ring] for ring in part] for part in row.polygons] == [[[*ring, ring[0]] for ring in part] for part in want]
