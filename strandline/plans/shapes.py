"""Registered queries of rings, simplification, overlay and exact predicates, and the SQL that checks them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.operators import catalogue, overlap, resample, rings, sheets, simplify, subdivision, warps
from strandline.plans import views
from strandline.plans.registry import AFFINE, NORMAL, W, _labels, _sheets, _with_labels, query, r9

#: Pixel sides of 4-connected parts, each with the next one on its ring, and the rings by their least sides.
WALK = f"""e4 AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1),
reach4(id, r) AS (SELECT id, id FROM p UNION SELECT e4.b, reach4.r FROM reach4 JOIN e4 ON e4.a = reach4.id WHERE reach4.r < e4.b),
px AS (SELECT lab.*, m.part FROM lab JOIN (SELECT id, min(r) AS part FROM reach4 GROUP BY id) m ON m.id = lab.row * {W} + lab.col),
sd AS (SELECT px.label, px.part, d, px.row + r1 AS r1, px.col + c1 AS c1, px.row + r2 AS r2, px.col + c2 AS c2, ((px.row + r1) * {W} + px.col + c1) * 4 + d AS id
  FROM px, (VALUES (0, 0, 0, 0, 1, -1, 0), (1, 0, 1, 1, 1, 0, 1), (2, 1, 1, 1, 0, 1, 0), (3, 1, 0, 0, 0, 0, -1)) AS v(d, r1, c1, r2, c2, dr, dc) WHERE NOT EXISTS (SELECT 1 FROM px o WHERE o.part = px.part AND o.row = px.row + v.dr AND o.col = px.col + v.dc)),
nx AS (SELECT a.id, arg_min(b.id, (b.d - a.d + 5) % 4) AS next, arg_min(b.d, (b.d - a.d + 5) % 4) AS dn FROM sd a JOIN sd b ON a.part = b.part AND a.r2 = b.r1 AND a.c2 = b.c1 GROUP BY a.id),
walk(id, r) AS (SELECT id, id FROM sd UNION SELECT nx.next, walk.r FROM walk JOIN nx ON nx.id = walk.id WHERE walk.r < nx.next),
ring AS (SELECT id, min(r) AS ring FROM walk GROUP BY id)"""


@query(_with_labels(WALK, """SELECT label, part, ring.ring, ring.ring % 4 = 1 AS hole, count(*) FILTER (WHERE dn <> d) AS n_points, abs(sum((30.0 * c1 + 500000) * (-30.0 * r2 + 7400000) - (30.0 * c2 + 500000) * (-30.0 * r1 + 7400000)) / 2)::DOUBLE AS area, (count(*) * 30)::DOUBLE AS perimeter
FROM sd JOIN nx USING (id) JOIN ring USING (id) GROUP BY label, part, ring.ring"""))  # fmt: skip
def lake_rings(spark, sf_dir):
    found = rings.measures(rings.placed(rings.ring_points(_labels(spark, sf_dir)), AFFINE), ["label", "part", "ring", "hole"])
    return found.select("label", "part", "ring", "hole", "n_points", r9("area", digits=3), r9("perimeter", digits=3))


@query(_with_labels(WALK, """SELECT label, count(DISTINCT part) AS n_parts, count(DISTINCT ring.ring) FILTER (WHERE ring.ring % 4 = 1) AS n_holes, count(*) FILTER (WHERE dn <> d) + count(DISTINCT ring.ring) AS n_positions FROM sd JOIN nx USING (id) JOIN ring USING (id) GROUP BY label"""))
def lake_polygons(spark, sf_dir):
    """What the GeoJSON text of each lake's polygons holds, read back from it."""
    found = rings.polygons(rings.placed(rings.ring_points(_labels(spark, sf_dir)), AFFINE))
    feature = F.from_json("feature", "geometry struct<coordinates: array<array<array<array<double>>>>>, properties struct<label: bigint>")
    read = rings.features(found, ["label"]).select(feature.alias("f")).select(F.col("f.properties.label").alias("label"), F.col("f.geometry.coordinates").alias("c"))
    sizes = F.aggregate(F.flatten("c"), F.lit(0).cast("long"), lambda n, r: n + F.size(r))
    return read.select("label", F.size("c").cast("long").alias("n_parts"), (F.size(F.flatten("c")) - F.size("c")).cast("long").alias("n_holes"), sizes.alias("n_positions"))


TOLERANCE = 40.0


@query(f"""WITH RECURSIVE {views.CURVES}, seg(line, lo, hi) AS (SELECT line, min(pos), max(pos) FROM pt GROUP BY line UNION ALL
SELECT line, unnest([lo, cut]), unnest([cut, hi]) FROM (SELECT line, lo, hi, arg_max(pos, struct_pack(v := off, k := -pos)) AS cut, max(off) AS off FROM (
  SELECT line, lo, hi, pos, sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) AS off FROM (SELECT *, least(1, greatest(0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS t FROM (
    SELECT s.line, s.lo, s.hi, p.pos, p.x AS px, p.y AS py, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy
    FROM seg s JOIN pt p ON p.line = s.line AND p.pos > s.lo AND p.pos < s.hi JOIN pt a ON a.line = s.line AND a.pos = s.lo JOIN pt b ON b.line = s.line AND b.pos = s.hi))) GROUP BY line, lo, hi) WHERE off > {TOLERANCE})
SELECT line, pos AS "at" FROM (SELECT line, lo AS pos FROM seg UNION SELECT line, hi FROM seg)""")
def simplified_curves(spark, sf_dir):
    return simplify.simplified_lines(views.curves(spark, sf_dir), TOLERANCE, size=2000.0).select("line", "at")


#: Areas that pairs of sheets share: their pieces are convex, so the outline of what two share is what each one's sides have inside the other.
CLIPPED = f"""{views.TURNED},
pairs AS (SELECT DISTINCT a.k AS ka, a.n AS na, b.k AS kb, b.n AS nb FROM side a JOIN side b ON a.k <> b.k AND abs(a.cx - b.cx) < 2 AND b.cy BETWEEN a.cy - 2 AND a.cy + 2),
cut AS (SELECT a.k AS ka, b.k AS kb, b.n AS nb, a.n AS na, a.i, a.px, a.py, a.qx, a.qy, (b.qx - b.px) * (a.py - b.py) - (b.qy - b.py) * (a.px - b.px) AS n0, (b.qx - b.px) * (a.qy - a.py) - (b.qy - b.py) * (a.qx - a.px) AS n1
  FROM pairs JOIN side a ON a.k = ka AND a.n = na JOIN side b ON b.k = kb AND b.n = nb),
span AS (SELECT ka, kb, na, nb, i, px, py, qx, qy, greatest(0, max(CASE WHEN n1 > 0 THEN -n0 / n1 END)) AS lo, least(1, min(CASE WHEN n1 < 0 THEN -n0 / n1 END)) AS hi, bool_and(n1 <> 0 OR n0 >= 0) AS fine FROM cut GROUP BY ALL),
shares AS (SELECT least(ka, kb) AS ka, greatest(ka, kb) AS kb, sum((px + lo * (qx - px)) * (py + hi * (qy - py)) - (px + hi * (qx - px)) * (py + lo * (qy - py))) / 2 AS area FROM span WHERE fine AND lo < hi GROUP BY 1, 2),
both_ways AS (SELECT ka AS k, area FROM shares UNION ALL SELECT kb, area FROM shares)"""


@query(f"""WITH {CLIPPED}, own AS (SELECT k, sum(px * qy - qx * py) / 2 AS area FROM side GROUP BY k)
SELECT k AS id, round(own.area, 2) AS area, round(coalesce(sum(b.area), 0), 2) AS shared, count(*) FILTER (WHERE b.area > 1e-4) AS n_neighbours FROM own LEFT JOIN both_ways b USING (k) GROUP BY k, own.area""")
def overlay_sheets(spark, sf_dir):
    cells, _ = subdivision.overlay(views.turned_sheets(spark, sf_dir), 1e-7, 0.8)
    c = F.col
    each = cells.select("ids", "area", "overlap_count", F.explode("ids").alias("id"))
    own = each.groupBy("id").agg(F.sum("area").alias("area"), F.sum(c("area") * (c("overlap_count") - 1)).alias("shared"))
    pairs = each.select("id", "area", F.explode("ids").alias("other")).where("id <> other").groupBy("id", "other").agg(F.sum("area").alias("a")).where("a > 1e-4")
    near = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_neighbours"))
    return own.join(near, "id", "left").select("id", r9("area", digits=2), r9("shared", digits=2), F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


@query(f"""WITH {views.CROSSED}, cr AS (SELECT *, x1 - x0 AS rx, y1 - y0 AS ry, x3 - x2 AS sx, y3 - y2 AS sy, x2 - x1 AS ux, y2 - y1 AS uy, x0 - x3 AS vx, y0 - y3 AS vy FROM ordered),
t AS (SELECT *, ((x2 - x0) * sy - (y2 - y0) * sx) / nullif(rx * sy - ry * sx, 0) AS ta, ((x3 - x1) * vy - (y3 - y1) * vx) / nullif(ux * vy - uy * vx, 0) AS tb FROM cr)
SELECT k AS id, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n_parts, round(CASE k % 3 WHEN 0 THEN abs((x2 - x0) * (y3 - y1) - (x3 - x1) * (y2 - y0)) / 2
  WHEN 1 THEN abs((x0 + ta * rx - x0) * (y3 - y0) - (x3 - x0) * (y0 + ta * ry - y0)) / 2 + abs((x0 + ta * rx - x1) * (y2 - y1) - (x2 - x1) * (y0 + ta * ry - y1)) / 2
  ELSE abs((x1 + tb * ux - x0) * (y1 - y0) - (x1 - x0) * (y1 + tb * uy - y0)) / 2 + abs((x1 + tb * ux - x2) * (y3 - y2) - (x3 - x2) * (y1 + tb * uy - y2)) / 2 END, 3) AS area FROM t""")
def rings_repaired(spark, sf_dir):
    parts, _ = subdivision.repaired(views.crossed_sheets(spark, sf_dir), 1e-7, 4.0)
    return parts.groupBy("id").agg(F.count(F.lit(1)).alias("n_parts"), F.round(F.sum("area"), 3).alias("area"))


@query(f"""WITH {views.TURNED}, hull AS (SELECT k, floor((min(round(y * 1e7)) + max(round(y * 1e7))) / 2) + 0.5 AS y FROM corner GROUP BY k),
outer_side AS (SELECT s.* FROM side s WHERE s.k % 4 <> 0 UNION ALL SELECT p.k, 0, i, p.cx, p.cy, x, y, lead(x, 1, x0) OVER w, lead(y, 1, y0) OVER w FROM
  (SELECT k, cx, cy, i, round(cx + cos(t) * a - sin(t) * b, 7) AS x, round(cy + sin(t) * a + cos(t) * b, 7) AS y, first_value(round(cx + cos(t) * a - sin(t) * b, 7)) OVER v AS x0, first_value(round(cy + sin(t) * a + cos(t) * b, 7)) OVER v AS y0
   FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([-w, w, w, 0.0, 0.0, -w]) AS a, unnest([-0.4::DOUBLE, -0.4, 0.0, 0.0, 0.4, 0.4]) AS b FROM sheet WHERE k % 4 = 0) WINDOW v AS (PARTITION BY k ORDER BY i)) p WINDOW w AS (PARTITION BY p.k ORDER BY i)),
hit AS (SELECT k, hull.y, round(px * 1e7) + (round(qx * 1e7) - round(px * 1e7)) * (hull.y - round(py * 1e7)) / (round(qy * 1e7) - round(py * 1e7)) AS x FROM outer_side JOIN hull USING (k) WHERE least(round(py * 1e7), round(qy * 1e7)) < hull.y AND greatest(round(py * 1e7), round(qy * 1e7)) > hull.y),
pair AS (SELECT k, y, x, lead(x) OVER w AS x2, row_number() OVER w AS n FROM hit WINDOW w AS (PARTITION BY k ORDER BY x))
SELECT k AS id, round(arg_max((x + x2) / 2, struct_pack(w := x2 - x, l := -x)) / 1e7, 5) AS x, round(any_value(y) / 1e7, 5) AS y FROM pair WHERE n % 2 = 1 AND x2 IS NOT NULL GROUP BY k""")
def interior_points(spark, sf_dir):
    found = subdivision.interior_points(subdivision.ring_segments(views.turned_sheets(spark, sf_dir), "ring", 1e-7, ["id"]), "id")
    return found.select("id", r9("x", F.col("x") * 1e-7, digits=5), r9("y", F.col("y") * 1e-7, digits=5))


VIEWPORT = (10.1, 0.9, 14.3, 2.2)
@query(f"""WITH {views.TURNED}, b(x, y) AS (VALUES ({VIEWPORT[0]}::DOUBLE, {VIEWPORT[1]}::DOUBLE), ({VIEWPORT[2]}, {VIEWPORT[1]}), ({VIEWPORT[2]}, {VIEWPORT[3]}), ({VIEWPORT[0]}, {VIEWPORT[3]})),
ext AS (SELECT k, n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM corner GROUP BY k, n),
apart AS (SELECT s.k, s.n, bool_or(far < 0) AS apart FROM (SELECT s.k, s.n, s.i, max((s.qx - s.px) * (b.y - s.py) - (s.qy - s.py) * (b.x - s.px)) AS far FROM side s, b GROUP BY ALL) s GROUP BY s.k, s.n),
met AS (SELECT k, bool_or(x0 <= {VIEWPORT[2]} AND x1 >= {VIEWPORT[0]} AND y0 <= {VIEWPORT[3]} AND y1 >= {VIEWPORT[1]} AND NOT apart) AS exact FROM ext JOIN apart USING (k, n) GROUP BY k),
box AS (SELECT k, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM ext GROUP BY k)
SELECT k AS id, exact FROM box JOIN met USING (k) WHERE x0 <= {VIEWPORT[2]} AND x1 >= {VIEWPORT[0]} AND y0 <= {VIEWPORT[3]} AND y1 >= {VIEWPORT[1]}""")
def footprints_exact(spark, sf_dir):
    """Sheets whose boxes meet a viewport, and whether they do themselves."""
    sheets = views.turned_sheets(spark, sf_dir)
    x0, y0, x1, y1 = catalogue.ring_bounds(F.col("ring"))
    boxed = sheets.withColumns({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1})
    return boxed.where(catalogue.overlaps(*VIEWPORT)).select("id", catalogue.meets_exactly(*VIEWPORT).alias("exact"))


@query(f"""WITH {CLIPPED} SELECT ka AS left_id, kb AS right_id FROM shares WHERE area > 1e-9""")
def sheets_that_meet(spark, sf_dir):
    """Pairs of sheets that overlap; the corners of these sheets lie on no other sheet's side."""
    sheets = views.turned_sheets(spark, sf_dir).select("id", "ring")
    return overlap.ring_join(sheets, sheets).where("left_id < right_id")


@query(f"""WITH {NORMAL}, mc AS (SELECT map_file, corner, 6378137 * radians(px) AS x, 6378137 * ln(tan(pi() / 4 + radians(py) / 2)) AS y FROM pt)
SELECT a.map_file, round(abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2e6, 1) AS area_km2 FROM mc a JOIN mc b ON a.map_file = b.map_file AND a.corner = 1 AND b.corner = 2 JOIN mc c ON a.map_file = c.map_file AND c.corner = 3""")
def overlay_footprints(spark, sf_dir):
    """What each normalised sheet covers, added up over the cells that all sheets cut each other into."""
    found = catalogue.normalised_footprints(_sheets(spark, sf_dir))
    sheets = found.select(F.col("map_file").alias("id"), F.col("datum_status").alias("layer"), F.col("map_file").alias("file"), geo.ring_mercator(F.col("ring")).alias("ring"))
    cells, _ = subdivision.overlay(sheets, 1e-3, 100_000.0)
    return cells.select("area", F.explode("ids").alias("map_file")).groupBy("map_file").agg(F.round(F.sum("area") / 1e6, 1).alias("area_km2"))


GCP_SQL = """gcp AS (SELECT l_suppkey AS sheet, (l_partkey % 997)::DOUBLE AS x, (l_orderkey % 499)::DOUBLE AS y, 64 + l_partkey % 997 * 0.001::DOUBLE + l_orderkey % 499 * 0.0002::DOUBLE + l_quantity * 1e-5::DOUBLE AS lon, 66 - l_orderkey % 499 * 0.0005::DOUBLE + l_partkey % 997 * 0.0001::DOUBLE + l_tax * 1e-3::DOUBLE AS lat FROM lineitem),
ms AS (SELECT sheet, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(lon) AS mo, avg(lat) AS ma, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, lon) AS xo, covar_pop(y, lon) AS yo, covar_pop(x, lat) AS xa, covar_pop(y, lat) AS ya FROM gcp GROUP BY sheet),
ft AS (SELECT *, (xo * yy - yo * xy) / (xx * yy - xy * xy) AS ox, (yo * xx - xo * xy) / (xx * yy - xy * xy) AS oy, (xa * yy - ya * xy) / (xx * yy - xy * xy) AS ax, (ya * xx - xa * xy) / (xx * yy - xy * xy) AS ay FROM ms)"""


def _gcps(spark, sf_dir):
    c = F.col
    x, y = (c("l_partkey") % 997).cast("double"), (c("l_orderkey") % 499).cast("double")
    return views.table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("sheet"), x.alias("x"), y.alias("y"), (64 + x * 0.001 + y * 0.0002 + c("l_quantity") * 1e-5).alias("lon"), (66 - y * 0.0005 + x * 0.0001 + c("l_tax") * 1e-3).alias("lat"))


@query(f"""WITH {GCP_SQL} SELECT sheet, any_value(n) AS n, round(any_value(ox), 9) AS lon_x, round(any_value(oy), 9) AS lon_y, round(any_value(mo - ox * mx - oy * my), 6) AS lon_0, round(any_value(ax), 9) AS lat_x, round(any_value(ay), 9) AS lat_y, round(any_value(ma - ax * mx - ay * my), 6) AS lat_0,
round(sqrt(avg((lon - mo - ox * (x - mx) - oy * (y - my)) ** 2 + (lat - ma - ax * (x - mx) - ay * (y - my)) ** 2)), 8) AS rms FROM gcp JOIN ft USING (sheet) GROUP BY sheet""")
def gcp_fit(spark, sf_dir):
    points = _gcps(spark, sf_dir)
    fits = warps.affine_fit(points, ["sheet"])
    report = warps.fit_report(warps.affine_residuals(points, fits, ["sheet"]), ["sheet"]).drop("n")
    return fits.join(report, "sheet").select("sheet", "n", *[r9(v, digits=6 if v.endswith("0") else 9) for t in warps.TARGETS for v in (f"{t}_x", f"{t}_y", f"{t}_0")], r9("rms", digits=8))


def _polar_sql(lon: str, lat: str) -> tuple[str, str]:
    """x and y on the polar plane, as SQL."""
    a, e = geo._eccentricity()
    at = math.radians(70.0)
    t = math.tan(math.pi / 4 - at / 2) / ((1 - e * math.sin(at)) / (1 + e * math.sin(at))) ** (e / 2)
    d = lambda v: f"({v!r}::DOUBLE)"
    rho = f"({d(a * math.cos(at) / math.sqrt(1 - (e * math.sin(at)) ** 2) / t)} * tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {d(e)} * sin(radians({lat}))) / (1 + {d(e)} * sin(radians({lat}))), {d(e / 2)}))"
    return f"{rho} * sin(radians({lon} + 45))", f"-{rho} * cos(radians({lon} + 45))"


_x, _y = _polar_sql("lon", "lat")


@query(f"""WITH {views.FOOTPRINT}, ts AS (SELECT k / 22.0::DOUBLE AS t FROM range(0, 23) AS r(k)), eg AS (SELECT id, xmin + (xmax - xmin) * t AS lon, unnest([ymin, ymax]) AS lat FROM footprint, ts UNION ALL SELECT id, unnest([xmin, xmax]), ymin + (ymax - ymin) * t FROM footprint, ts),
pl AS (SELECT id, {_x} AS x, {_y} AS y FROM eg) SELECT id, round(min(x), 3) AS x0, round(min(y), 3) AS y0, round(max(x), 3) AS x1, round(max(y), 3) AS y1 FROM pl GROUP BY id""")
def polar_bounds(spark, sf_dir):
    c = F.col
    box = geo.densified_box(c("xmin"), c("ymin"), c("xmax"), c("ymax"), geo.polar).alias("box")
    found = views.spread(views.footprints(spark, sf_dir)).select("id", box)
    return found.select("id", *[F.round(f"box.{n}", 3).alias(n) for n in ("x0", "y0", "x1", "y1")])


@query(f"""WITH {views.SCENE_PX}, src AS (SELECT row, col, avg(green) AS green FROM scene_px GROUP BY row, col), ht AS (SELECT max(row) + 1 AS h FROM src),
tg AS (SELECT r AS row, c AS col, (r + 0.5::DOUBLE) * 0.8::DOUBLE - 0.5 AS ar, (c + 0.5::DOUBLE) * 0.8::DOUBLE - 0.5 AS ac FROM ht, range(0, (h * 10 // 8)::BIGINT) AS a(r), range(0, 10) AS b(c)),
cn AS (SELECT row, col, floor(ar) + i AS sr, floor(ac) + j AS sc, (CASE i WHEN 1 THEN ar - floor(ar) ELSE 1 - (ar - floor(ar)) END) * (CASE j WHEN 1 THEN ac - floor(ac) ELSE 1 - (ac - floor(ac)) END) AS w FROM tg, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(i, j))
SELECT cn.row, cn.col, round(sum(w * green) / nullif(sum(CASE WHEN green IS NOT NULL THEN w END), 0), 6) AS green FROM cn LEFT JOIN src ON src.row = sr AND src.col = sc GROUP BY cn.row, cn.col""")
def resampled_composite(spark, sf_dir):
    """The mean of all scenes on a grid of pixels four fifths as wide."""
    source = views.scene_px(spark, sf_dir).groupBy("row", "col").agg(F.avg("green").alias("green"))
    height = F.floor((F.max("row") + 1) * 10 / 8).alias("h")
    rows = source.agg(height).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("row"))
    targets = rows.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("col"))
    at = lambda v: (F.col(v) + 0.5) * 0.8 - 0.5
    return resample.resampled(source, targets.select("row", "col", at("row").alias("at_row"), at("col").alias("at_col")), ["green"]).select("row", "col", r9("green", digits=6))


@query("""WITH sh AS (SELECT s_suppkey AS sheet, 7800000.37::DOUBLE + s_suppkey % 50 * 1000 AS x0, 9900000.41::DOUBLE - s_suppkey // 50 * 1000 AS y0 FROM supplier),
bx AS (SELECT *, floor(-y0 / 7)::BIGINT - 5 AS r0, floor(x0 / 7)::BIGINT - 5 AS c0 FROM sh), gr AS (SELECT sheet, r0 + i AS row, c0 + j AS col, x0, y0 FROM bx, range(0, 60) AS a(i), range(0, 50) AS b(j)),
pl AS (SELECT sheet, row, col, (10 * ((col + 0.5::DOUBLE) * 7 - x0) + 2 * (-(row + 0.5::DOUBLE) * 7 - y0)) / 102 AS x, (((col + 0.5::DOUBLE) * 7 - x0) - 10 * (-(row + 0.5::DOUBLE) * 7 - y0)) / 102 AS y FROM gr),
px AS (SELECT l_suppkey AS sheet, l_orderkey % 24 AS row, l_partkey % 16 AS col, max(l_linenumber)::BIGINT AS v FROM lineitem GROUP BY ALL)
SELECT pl.sheet, pl.row, pl.col, px.v, CASE WHEN px.v IS NULL THEN 0 ELSE 255 END AS alpha FROM pl LEFT JOIN px ON px.sheet = pl.sheet AND px.row = floor(y) AND px.col = floor(x) WHERE x > 0 AND x < 16 AND y > 0 AND y < 24""")
def sheets_warped(spark, sf_dir):
    """A scan of 16 by 24 pixels for each supplier, turned a little, on a grid of 7 metres of the Mercator plane."""
    c = F.col
    lines, suppliers = views.table(spark, sf_dir, "lineitem"), views.table(spark, sf_dir, "supplier")
    pixels = lines.groupBy(c("l_suppkey").alias("sheet"), (c("l_orderkey") % 24).alias("row"), (c("l_partkey") % 16).alias("col")).agg(F.max("l_linenumber").cast("long").alias("v"))
    x0, y0 = c("s_suppkey") % 50 * 1000 + 7800000.37, 9900000.41 - F.floor(c("s_suppkey") / 50) * 1000

    def place(x, y):
        lon, lat = geo.mercator_to_lonlat(x0 + 10.0 * x + 2.0 * y, y0 - 10.0 * y + 1.0 * x)
        return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), lon.alias("lon"), lat.alias("lat"))

    points = suppliers.select(c("s_suppkey").alias("sheet"), F.explode(F.array(*[place(*p) for p in ((0, 0), (16, 0), (0, 24), (16, 24), (8, 12))])).alias("p")).select("sheet", "p.*")
    ring = F.transform(F.array(*[place(*p) for p in ((0, 0), (0, 24), (16, 24), (16, 0), (0, 0))]), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return sheets.warp(pixels, points, suppliers.select(c("s_suppkey").alias("sheet"), ring.alias("ring")), ["sheet"], ["v"], 7.0)
