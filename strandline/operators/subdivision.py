"""Planar subdivisions: what line segments cut the plane into, for all groups of segments at once.

Coordinates are rounded to multiples of a unit. A pixel is a unit's square around such a point; hot pixels hold an end of a
segment or a crossing of two. Every segment is led through the middle of the hot pixels that it passes (snap rounding), so
afterwards edges meet in common ends only. Segments meet each other and the hot pixels in the grid squares they pass; a
square with many segments is cut into quarters.

Every edge is two half-edges. Around a node, half-edges in the order of their angles say which follows which, and the
closed chains of followers (`cycles`) are the faces: those with a positive area are bounded, with the face on the left;
the others are outer contours, which are holes of the face they lie in, if any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.geo import winding
from strandline.operators.cycles import cycles
from strandline.storage import free, stored

MOST = 200  # segments of a square before it is cut into quarters
DEEPEST = 8


def ring_segments(shapes: DataFrame, ring: str, unit: float, keys: list[str]) -> DataFrame:
    """keys, x1, y1, x2, y2 in whole units (doubles): the sides of closed rings (arrays of struct<x, y>)."""
    at = lambda v: F.round(v / unit)
    side = lambda i: F.struct(at(F.col(ring)[i]["x"]).alias("x1"), at(F.col(ring)[i]["y"]).alias("y1"), at(F.col(ring)[i + 1]["x"]).alias("x2"), at(F.col(ring)[i + 1]["y"]).alias("y2"))
    some = shapes.where(F.size(ring) > 1)
    return some.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), side)).alias("s")).select(*keys, "s.*")


def passed(size: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """gx, gy of squares of a size that a segment (px <= qx) passes within a box, a unit around it included."""
    c = F.col
    slope = F.try_divide(c("qy") - c("py"), c("qx") - c("px"))
    y_at = lambda x: F.coalesce(c("py") + slope * (x - c("px")), c("py"))
    cut = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)

    def column(gx: Column) -> Column:
        a, b = cut(gx * size - 1, c("px"), c("qx")), cut((gx + 1) * size + 1, c("px"), c("qx"))
        upright = slope.isNull()
        ya, yb = F.when(upright, c("py")).otherwise(y_at(a)), F.when(upright, c("qy")).otherwise(y_at(b))
        low, high = F.greatest(F.least(ya, yb) - 1, y0), F.least(F.greatest(ya, yb) + 1, y1)
        return F.when(low <= high, F.transform(F.sequence(F.floor(low / size), F.floor(high / size)), lambda gy: F.struct(gx.alias("gx"), gy.alias("gy")))).otherwise(F.array().cast("array<struct<gx: bigint, gy: bigint>>"))

    left, right = F.greatest(c("px") - 1, x0), F.least(c("qx") + 1, x1)
    columns = F.when(left <= right, F.sequence(F.floor(left / size), F.floor(right / size))).otherwise(F.array().cast("array<bigint>"))
    return F.explode(F.flatten(F.transform(columns, column))).alias("g")


def squares(segments: DataFrame, size: float, most: int = MOST) -> DataFrame:
    """segments (grp, seg, px, py, qx, qy) with level, gx, gy of the squares they pass: of side size / 2^level, few segments in each."""
    c, far, out = F.col, F.lit(float("inf")), None
    own = segments.columns
    now = stored(segments.select(*own, F.lit(0).alias("level"), passed(F.lit(float(size)), -far, far, -far, far)).select(*own, "level", "g.gx", "g.gy"))
    while True:
        heavy = stored(now.groupBy("grp", "level", "gx", "gy").agg(F.count(F.lit(1)).alias("n")).where((c("n") > most) & (c("level") < DEEPEST)).drop("n"))
        if heavy.isEmpty():
            return now if out is None else out.unionByName(now)
        light = now.join(heavy, ["grp", "level", "gx", "gy"], "left_anti").select(*now.columns)
        out = light if out is None else out.unionByName(light)
        side = F.lit(float(size)) / F.pow(F.lit(2.0), c("level"))
        box = [c("gx") * side, (c("gx") + 1) * side, c("gy") * side, (c("gy") + 1) * side]
        kids = now.join(heavy, ["grp", "level", "gx", "gy"], "left_semi").select(*now.columns, *[b.alias(n) for b, n in zip(box, ("x0", "x1", "y0", "y1"), strict=True)])
        kids = kids.withColumn("half", F.lit(float(size)) / F.pow(F.lit(2.0), c("level") + 1))
        # the box's far sides belong to its neighbours
        inner = kids.select(*own, "level", passed(c("half"), c("x0"), c("x1") - 0.25, c("y0"), c("y1") - 0.25)).select(*own, (c("level") + 1).alias("level"), "g.gx", "g.gy")
        now = stored(inner)


def edges(segments: DataFrame, size: float, most: int = MOST) -> DataFrame:
    """grp, ux, uy, vx, vy (u before v), k: edges that meet in common ends only, with how many segments (grp, x1, y1, x2, y2, in
    whole units) lie on each."""
    c = F.col
    first = F.struct("x1", "y1") <= F.struct("x2", "y2")
    pick = lambda a, b, name: F.when(first, c(a)).otherwise(c(b)).alias(name)
    ends = segments.where("x1 <> x2 or y1 <> y2").select("grp", pick("x1", "x2", "px"), pick("y1", "y2", "py"), pick("x2", "x1", "qx"), pick("y2", "y1", "qy"))
    once = stored(ends.groupBy("grp", "px", "py", "qx", "qy").agg(F.count(F.lit(1)).alias("k")).withColumn("seg", F.monotonically_increasing_id()))
    dealt = stored(squares(once.drop("k"), size, most))
    square = ["grp", "level", "gx", "gy"]
    a, b = (dealt.select(*square, *[c(x).alias(f"{k}{x}") for x in ("seg", "px", "py", "qx", "qy")]) for k in "ab")
    rx, ry, sx, sy = c("aqx") - c("apx"), c("aqy") - c("apy"), c("bqx") - c("bpx"), c("bqy") - c("bpy")
    wx, wy = c("bpx") - c("apx"), c("bpy") - c("apy")
    d = rx * sy - ry * sx
    t, u = F.try_divide(wx * sy - wy * sx, d), F.try_divide(wx * ry - wy * rx, d)
    boxes = (F.least("apx", "aqx") <= F.greatest("bpx", "bqx")) & (F.least("bpx", "bqx") <= F.greatest("apx", "aqx")) & (F.least("apy", "aqy") <= F.greatest("bpy", "bqy")) & (F.least("bpy", "bqy") <= F.greatest("apy", "aqy"))
    crossings = a.join(b, square).where((c("aseg") < c("bseg")) & boxes & t.between(0, 1) & u.between(0, 1)).select(*square, F.round(c("apx") + t * rx).alias("hx"), F.round(c("apy") + t * ry).alias("hy"))
    tips = dealt.select(*square, F.explode(F.array(F.struct(c("px").alias("hx"), c("py").alias("hy")), F.struct(c("qx").alias("hx"), c("qy").alias("hy")))).alias("h")).select(*square, "h.*")
    side = F.lit(float(size)) / F.pow(F.lit(2.0), c("level"))
    near = c("hx").between(c("gx") * side - 2, (c("gx") + 1) * side + 2) & c("hy").between(c("gy") * side - 2, (c("gy") + 1) * side + 2)
    hot = stored(crossings.unionByName(tips).where(near).distinct())
    dx, dy, ex, ey = c("qx") - c("px"), c("qy") - c("py"), c("hx") - c("px"), c("hy") - c("py")
    inside = (F.abs(dx * ey - dy * ex) <= (F.abs(dx) + F.abs(dy)) / 2) & ex.between(F.least(dx, F.lit(0.0)) - 0.5, F.greatest(dx, F.lit(0.0)) + 0.5) & ey.between(F.least(dy, F.lit(0.0)) - 0.5, F.greatest(dy, F.lit(0.0)) + 0.5)
    through = dealt.join(hot, square).where(inside).select("seg", "hx", "hy", (dx * ex + dy * ey).alias("t")).distinct()
    along = Window.partitionBy("seg").orderBy("t", "hx", "hy")
    pieces = through.select("seg", "hx", "hy", F.lead(F.struct("hx", "hy")).over(along).alias("to")).where("to is not null")
    pieces = pieces.join(once.select("seg", "grp", "k"), "seg").select("grp", "k", F.least(F.struct("hx", "hy"), "to").alias("u"), F.greatest(F.struct("hx", "hy"), "to").alias("v"))
    found = stored(pieces.groupBy("grp", "u", "v").agg(F.sum("k").alias("k")).select("grp", c("u.hx").alias("ux"), c("u.hy").alias("uy"), c("v.hx").alias("vx"), c("v.hy").alias("vy"), "k"))
    free(once, dealt, hot)
    return found


def half_edges(found: DataFrame) -> DataFrame:
    """grp, node, x1, y1, x2, y2, cycle, at: the half-edges of edges (grp, ux, uy, vx, vy) in their chains."""
    c = F.col
    numbered = stored(found.select("grp", "ux", "uy", "vx", "vy", F.monotonically_increasing_id().alias("e")))
    way = lambda k, p, q: F.struct((c("e") * 2 + k).alias("node"), *[c(f"{p}{v}").alias(f"{v}1") for v in "xy"], *[c(f"{q}{v}").alias(f"{v}2") for v in "xy"])
    halves = stored(numbered.select("grp", F.explode(F.array(way(0, "u", "v"), way(1, "v", "u"))).alias("h")).select("grp", "h.*"))
    around = Window.partitionBy("grp", "x1", "y1").orderBy(F.atan2(c("y2") - c("y1"), c("x2") - c("x1")))
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("node").over(around), F.last("node").over(whole))  # the next one clockwise
    order = cycles(halves.select(c("node").bitwiseXOR(F.lit(1).cast("long")).alias("node"), before.alias("next")))
    out = stored(halves.join(order, "node"))
    free(numbered, halves)
    return out


def with_faces(halves: DataFrame) -> DataFrame:
    """halves with face (the least half-edge of a bounded face's outer chain): holes have the face they lie in; other outer contours go.

    From the leftmost corner of each contour, a quarter of a unit higher, the nearest edge to the left shows where it lies: in a
    face, or beside another contour that lies where this one does, or nowhere. Edges meet these points in strips of height."""
    c = F.col
    area = F.sum(c("x1") * (c("y2") - c("y1")) - (c("x2") - c("x1")) * c("y1")) / 2
    chains = stored(halves.groupBy("grp", "cycle").agg(area.alias("area"), F.min(F.struct("x1", "y1")).alias("p"), F.max("y1").alias("top"), F.min("y1").alias("bottom")))
    contours = chains.where("area <= 0").select("grp", "cycle", c("p.x1").alias("x"), (c("p.y1") + 0.25).alias("y"))
    height = chains.agg(F.greatest(F.lit(1.0), F.avg(c("top") - c("bottom")))).first()[0] or 1.0
    down = halves.where("y1 > y2").select("grp", c("cycle").alias("beside"), "x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(c("y2") / height), F.floor(c("y1") / height))).alias("strip"))
    x_at = c("x1") + (c("x2") - c("x1")) * (c("y") - c("y1")) / (c("y2") - c("y1"))
    seen = contours.withColumn("strip", F.floor(c("y") / height)).join(down, ["grp", "strip"]).where((c("y") < c("y1")) & (c("y") > c("y2"))).withColumn("at", x_at).where("at < x")
    lies = seen.groupBy("cycle").agg(F.max_by("beside", "at").alias("in"))
    state = stored(lies.join(chains.select(c("cycle").alias("in"), (c("area") > 0).alias("bounded")), "in").select("cycle", "in", "bounded"))
    tables = [state]
    while not state.where("not bounded").isEmpty():
        on = state.select(c("cycle").alias("in"), c("in").alias("in2"), c("bounded").alias("bounded2"))
        state = stored(state.join(on, "in", "left").where("bounded or in2 is not null").select("cycle", F.when(c("bounded"), c("in")).otherwise(c("in2")).alias("in"), (c("bounded") | c("bounded2")).alias("bounded")))
        tables.append(state)
    faces = chains.where("area > 0").select("cycle", c("cycle").alias("face")).unionByName(state.select("cycle", c("in").alias("face")))
    out = stored(halves.join(faces, "cycle"))
    free(chains, *tables)
    return out


def interior_points(sides: DataFrame, key: str = "face") -> DataFrame:
    """key, x, y, area of areas given by their sides (key, x1, y1, x2, y2, in whole units), holes included: the middle of the widest
    span inside on the line half a unit over the middle height, where no corner lies. Sides and areas meet by a merge: Spark guesses
    from the bytes of what sides were made of that they are few, and would send them all to every task."""
    c = F.col
    area = F.sum(c("x1") * (c("y2") - c("y1")) - (c("x2") - c("x1")) * c("y1")) / 2
    middle = sides.groupBy(key).agg((F.floor((F.min("y1") + F.max("y1")) / 2) + 0.5).alias("y"), F.abs(area).alias("area"))
    x_at = c("x1") + (c("x2") - c("x1")) * (c("y") - c("y1")) / (c("y2") - c("y1"))
    hits = sides.join(middle.hint("merge"), key).where((F.least("y1", "y2") < c("y")) & (F.greatest("y1", "y2") > c("y"))).select(key, "y", "area", x_at.alias("at"))
    along = Window.partitionBy(key).orderBy("at")
    pairs = hits.withColumns({"turn": F.row_number().over(along), "to": F.lead("at").over(along)}).where("turn % 2 = 1 and to is not null")
    return pairs.groupBy(key).agg(F.max_by(F.struct(((c("at") + c("to")) / 2).alias("x"), "y", "area"), F.struct(c("to") - c("at"), -c("at"))).alias("p")).select(key, "p.*")


def rounded(ring: str, unit: float) -> Column:
    return F.transform(ring, lambda p: F.struct(F.round(p["x"] / unit).alias("x"), F.round(p["y"] / unit).alias("y")))


def overlay(sheets: DataFrame, unit: float, size: float, min_area: float = 0.0, ring: str = "ring") -> tuple[DataFrame, DataFrame]:
    """What sheets (id, layer, file, ring: a closed array of struct<x, y>) of any shape cut each other into.

    cells: cell, x, y (a point inside), area, overlap_count, layers, files, by the sheets that cover the cell; those that only touch
    it don't count, sheets that cross themselves cover what they go round an odd number of times, and repeated rows count each.
    sides: cell, cycle, at, x1, y1, x2, y2, in order around the cell, its outer ring first and counter-clockwise. size: side of a
    grid square, about that of a sheet. Cells of at most min_area go. Corners move by half a unit at most for each of the hot
    pixels they share, so areas are good to about a perimeter's length in units."""
    c = F.col
    sheets = stored(sheets.where(c(ring).isNotNull()).select("id", "layer", "file", rounded(ring, unit).alias("ring")))
    lines = ring_segments(sheets.withColumn("grp", F.lit(0).cast("long")), "ring", 1.0, ["grp"])
    halves = half_edges(edges(lines, size / unit))
    sides = with_faces(halves)
    points = stored(interior_points(sides).where(c("area") * unit * unit > min_area))
    grid = lambda v: F.floor(v / (size / unit))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxes = sheets.select("id", "layer", "file", "ring", F.array_min(xs).alias("l"), F.array_max(xs).alias("r"), F.array_min(ys).alias("b"), F.array_max(ys).alias("t"))
    boxes = boxes.withColumn("gx", F.explode(F.sequence(grid(c("l")), grid(c("r"))))).withColumn("gy", F.explode(F.sequence(grid(c("b")), grid(c("t")))))
    near = points.withColumns({"gx": grid(c("x")), "gy": grid(c("y"))}).join(boxes, ["gx", "gy"]).where("l < x and x < r and b < y and y < t")
    over = near.where(F.pmod(winding(c("ring"), c("x"), c("y")), F.lit(2)) == 1)
    cells = over.groupBy("face").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("area").alias("area"), F.count(F.lit(1)).alias("overlap_count"), F.array_sort(F.collect_set("layer")).alias("layers"), F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_list("id")).alias("ids"))
    cells = stored(cells.select(c("face").alias("cell"), (c("x") * unit).alias("x"), (c("y") * unit).alias("y"), (c("area") * unit * unit).alias("area"), "overlap_count", "layers", "files", "ids"))
    kept = sides.join(cells.select(c("cell").alias("face")), "face", "left_semi")
    return cells, kept.select(c("face").alias("cell"), "cycle", "at", *[(c(v) * unit).alias(v) for v in ("x1", "y1", "x2", "y2")])


def repaired(shapes: DataFrame, unit: float, size: float, ring: str = "ring") -> tuple[DataFrame, DataFrame]:
    """Rings that cross themselves, made of simple parts: parts (id, part, x, y, area) of what a ring goes round an odd number of
    times, and their sides (id, part, cycle, at, x1, y1, x2, y2). Sides that a ring runs along twice go. ids are longs, one ring each."""
    c = F.col
    known = stored(shapes.where(c(ring).isNotNull()).select(c("id").cast("long").alias("grp"), rounded(ring, unit).alias("ring")))
    found = edges(ring_segments(known, "ring", 1.0, ["grp"]), size / unit).where("k % 2 = 1")
    sides = with_faces(half_edges(found))
    points = interior_points(sides).join(sides.select("face", "grp").distinct(), "face").join(known, "grp")
    parts = stored(points.where(F.pmod(winding(c("ring"), c("x"), c("y")), F.lit(2)) == 1).select(c("grp").alias("id"), c("face").alias("part"), (c("x") * unit).alias("x"), (c("y") * unit).alias("y"), (c("area") * unit * unit).alias("area")))
    kept = sides.join(parts.select(c("part").alias("face")), "face", "left_semi")
    return parts, kept.select(c("grp").alias("id"), c("face").alias("part"), "cycle", "at", *[(c(v) * unit).alias(v) for v in ("x1", "y1", "x2", "y2")])
