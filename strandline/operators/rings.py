"""Rings of labelled pixels: traced, put into polygons, simplified along shared borders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import regions, tiles
from strandline.operators.cycles import cycles
from strandline.storage import free, stored

CORNERS = 1 << 31  # corner number = row * CORNERS + col; rows stay under 2^29


def corner(row: str, col: str) -> Column:
    return F.col(row).cast("long") * CORNERS + F.col(col)


def junctions(sides: DataFrame) -> DataFrame:
    """v: corners where three or more borders meet, whoever's they are."""
    ends = sides.select(F.least(corner("r1", "c1"), corner("r2", "c2")).alias("a"), F.greatest(corner("r1", "c1"), corner("r2", "c2")).alias("b")).distinct()
    return ends.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("v")


#: What rows of `traced` are: points of rings, pixels of parts that reach their tile's edge, sides of other parts beside these.
RING, PIXEL, SIDE = range(3)


def traced(pixels: DataFrame, tile: int) -> DataFrame:
    """kind, value, part, ring, at, row, col, row2, col2, of pixels (row, col, value): the rings of all parts inside their tile, and of the
    other parts the pixels and what is beside them."""

    def work(rows: tiles.Arrays) -> tiles.Arrays:
        p = tiles.ordered(rows, tile)
        near = tiles.neighbours(p, tile, (*tiles.BEYOND, *tiles.LEFT))
        root, seam = tiles.tile_parts(p, near, tile, False, p["value"])
        found = tiles.rings_inside(p, near, root, ~seam)
        beside = ~seam & np.any([(to >= 0) & seam[to] for to in near.values()], axis=0)
        at, turn = tiles.free_sides(near, root, np.flatnonzero(beside))
        out, kinds = np.flatnonzero(seam), (len(found["at"]), int(seam.sum()), len(at))
        start, end = tiles.START[turn], tiles.START[(turn + 1) % 4]
        sides = {"row": p["row"][at] + start[:, 0], "col": p["col"][at] + start[:, 1], "row2": p["row"][at] + end[:, 0], "col2": p["col"][at] + end[:, 1]}
        pixel = {"row": p["row"][out], "col": p["col"][out]}
        of = {n: np.concatenate([found[n], *(v.get(n, np.zeros(k, np.int64)) for v, k in ((pixel, kinds[1]), (sides, kinds[2])))]) for n in ("ring", "at", "row", "col", "row2", "col2")}
        first = np.concatenate([found["first"], root[out], root[at]])
        return of | {"kind": np.repeat(np.arange(3, dtype=np.int32), kinds), "value": p["value"][first], "part": p["row"][first] * tiles.WIDTH + p["col"][first]}

    return tiles.by_tiles(pixels, tile, work, "kind int, " + ", ".join(f"{n} long" for n in ("value", "part", "ring", "at", "row", "col", "row2", "col2")))


def ring_points(labels: DataFrame, label: str = "label", tile: int = regions.TILE) -> DataFrame:
    """label, part, ring, hole, at, row, col, row2, col2: the corners of each region's rings in order, each with the next one.
    labels: row, col, label (long), one for each pixel; regions may touch.

    A part is a 4-connected piece of a region and has one outer ring; part is its least pixel number. Straight runs of sides
    become one row, cut only where three or more borders meet. At a corner that a part touches twice the ring turns left,
    which keeps holes and shells apart; so no ring meets itself. Outer rings run clockwise as seen with rows downwards, and
    begin at their least corner to the east; holes the other way, to the south.

    Parts inside a tile are traced there; only sides of parts that reach a tile's edge take part in the distributed steps."""
    c = F.col
    out = [c("value").alias(label), "part", "ring", (c("ring") % 4 == 1).alias("hole"), "at", "row", "col", "row2", "col2"]
    found = stored(traced(labels.select(c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), c(label).cast("long").alias("value")), tile))
    parts = regions.across_seams(found.where(c("kind") == PIXEL).select("row", "col", "value", "part"), 4, tile, ["value"])
    beside = found.where(c("kind") == SIDE).select(c("row").alias("r1"), c("col").alias("c1"), c("row2").alias("r2"), c("col2").alias("c2"))
    return found.where(c("kind") == RING).select(*out).unionByName(_across(parts, beside).select(*out))


def _across(parts: DataFrame, beside: DataFrame) -> DataFrame:
    """value, part, ring, at, row, col, row2, col2 of whole parts (row, col, value, part), by joins; beside: other parts' sides at their corners."""
    c = F.col
    sides = stored(regions.sides(parts, ["value", "part"]))
    met = junctions(sides.select("r1", "c1", "r2", "c2").unionByName(beside))
    forward = F.when(c("turn") < 2, 1).otherwise(-1)
    step = forward * F.when(c("turn") % 2 == 0, c("c1")).otherwise(c("r1"))
    marked = sides.withColumns({"line": F.when(c("turn") % 2 == 0, c("r1")).otherwise(c("c1")), "step": step, "v": corner("r1", "c1")}).join(met.withColumn("cut", F.lit(True)).hint("merge"), "v", "left")
    along = Window.partitionBy("part", "turn", "line").orderBy("step")
    new = F.coalesce(c("cut"), F.lag("step").over(along) != c("step") - 1, F.lit(False)).cast("int")
    runs = marked.withColumn("new", new).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first, last = F.min_by(F.struct("r1", "c1"), "step").alias("p"), F.max_by(F.struct("r2", "c2"), "step").alias("q")
    runs = runs.groupBy("value", "part", "turn", "line", "run").agg(first, last).select("value", "part", "turn", "p.*", "q.*")
    runs = stored(runs.withColumn("node", corner("r1", "c1") * 4 + c("turn")))
    free(sides)
    ahead = runs.select(c("part").alias("part2"), c("turn").alias("turn2"), corner("r1", "c1").alias("v2"), c("node").alias("next"))
    left_first = F.pmod(c("turn2") - c("turn") + 1, F.lit(4))  # left, straight on, right
    links = runs.join(ahead.hint("merge"), (c("part") == c("part2")) & (corner("r2", "c2") == c("v2"))).groupBy("node").agg(F.min_by("next", left_first).alias("next"))
    order = cycles(links)
    return runs.join(order.hint("merge"), "node").select("value", "part", c("cycle").alias("ring"), "at", c("r1").alias("row"), c("c1").alias("col"), c("r2").alias("row2"), c("c2").alias("col2"))


def placed(points: DataFrame, affine: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Adds x, y, x2, y2 on the affine's plane."""
    a, b, c, d, e, f = map(float, affine)
    at = lambda row, col: (a * F.col(col) + b * F.col(row) + c, d * F.col(col) + e * F.col(row) + f)
    (x, y), (x2, y2) = at("row", "col"), at("row2", "col2")
    return points.withColumns({"x": x, "y": y, "x2": x2, "y2": y2})


def measures(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, area (holes taken off), perimeter, n_points, n_shells, n_holes of placed points."""
    c = F.col
    cross = F.sum(c("x") * c("y2") - c("x2") * c("y")) / 2
    length = F.sum(F.hypot(c("x2") - c("x"), c("y2") - c("y")))
    shells, holes = F.count_if((c("at") == 0) & ~c("hole")), F.count_if((c("at") == 0) & c("hole"))
    return points.groupBy(*keys).agg(F.abs(cross).alias("area"), length.alias("perimeter"), F.count(F.lit(1)).alias("n_points"), shells.alias("n_shells"), holes.alias("n_holes"))


def polygons(points: DataFrame, label: str = "label") -> DataFrame:
    """label, polygons: for each part its outer ring, then its holes, as closed arrays of (x, y). A region is one row here, as
    formats of polygons want it; `ring_points` has no such rows. Points are dealt by label once, and all three steps find them there."""
    point = F.struct(F.col("at").alias("at"), F.struct("x", "y").alias("p"))
    ring = points.select(label, "part", "hole", "ring", "at", "x", "y").repartition(label).groupBy(label, "part", "hole", "ring").agg(F.transform(F.array_sort(F.collect_list(point)), lambda s: s["p"]).alias("r"))
    closed = ring.withColumn("r", F.concat("r", F.slice("r", 1, 1)))
    part = closed.groupBy(label, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", "r"))), lambda s: s["r"]).alias("rings"))
    return part.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda s: s["rings"]).alias("polygons"))


def features(polygons: DataFrame, properties: list[str], column: str = "polygons") -> DataFrame:
    """One GeoJSON feature a row, as text, of several polygons each."""
    at = F.transform(column, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), at.alias("coordinates"))
    return polygons.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
