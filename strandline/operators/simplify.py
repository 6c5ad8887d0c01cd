"""Simplification of lines that keeps topology, level by level over all lines at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import rings
from strandline.storage import free, stored


def off(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - x1 - t * dx, y - y1 - t * dy)


def farthest_first(inside: DataFrame, tolerance: float) -> list[DataFrame]:
    """line, at of the points to keep, level by level. inside: line, at, x, y of points between two kept ones, with lo, x1, y1 and
    x2, y2, the position of the one before and both places, and force: how many more levels split whatever the distance is.

    A level is one aggregation by span and one join back: the farthest point of a span, the first of equals, is kept if it is
    over the tolerance, and cuts the span in two."""
    c, kept = F.col, []
    inside = stored(inside)
    while True:
        far = inside.withColumn("off", off(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2")))
        best = far.groupBy("line", "lo").agg(F.max_by(F.struct(c("at").alias("cut"), c("x").alias("xc"), c("y").alias("yc")), F.struct("off", -c("at"))).alias("best"), F.max("off").alias("off"), F.max("force").alias("force"))
        split = stored(best.where((c("off") > tolerance) | (c("force") > 0)).select("line", "lo", "best.*"))
        if split.isEmpty():
            free(inside, split)
            return kept
        kept.append(split.select("line", c("cut").alias("at")))
        after = c("at") > c("cut")
        pick = lambda yes, no, name: F.when(after, c(yes)).otherwise(c(no)).alias(name)
        ends = [pick("cut", "lo", "lo"), pick("xc", "x1", "x1"), pick("yc", "y1", "y1"), pick("x2", "xc", "x2"), pick("y2", "yc", "y2")]
        rest = stored(inside.join(split, ["line", "lo"]).where("at <> cut").select("line", "at", "x", "y", *ends, F.greatest(c("force") - 1, F.lit(0)).alias("force")))
        free(inside)
        inside = rest


def spans(points: DataFrame, kept: DataFrame) -> DataFrame:
    """line, at, x, y, kept, lo, x1, y1, x2, y2: each point with the kept ones around it; for a kept one, itself and the next."""
    c, along = F.col, Window.partitionBy("line").orderBy("at")
    marked = points.join(kept.distinct().withColumn("kept", F.lit(True)), ["line", "at"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    own = F.when(c("kept"), F.struct("at", "x", "y"))
    before = F.last(own, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(own, ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    found = marked.withColumns({"a": before, "b": after})
    return found.select("line", "at", "x", "y", "kept", c("a.at").alias("lo"), c("a.x").alias("x1"), c("a.y").alias("y1"), c("b.x").alias("x2"), c("b.y").alias("y2"))


def crossing(segments: DataFrame, size: float) -> DataFrame:
    """line, lo of segments (line, lo, x1, y1, x2, y2) that meet another one elsewhere than at an end of both. Segments meet in
    the grid squares that their boxes reach."""
    c = F.col
    reach = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    dealt = segments.withColumn("gx", F.explode(reach("x1", "x2"))).withColumn("gy", F.explode(reach("y1", "y2")))
    a, b = (dealt.select("gx", "gy", *[c(x).alias(f"{k}_{x}") for x in ("line", "lo", "x1", "y1", "x2", "y2")]) for k in "ab")
    side = lambda k, of, e: (c(f"{of}_x2") - c(f"{of}_x1")) * (c(f"{k}_y{e}") - c(f"{of}_y1")) - (c(f"{of}_y2") - c(f"{of}_y1")) * (c(f"{k}_x{e}") - c(f"{of}_x1"))
    sign = lambda *s: F.signum(side(*s))
    apart = lambda v: (F.greatest(f"a_{v}1", f"a_{v}2") < F.least(f"b_{v}1", f"b_{v}2")) | (F.greatest(f"b_{v}1", f"b_{v}2") < F.least(f"a_{v}1", f"a_{v}2"))
    touch = ~apart("x") & ~apart("y") & (sign("a", "b", 1) * sign("a", "b", 2) <= 0) & (sign("b", "a", 1) * sign("b", "a", 2) <= 0)
    same = lambda p, q: (c(f"a_x{p}") == c(f"b_x{q}")) & (c(f"a_y{p}") == c(f"b_y{q}"))
    dot = lambda p, q: (c(f"a_x{3 - p}") - c(f"a_x{p}")) * (c(f"b_x{3 - q}") - c(f"b_x{q}")) + (c(f"a_y{3 - p}") - c(f"a_y{p}")) * (c(f"b_y{3 - q}") - c(f"b_y{q}"))
    flat = (sign("a", "b", 1) == 0) & (sign("a", "b", 2) == 0)  # on one line; from a shared end they must go apart
    fine = F.lit(False)
    for p, q in ((1, 1), (1, 2), (2, 1), (2, 2)):
        fine = fine | (same(p, q) & (~flat | (dot(p, q) < 0)))
    first = F.struct("a_line", "a_lo") < F.struct("b_line", "b_lo")
    pairs = a.join(b, ["gx", "gy"]).where(first & touch & ~fine)
    return pairs.select(F.explode(F.array(F.struct(c("a_line").alias("line"), c("a_lo").alias("lo")), F.struct(c("b_line").alias("line"), c("b_lo").alias("lo")))).alias("s")).select("s.*").distinct()


def simplified_lines(points: DataFrame, tolerance: float, size: float | None = None) -> DataFrame:
    """The points (line, at, x, y) that stay: the ends of each line, and what keeps every dropped point within the tolerance of
    the line that is left. A closed line (equal ends) keeps four corners, if it has as many. Lines that meet at most in
    common ends before do so afterwards: spans that cross or touch another are split further until none does."""
    c = F.col
    points = stored(points)
    ends = points.groupBy("line").agg(F.min_by(F.struct("at", "x", "y"), "at").alias("a"), F.max_by(F.struct("at", "x", "y"), "at").alias("b"))
    ends = stored(ends)
    kept = ends.select("line", F.explode(F.array("a.at", "b.at")).alias("at"))
    closed = (c("a.x") == c("b.x")) & (c("a.y") == c("b.y"))
    inside = points.join(ends, "line").where((c("at") > c("a.at")) & (c("at") < c("b.at")))
    inside = inside.select("line", "at", "x", "y", c("a.at").alias("lo"), c("a.x").alias("x1"), c("a.y").alias("y1"), c("b.x").alias("x2"), c("b.y").alias("y2"), F.when(closed, 2).otherwise(0).alias("force"))
    while True:
        for level in farthest_first(inside, tolerance):
            kept = kept.unionByName(level)
        now = stored(spans(points, kept))
        meet = stored(crossing(now.where(c("kept") & c("x2").isNotNull()).select("line", "lo", "x1", "y1", "x2", "y2"), size or max(8.0, 16 * tolerance)))
        forced = stored(now.where(~c("kept")).join(meet, ["line", "lo"], "left_semi").drop("kept").withColumn("force", F.lit(1)))
        if forced.isEmpty():
            return now.where("kept").select("line", "at", "x", "y")
        inside = forced


def simplified_rings(points: DataFrame, tolerance: float, label: str = "label") -> DataFrame:
    """`ring_points` with fewer corners; tolerance in pixels. Rings are cut into arcs where three or more borders meet, and at
    their first corner if there is no such place. Two regions' rings hold a common arc once each way: it is simplified once, and
    both keep the same corners, so neighbours go on sharing their border. Rings keep their meetings, and at least four corners
    where an arc is a whole ring."""
    c = F.col
    points = stored(points.withColumns({"v": rings.corner("row", "col"), "v2": rings.corner("row2", "col2")}))
    meetings = rings.junctions(points.select(c("row").alias("r1"), c("col").alias("c1"), c("row2").alias("r2"), c("col2").alias("c2"))).withColumn("cut", F.lit(1))
    along, ring = Window.partitionBy("ring").orderBy("at"), Window.partitionBy("ring")
    arcs = points.join(meetings, "v", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    arcs = arcs.withColumns({"arc": F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "arcs": F.sum("cut").over(ring), "n": F.count(F.lit(1)).over(ring)})
    wraps = (c("arc") == 0) & (c("arcs") > 0)  # before a ring's first meeting: the end of its last arc
    arcs = arcs.withColumns({"arc": F.when(wraps, c("arcs")).otherwise(c("arc")), "place": F.when(wraps, c("at") + c("n")).otherwise(c("at"))})
    side = F.struct(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b"))
    names = arcs.groupBy("ring", "arc").agg(F.min(side).alias("line"), F.max("place").alias("last"))
    arcs = stored(arcs.join(names, ["ring", "arc"]).select("ring", "arc", "line", "place", "at", "last", "row", "col", "row2", "col2"))
    once = arcs.groupBy("line").agg(F.min(F.struct("ring", "arc")).alias("s")).select("line", "s.*")
    own = arcs.join(once, ["line", "ring", "arc"], "left_semi")
    at = lambda place, row, col: F.struct(place.alias("at"), c(col).cast("double").alias("x"), c(row).cast("double").alias("y"))
    both = F.when(c("place") == c("last"), F.array(at(c("place"), "row", "col"), at(c("place") + 1, "row2", "col2"))).otherwise(F.array(at(c("place"), "row", "col")))
    kept = simplified_lines(own.select("line", F.explode(both).alias("p")).select("line", "p.*"), tolerance)
    kept = stored(kept.select("line", c("y").cast("long").alias("row"), c("x").cast("long").alias("col")).distinct())
    left = arcs.join(kept, ["line", "row", "col"], "left_semi").select("ring", "at").join(points.select(label, "part", "ring", "hole", "at", "row", "col"), ["ring", "at"])
    after = F.coalesce(F.lead(F.struct("row", "col")).over(along), F.first(F.struct("row", "col")).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    numbered = left.withColumns({"next": after, "at": F.row_number().over(along) - 1})
    return numbered.select(label, "part", "ring", "hole", F.col("at").cast("long").alias("at"), "row", "col", c("next.row").alias("row2"), c("next.col").alias("col2"))
