"""Spatial joins and overlap cells of axis-parallel footprints (id, xmin, ymin, xmax, ymax)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geo, text
from strandline.operators.graph import components
from strandline.storage import stored


def set_columns(footprints: DataFrame) -> list[Column]:
    """Sorted distinct layers and files, and with a column `year` the lines that a map shows, of the footprints in a group."""
    lines = [F.array_sort(F.array_remove(F.collect_set("line"), "")).alias("lines")] if "year" in footprints.columns else []
    return [F.array_sort(F.collect_set("layer")).alias("layers"), F.array_sort(F.collect_set("file")).alias("files"), *lines]


def with_line(footprints: DataFrame) -> DataFrame:
    return footprints.withColumn("line", text.hover_line(F.col("layer"), F.col("year"), F.col("file"))) if "year" in footprints.columns else footprints


def _cells(size: float) -> Column:
    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))

    return F.explode(F.flatten(F.transform(span("xmin", "xmax"), lambda x: F.transform(span("ymin", "ymax"), lambda y: F.struct(x.alias("gx"), y.alias("gy")))))).alias("g")


BOX = ("xmin", "ymin", "xmax", "ymax")


def _level(size: float) -> Column:
    """How often a cell must be doubled until a box is at most four cells wide and high."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return F.greatest(F.lit(0), F.ceil(F.log2(side / (4 * size))).cast("int"))


def _dealt(boxes: DataFrame, top: DataFrame, name: str, size: float) -> DataFrame:
    """A row for each cell of a box on its own level and every coarser one that is in use; boxes much larger than a cell fill
    few cells so."""
    levels = boxes.select("id", *BOX, _level(size).alias("own")).join(F.broadcast(top))
    at = levels.select("*", F.explode(F.sequence(F.col("own"), F.greatest("own", "top"))).alias("level")).withColumn("cell", F.pow(F.lit(2.0), F.col("level")) * size)
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("cell")), F.floor(F.col(hi) / F.col("cell")))
    cells = at.select("*", F.explode(span("xmin", "xmax")).alias("gx")).select("*", F.explode(span("ymin", "ymax")).alias("gy"))
    return cells.select(F.col("id").alias(f"{name}_id"), *[F.col(c).alias(f"{name[0]}_{c}") for c in BOX], F.col("own").alias(f"{name[0]}_own"), "level", "cell", "gx", "gy")


def box_join(left: DataFrame, right: DataFrame, size: float = 1.0, touches: bool = True) -> DataFrame:
    """left_id, right_id of boxes that meet. Both sides are dealt into grid cells and meet by an equality join; a pair
    is taken only on the level of its larger box, in the cell of its shared lower-left corner, so none comes twice and no
    distinct is needed. A box fills at most 25 cells of a level, however large it is."""
    top = left.select(_level(size).alias("own")).unionAll(right.select(_level(size).alias("own"))).agg(F.coalesce(F.max("own"), F.lit(0)).alias("top"))
    a, b = _dealt(left, top, "left", size), _dealt(right, top, "right", size).drop("cell")
    under = (lambda x, y: x <= y) if touches else (lambda x, y: x < y)
    c = F.col
    meets = under(c("l_xmin"), c("r_xmax")) & under(c("r_xmin"), c("l_xmax")) & under(c("l_ymin"), c("r_ymax")) & under(c("r_ymin"), c("l_ymax"))
    here = (F.floor(F.greatest("l_xmin", "r_xmin") / c("cell")) == c("gx")) & (F.floor(F.greatest("l_ymin", "r_ymin") / c("cell")) == c("gy"))
    return a.join(b, ["level", "gx", "gy"]).where((c("level") == F.greatest("l_own", "r_own")) & meets & here).select("left_id", "right_id")


def ring_join(left: DataFrame, right: DataFrame, size: float = 1.0) -> DataFrame:
    """left_id, right_id of rings (id, ring: closed array of struct<x, y>) whose areas meet, edges included: their boxes meet by
    `box_join`, then the rings themselves are compared. ids name one ring each."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = lambda df: df.select("id", F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    pairs = box_join(boxed(left), boxed(right), size)
    of = lambda df, k: df.select(F.col("id").alias(f"{k}_id"), F.col("ring").alias(f"{k}_ring"))
    return pairs.join(of(left, "left"), "left_id").join(of(right, "right"), "right_id").where(geo.rings_meet(F.col("left_ring"), F.col("right_ring"))).select("left_id", "right_id")


def overlap_sets(cells: DataFrame, footprints: DataFrame, size: float = 1.0, touches: bool = True) -> DataFrame:
    """Every cell with the sorted distinct layers and files of the footprints that meet it, their lines if they have a year, and
    their number. footprints: id, layer, file, the box and possibly year."""
    named = with_line(footprints)
    hits = box_join(cells, footprints, size, touches).join(named.select(F.col("id").alias("right_id"), *[c for c in ("layer", "file", "line") if c in named.columns]), "right_id")
    sets = hits.groupBy("left_id").agg(*set_columns(footprints), F.count("layer").alias("overlap_count"))
    names = [c for c in ("layers", "files", "lines") if c in sets.columns]
    return cells.join(sets, cells["id"] == F.col("left_id"), "left").select(cells["id"], *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in names], F.coalesce("overlap_count", F.lit(0)).alias("overlap_count"))


def fragments(footprints: DataFrame, size: float = 1.0) -> DataFrame:
    """gx, gy, x0, x1, y0, y1, n, cover: pieces of grid squares with how many footprints cover each and a name of that set.
    A square is cut into strips at the sides that stand in it; along a strip the set changes where footprints begin and
    end, so it comes from running sums, and no piece is compared with all footprints."""
    c = F.col
    sides = ("xmin", "ymin", "xmax", "ymax")
    # equal boxes cover the same; so a set of different boxes names what covers a piece, however often rows or ids repeat
    box = footprints.groupBy(*sides).agg(F.count(F.lit(1)).alias("k")).withColumn("s", F.xxhash64(*sides)).where("xmin < xmax and ymin < ymax")
    ends = [f(a, b * size).alias(n) for f, a, b, n in ((F.greatest, c("xmin"), c("g.gx"), "x0"), (F.greatest, c("ymin"), c("g.gy"), "y0"), (F.least, c("xmax"), c("g.gx") + 1, "x1"), (F.least, c("ymax"), c("g.gy") + 1, "y1"))]
    parts = box.select("k", "s", "xmin", "ymin", "xmax", "ymax", _cells(size)).select("k", "s", "g.gx", "g.gy", *ends).where("x0 < x1 and y0 < y1")
    parts = parts.groupBy("gx", "gy", "x0", "x1", "y0", "y1").agg(F.sum("k").alias("k"), F.bit_xor("s").alias("s"))
    square = Window.partitionBy("gx", "gy").orderBy("lo")
    strips = parts.select("gx", "gy", F.explode(F.array("x0", "x1")).alias("lo")).distinct().withColumn("hi", F.lead("lo").over(square)).where("hi is not null")
    turns = F.explode(F.array(F.struct(c("y0").alias("y"), c("k")), F.struct(c("y1").alias("y"), (-c("k")).alias("k")))).alias("t")
    events = parts.join(strips, ["gx", "gy"]).where("x0 <= lo and x1 >= hi").select("gx", "gy", "lo", "hi", "s", turns).groupBy("gx", "gy", "lo", "hi", c("t.y").alias("y0")).agg(F.sum("t.k").alias("k"), F.bit_xor("s").alias("s"))
    along = Window.partitionBy("gx", "gy", "lo").orderBy("y0")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = events.select("gx", "gy", c("lo").alias("x0"), c("hi").alias("x1"), "y0", F.lead("y0").over(along).alias("y1"), F.sum("k").over(so_far).alias("n"), F.bit_xor("s").over(so_far).alias("cover"))
    return found.where("n > 0")


def named_boxes(footprints: DataFrame, names: list[str], size: float) -> DataFrame:
    """gx, gy, kind (place in names), name, l, b, r, t: what the points of each grid square have to be compared with to learn which names cover
    them. Sides beyond a square are infinitely far for it, and of one name's boxes with one lower left corner only those go on that no
    other one reaches beyond in both directions; so neither repeated rows nor nested boxes are compared with every point."""
    c = F.col
    inf = F.lit(float("inf"))
    boxes = footprints.select(*names, *BOX, _cells(size)).select(*names, "g.gx", "g.gy", *BOX)
    low = lambda v, g: F.when(F.floor(c(v) / size) < c(g), -inf).otherwise(c(v))
    high = lambda v, g: F.when(F.floor(c(v) / size) > c(g), inf).otherwise(c(v))
    cut = boxes.select(*names, "gx", "gy", low("xmin", "gx").alias("l"), low("ymin", "gy").alias("b"), high("xmax", "gx").alias("r"), high("ymax", "gy").alias("t"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c(x).cast("string").alias("name")) for k, x in enumerate(names)])).alias("n")
    at = ["gx", "gy", "kind", "name", "l", "b"]
    # repeated boxes meet here, so none of the windows gets a name's rows one by one
    once = cut.select(each, "gx", "gy", "l", "b", "r", "t").select("n.*", "gx", "gy", "l", "b", "r", "t").where("name is not null").groupBy(*at, "r").agg(F.max("t").alias("t"))
    wider = Window.partitionBy(*at).orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("_top", F.max("t").over(wider)).where("_top is null or t > _top").drop("_top")


def atomic_cells(footprints: DataFrame, size: float = 1.0, min_area: float = 0.0) -> DataFrame:
    """cell, xmin, ymin, xmax, ymax, area_m2 (on the Mercator plane), overlap_count, layers, files, and lines if there is a year: the regions into which the
    footprints' sides cut each other, each covered by one set of footprints. Fragments of grid squares that meet along a
    side and have the same cover are one cell, so neither cells nor areas depend on `size`. Footprints that only touch a
    cell don't count. footprints: id, layer, file and the box in degrees."""
    c = F.col
    # fragments side by side between the same two heights become one piece, so few pieces are left to be linked
    row = Window.partitionBy("gy", "y0", "y1", "cover").orderBy("x0")
    apart = F.coalesce((F.lag("x1").over(row) != c("x0")).cast("int"), F.lit(0))
    runs = fragments(footprints, size).withColumn("apart", apart).withColumn("run", F.sum("apart").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("gy", "y0", "y1", "cover", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("n").alias("n")).drop("run")
    pieces = stored(runs.withColumn("piece", F.monotonically_increasing_id()))
    a, b = (pieces.select(*[c(x).alias(f"{k}_{x}") for x in pieces.columns]) for k in "ab")
    beside = a.join(b, (c("a_gy") == c("b_gy")) & (c("a_x1") == c("b_x0")) & (c("a_cover") == c("b_cover"))).where("a_y0 < b_y1 and b_y0 < a_y1")
    above = a.join(b, (c("a_gy") + 1 == c("b_gy")) & (c("a_y1") == c("b_y0")) & (c("a_cover") == c("b_cover"))).where("a_x0 < b_x1 and b_x0 < a_x1")
    links = beside.unionByName(above).select(c("a_piece").alias("a"), c("b_piece").alias("b"))
    mercator = lambda y: geo.mercator(F.lit(0.0), y)[1]
    area = F.sum(geo.MERCATOR_RADIUS * F.radians(c("x1") - c("x0")) * (mercator(c("y1")) - mercator(c("y0"))))
    named = pieces.join(components(links), c("piece") == c("node"), "left").withColumn("cell", F.coalesce("component", "piece"))
    middle = (c("x0") + c("x1")) / 2
    inside = F.min_by(F.struct(F.floor(middle / size).alias("gx"), "gy", middle.alias("x"), ((c("y0") + c("y1")) / 2).alias("y")), F.struct("x0", "y0")).alias("at")
    cells = named.groupBy("cell").agg(F.min("x0").alias("xmin"), F.min("y0").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"), area.alias("area_m2"), F.first("n").alias("overlap_count"), inside)
    cells = stored(cells.where(c("area_m2") > min_area))
    own = [x for x in ("layer", "file", "line") if x in with_line(footprints).columns]
    over = named_boxes(with_line(footprints), own, size)
    points = cells.select("cell", "at.*")
    hits = points.join(over, ["gx", "gy"]).where("l < x and x < r and b < y and y < t").select("cell", "kind", "name").distinct()
    found = {x: F.collect_set(F.when(c("kind") == k, c("name"))) for k, x in enumerate(own)}
    sets = hits.groupBy(c("cell").alias("_cell")).agg(*[F.array_sort(F.array_remove(v, "") if x == "line" else v).alias(f"{x}s") for x, v in found.items()])
    return cells.drop("at").join(sets, c("cell") == c("_cell"), "left").select(*[x for x in cells.columns if x != "at"], *[F.coalesce(f"{x}s", F.array().cast("array<string>")).alias(f"{x}s") for x in own])
