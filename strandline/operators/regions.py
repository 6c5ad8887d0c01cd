"""Connected regions of a sparse mask (group columns, row, col) and their measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.operators import tiles
from strandline.operators.graph import components
from strandline.storage import stored

TILE = 256
WIDTH = tiles.WIDTH  # pixel number = row * WIDTH + col
SIDES = ((0, 1), (1, 0), (0, -1), (-1, 0))


def label_regions(mask: DataFrame, connectivity: int = 8, tile: int = TILE, value: str | None = None) -> DataFrame:
    """row, col, label: label is the region's least row * 2^31 + col. Tiles are labelled by themselves; only
    labels that touch across seams take part in the distributed components, and only pixels of parts that reach a seam meet what comes of them. With a
    column `value` (long, not null, one for each pixel) a region's pixels have one value, and it is kept."""
    kept = [F.col(value).cast("long").alias(value)] if value else []
    pixels = mask.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *kept).distinct()
    own = [value] if value else []

    def work(rows: tiles.Arrays) -> tiles.Arrays:
        p = tiles.ordered(rows, tile)
        root, seam = tiles.tile_parts(p, tiles.neighbours(p, tile, ("e", "s", "se", "sw") if connectivity == 8 else ("e", "s")), tile, connectivity == 8, p[value] if value else None)
        return p | {"part": p["row"][root] * WIDTH + p["col"][root], "seam": seam}

    parts = stored(tiles.by_tiles(pixels, tile, work, ", ".join(f"{c} long" for c in ("row", "col", *own, "part")) + ", seam boolean"))
    name = "label" if value != "label" else "part"
    inner = parts.where("not seam").select("row", "col", *own, F.col("part").alias(name))
    return inner.unionByName(across_seams(parts.where("seam"), connectivity, tile, own).withColumnRenamed("part", name))


def across_seams(parts: DataFrame, connectivity: int, tile: int, own: list[str]) -> DataFrame:
    """row, col, own, part: parts of tiles that reach their tile's edges, joined where they touch across seams."""
    edge = parts.where((F.pmod("row", F.lit(tile)) == tile - 1) | (F.pmod("col", F.lit(tile)) == tile - 1) | (F.pmod("row", F.lit(tile)) == 0) | (F.pmod("col", F.lit(tile)) == 0))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    to = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in steps])).alias("to")
    touching = edge.select("part", *own, to).select(F.col("part").alias("a"), *own, "to.row", "to.col").join(edge.select("row", "col", *own, F.col("part").alias("b")).hint("merge"), ["row", "col", *own]).where("a <> b").select("a", "b").distinct()
    merged = components(touching)
    return parts.join(merged.hint("merge"), F.col("part") == F.col("node"), "left").select("row", "col", *own, F.coalesce("component", "part").alias("part"))


def neighbour_counts(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, n4: how many of the four neighbours have the same keys."""
    to = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in SIDES])).alias("to")
    near = pixels.select(*keys, to).select(*keys, "to.row", "to.col").groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("n"))
    return pixels.join(near.hint("merge"), [*keys, "row", "col"], "left").select(*keys, "row", "col", F.coalesce("n", F.lit(0)).alias("n4"))


def boundary(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with fewer than four neighbours of their own region; outside the raster is outside."""
    return neighbour_counts(pixels, keys).where("n4 < 4").select(*keys, "row", "col")


def blobs(labels: DataFrame, keys: list[str] | None = None, min_area: int = 1) -> DataFrame:
    """keys, box (ends exclusive), area in pixels, centroid."""
    keys = keys or ["label"]
    found = labels.groupBy(*keys).agg(
        F.min("row").alias("row0"), F.min("col").alias("col0"), (F.max("row") + 1).alias("row1"), (F.max("col") + 1).alias("col1"), F.count(F.lit(1)).alias("area_px"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col")
    )
    return found.where(F.col("area_px") >= min_area)


def sides(pixels: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """keys, turn (0 east, 1 south, 2 west, 3 north), r1, c1, r2, c2: the directed sides between a region and what is not of
    it, by pixel corners. Every pixel has four sides in a fixed sense, so that the region is on their right; sides between two pixels of a region
    cancel. That is seen within tiles, where pixels beside a tile come along."""
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    r, c = F.pmod(row, F.lit(tile)), F.pmod(col, F.lit(tile))
    at = lambda dr, dc: F.struct((F.floor(row / tile) + dr).alias("tr"), (F.floor(col / tile) + dc).alias("tc"))
    beside = F.array_compact(F.array(at(0, 0), F.when(r == 0, at(-1, 0)), F.when(r == tile - 1, at(1, 0)), F.when(c == 0, at(0, -1)), F.when(c == tile - 1, at(0, 1))))
    at_edge = (r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)
    dealt = pixels.select(*keys, row.alias("row"), col.alias("col"), F.explode(F.when(at_edge, beside).otherwise(F.array(at(0, 0)))).alias("t")).select(*keys, "row", "col", "t.*")

    def work(rows: tiles.Arrays) -> tiles.Arrays:
        p = tiles.ordered(rows, tile, 1)
        inside = np.flatnonzero((p["r"] > 0) & (p["r"] <= tile) & (p["c"] > 0) & (p["c"] <= tile))
        at, turn = tiles.free_sides(tiles.neighbours(p, tile + 2, ("n", "e", "s", "w")), np.zeros(len(p["k"]), np.int64), inside)
        start, end = tiles.START[turn], tiles.START[(turn + 1) % 4]
        row, col = p["row"][at], p["col"][at]
        return {k: tiles.taken(p[k], at) for k in keys} | {"turn": turn.astype(np.int32), "r1": row + start[:, 0], "c1": col + start[:, 1], "r2": row + end[:, 0], "c2": col + end[:, 1]}

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name in keys), "turn int", *(f"{n} long" for n in ("r1", "c1", "r2", "c2"))])
    return tiles.by_tiles(dealt, tile, work, schema, tuple(keys))


def outline(pixels: DataFrame, keys: list[str], affine: tuple[float, float, float, float, float, float] = (1, 0, 0, 0, 1, 0)) -> DataFrame:
    """keys, x1, y1, x2, y2: the `sides` of a region in map units."""
    a, b, c, d, e, f = map(float, affine)
    free = sides(pixels, keys)
    x, y = (lambda r, k: a * F.col(k) + b * F.col(r) + c), (lambda r, k: d * F.col(k) + e * F.col(r) + f)
    return free.select(*keys, x("r1", "c1").alias("x1"), y("r1", "c1").alias("y1"), x("r2", "c2").alias("x2"), y("r2", "c2").alias("y2"))


FARTHEST_ZONE = 84.0  # degrees of latitude that zones reach to


def projected(sides: DataFrame, plane=None) -> DataFrame:
    """Sides given in degrees, in metres on the plane of the zone that holds the middle of them all, counted from that middle; beyond
    the zones on the equal-area plane around it. plane (lon, lat -> x, y as columns): that one instead. The extent is one row, which
    the driver reads. Northings go on across the equator."""
    if plane is not None:
        return sides.select("*", *[v.alias(f"_{n}{k}") for k in "12" for n, v in zip("xy", plane(F.col(f"x{k}"), F.col(f"y{k}")), strict=True)]).drop("x1", "y1", "x2", "y2").withColumnsRenamed({f"_{n}{k}": f"{n}{k}" for n in "xy" for k in "12"})
    sides = stored(sides)  # read twice: for the middle and for the way to the plane
    lon, lat = sides.agg((F.min("x1") + F.max("x1")) / 2, (F.min("y1") + F.max("y1")) / 2).first()
    if lon is None:
        return sides
    if abs(lat) > FARTHEST_ZONE:
        far = {k: geo.equal_area(F.col(f"x{k}"), F.col(f"y{k}"), F.lit(lon), F.lit(lat)) for k in "12"}
        return sides.withColumns({f"{n}{k}": far[k][i] for i, n in enumerate("xy") for k in "12"})
    zone = int((lon + 180) // 6 % 60) + 1
    middle = geo.on_zone(sides.sparkSession.range(1).select(F.lit(lon).alias("lon"), F.lit(lat).alias("lat")), {"m": ("lon", "lat")}, zone, "x", "y").first()
    placed = geo.on_zone(sides, {k: (f"x{k}", f"y{k}") for k in "12"}, zone, "_x", "_y")
    return placed.withColumns({f"{n}{k}": F.col(f"_{n}{k}") - middle[f"{n}m"] for n in "xy" for k in "12"}).drop("_x1", "_y1", "_x2", "_y2")


def area_perimeter(pixels: DataFrame, keys: list[str] | None = None, affine=(1, 0, 0, 0, 1, 0), degrees: bool = False, plane=None) -> DataFrame:
    """keys, area, perimeter (holes count), in units of the affine's plane; in metres if the affine gives degrees, on the plane
    that `projected` takes."""
    keys = keys or ["label"]
    return measured(outline(pixels, keys, affine), keys, degrees, plane)


def measured(sides: DataFrame, keys: list[str], degrees: bool = False, plane=None) -> DataFrame:
    """keys, area, perimeter of directed sides (keys, x1, y1, x2, y2) with all areas on one hand."""
    sides = projected(sides, plane) if degrees else sides
    cross = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    return sides.groupBy(*keys).agg(F.abs(F.sum(cross)).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"))


def numbered(labels: DataFrame) -> DataFrame:
    """label, number: regions numbered 1..n in the order of their first pixels. The numbers of a range of labels are counted
    within it and start after those of the ranges before, so no task sees all labels."""
    found = stored(labels.select("label").distinct().repartitionByRange("label").sortWithinPartitions("label").select("label", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    before = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    later = before.select(F.col("part").alias("earlier"), F.col("n").alias("m"))
    starts = before.join(F.broadcast(later), F.col("earlier") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("first"))
    return found.join(F.broadcast(starts), "part").select("label", (F.col("first") + F.col("at") + 1).alias("number"))


def box_counts(edge: DataFrame, keys: list[str] | None = None, most_sizes: int = 8) -> DataFrame:
    """keys, size, boxes: boxes of side 2^k that hold a boundary pixel, anchored at the boundary's box, for sizes up
    to half of its shorter side; regions with few pixels or short sides have none."""
    keys = keys or ["label"]
    box = edge.groupBy(*keys).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.least(F.max("row") - F.min("row"), F.max("col") - F.min("col")).alias("side"), F.count(F.lit(1)).alias("n"))
    fit = box.where("n >= 8 and side + 1 >= 8").select(*keys, "r0", "c0", F.least(F.lit(most_sizes - 1), F.floor(F.log2(F.floor((F.col("side") + 1) / 2)))).alias("top"))
    sizes = F.explode(F.transform(F.sequence(F.lit(0), F.col("top").cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))).alias("size")
    return edge.join(fit.hint("merge"), keys).select(*keys, "row", "col", "r0", "c0", sizes).groupBy(*keys, "size").agg(F.count_distinct(F.floor((F.col("row") - F.col("r0")) / F.col("size")), F.floor((F.col("col") - F.col("c0")) / F.col("size"))).alias("boxes"))


def fractal_dimension(counts: DataFrame, keys: list[str] | None = None, least_sizes: int = 3) -> DataFrame:
    """keys, fractal_dimension: minus the slope of ln(boxes) on ln(size); none below three sizes."""
    keys = keys or ["label"]
    return counts.where("boxes > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (-F.regr_slope(F.ln("boxes"), F.ln("size"))).alias("fractal_dimension")).where(F.col("n") >= least_sizes).drop("n")


def size_histogram(areas: DataFrame, area: str = "area", n_bins: int = 11, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin (1..n_bins), n: logarithmic bins from the least area (at least 1) to the largest (at least ten times
    that); the last bin is closed, smaller areas don't count."""
    a = F.col(area)
    ends = areas.agg(F.greatest(F.min(a) if low is None else F.lit(low), F.lit(1.0)).alias("lo"), (F.max(a) if high is None else F.lit(high)).alias("hi")).select("lo", F.greatest("hi", F.col("lo") * 10).alias("hi"))
    bins = F.when(a >= F.col("hi"), n_bins).otherwise(F.width_bucket(F.ln(a), F.ln("lo"), F.ln("hi"), F.lit(n_bins)))
    return areas.join(F.broadcast(ends)).where(a >= F.col("lo")).select(bins.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_by_edges(areas: DataFrame, edges: list[float], area: str = "area") -> DataFrame:
    """bin, n for given rising edges; the last bin is closed."""
    a = F.col(area)
    at = F.when(a == edges[-1], len(edges) - 1).otherwise(sum(((a >= e).cast("int") for e in edges[1:-1]), F.lit(1)))
    return areas.where(a.between(edges[0], edges[-1])).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


METRICS = ("size_distribution", "fractal_dimension")


def lake_metrics(labels: DataFrame, affine=(1, 0, 0, 0, 1, 0), min_area: float = 0.0, fractal_min_pixels: int = 400, degrees: bool = False, metrics: tuple[str, ...] = METRICS, simplify_px: float = 0.0) -> DataFrame:
    """label, area, perimeter and, if asked for, fractal_dimension (NULL for small or thin lakes). simplify_px: area and perimeter
    are those of outlines simplified by so many pixels, without most of the staircase; the dimension is always the pixels'."""
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"metrics are {', '.join(METRICS)}, not {', '.join(sorted(unknown))}")
    labels = stored(labels)
    if simplify_px > 0:
        from strandline.operators import rings, simplify  # they build on this module

        fewer = rings.placed(simplify.simplified_rings(rings.ring_points(labels), simplify_px), affine)
        shape = measured(fewer.select("label", *[F.col(a).alias(b) for a, b in (("x", "x1"), ("y", "y1"), ("x2", "x2"), ("y2", "y2"))]), ["label"], degrees)
    else:
        shape = area_perimeter(labels, ["label"], affine, degrees)
    if min_area > 0:
        shape = shape.where(F.col("area") >= min_area)
    if "fractal_dimension" not in metrics:
        return shape
    large = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fractal_min_pixels).select("label")
    fractal = fractal_dimension(box_counts(boundary(labels.join(large.hint("merge"), "label", "left_semi"), ["label"])))
    return shape.join(fractal.hint("merge"), "label", "left")


def lake_report(lakes: DataFrame, edges: list[float] | None = None, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row for all lakes of lake_metrics: lake_count, total_area and, if asked for, mean_fractal_dimension and
    size_distribution, an array of (bin, n) over logarithmic bins or those between the given edges."""
    lakes = stored(lakes)
    out = lakes.agg(F.count(F.lit(1)).alias("lake_count"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("total_area"), *([F.avg("fractal_dimension").alias("mean_fractal_dimension")] if "fractal_dimension" in metrics else []))
    if "size_distribution" in metrics:
        bins = size_histogram(lakes) if edges is None else histogram_by_edges(lakes, edges)
        out = out.join(F.broadcast(bins.agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("size_distribution"))))
    return out


def elongated(shapes: DataFrame, max_area: float, least: float = 1.0, most: float = 4.0) -> DataFrame:
    """Shapes of `moments` under an area whose longer axis is `least` to `most` times the shorter one."""
    ratio = F.try_divide("major_axis", "minor_axis")
    return shapes.where((F.col("area_px") < max_area) & ratio.between(least, most))


def with_metrics(features: DataFrame, lakes: DataFrame) -> DataFrame:
    """Polygons or pixels by label with the lakes' measures; those without any stay."""
    return features.join(lakes, "label", "left")


def largest(lakes: DataFrame, n: int = 12) -> DataFrame:
    return lakes.orderBy(F.desc("area"), "label").limit(n)


def perimeters(labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, perimeter: length of the line through the middles of a region's boundary pixels. A boundary pixel counts by its
    boundary neighbours, 2 for each beside and 10 for each across a corner."""
    keys = keys or ["label"]
    #: What a pixel with such a sum counts.
    weights = {1.0: (4, 6, 14, 16, 24, 26), 2**0.5: (20, 32), (1 + 2**0.5) / 2: (12, 22)}
    edge = stored(boundary(labels, keys))
    around = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(2 if 0 in (dr, dc) else 10).alias("w")) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc])).alias("to")
    near = edge.select(*keys, around).select(*keys, "to.*").join(edge, [*keys, "row", "col"]).groupBy(*keys, "row", "col").agg(F.sum("w").alias("w"))
    length = F.coalesce(*[F.when(F.col("w").isin(*sums), weight) for weight, sums in weights.items()], F.lit(0.0))
    return edge.join(near, [*keys, "row", "col"], "left").groupBy(*keys).agg(F.sum(length).alias("perimeter"))


def moments(labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, area_px, centroid, orientation in degrees (0..180) and axis lengths of the ellipse with equal moments."""
    keys = keys or ["label"]
    m = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("area_px"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"), (F.var_pop("row") + 1 / 12).alias("a"), (F.var_pop("col") + 1 / 12).alias("b"), F.covar_pop("row", "col").alias("c"))
    root = F.sqrt(F.pow(F.col("a") - F.col("b"), 2) + 4 * F.pow("c", F.lit(2)))
    return m.select(*keys, "area_px", "centre_row", "centre_col", F.pmod(F.degrees(F.atan2(2 * F.col("c"), F.col("b") - F.col("a")) / 2), F.lit(180.0)).alias("orientation"), (4 * F.sqrt((F.col("a") + F.col("b") + root) / 2)).alias("major_axis"), (4 * F.sqrt(F.greatest(F.lit(0.0), (F.col("a") + F.col("b") - root) / 2))).alias("minor_axis"))
