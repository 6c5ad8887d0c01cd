"""Scanned sheets put on the ground: thin-plate surfaces through their control points, warped and cut to their borders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.operators import resample

#: Most control points of one sheet; a sheet's system is solved in one task.
MOST_POINTS = 2000
NODES = "array<struct<u:double,v:double,s:double,t:double>>"


def _solved(nodes) -> tuple[list[tuple], list[float]] | None:
    """Weights of a surface through (u, v) -> (s, t) and its plane; None if the places are in a line."""
    at = np.array([[p["u"], p["v"], p["s"], p["t"]] for p in nodes])
    uv, n = at[:, :2], len(at)
    if n < 3 or np.linalg.matrix_rank(uv - uv.mean(0), tol=1e-9) < 2:
        return None
    r2 = ((uv[:, None] - uv[None]) ** 2).sum(2)
    bend = r2 * np.log(np.where(r2 > 0, r2, 1.0)) / 2
    plane = np.hstack([np.ones((n, 1)), uv])
    system = np.block([[bend, plane], [plane.T, np.zeros((3, 3))]])
    weights = np.linalg.solve(system, np.vstack([at[:, 2:], np.zeros((3, 2))]))
    return [(*uv[i], *weights[i]) for i in range(n)], weights[n:].T.ravel().tolist()


def thin_plate_fit(points: DataFrame, keys: list[str], most: int = MOST_POINTS) -> DataFrame:
    """keys, n, mid_a, mid_b, span, nodes, plane: a surface (a, b) -> (s, t) through all points (keys, a, b, s, t) of each sheet that bends
    least. Points with missing values don't count, points at one place are one with the mean of theirs; sheets of fewer than three
    points, or of points in a line, have no row. A sheet of over `most` points is an error, as one task solves its system."""
    c = F.col
    whole = points.where(" and ".join(f"{v} is not null" for v in "abst"))
    once = whole.groupBy(*keys, "a", "b").agg(F.avg("s").alias("s"), F.avg("t").alias("t"))
    extent = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[((F.min(v) + F.max(v)) / 2).alias(f"mid_{v}") for v in "ab"], F.greatest(F.max("a") - F.min("a"), F.max("b") - F.min("b")).alias("span"))
    few = F.when(c("n") <= most, c("n")).otherwise(F.raise_error(F.concat(F.lit(f"over {most} control points of a sheet: "), c("n").cast("string"))).cast("long"))
    fine = extent.withColumn("n", few).where("n >= 3 and span > 0")
    node = F.struct(((c("a") - c("mid_a")) / c("span")).alias("u"), ((c("b") - c("mid_b")) / c("span")).alias("v"), "s", "t")
    sheets = once.join(fine, keys).groupBy(*keys, "n", "mid_a", "mid_b", "span").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sheets.drop("nodes").schema) + f", nodes {NODES}, plane array<double>"

    def solve(batches):
        for pdf in batches:
            found = [_solved(nodes) for nodes in pdf["nodes"]]
            kept = [x is not None for x in found]
            out = pdf.loc[kept].drop(columns="nodes")
            out["nodes"] = [[dict(zip("uvst", map(float, p), strict=True)) for p in x[0]] for x in found if x is not None]
            out["plane"] = [x[1] for x in found if x is not None]
            yield out

    return sheets.mapInPandas(solve, schema)


def on_surface(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows that carry the columns of thin_plate_fit, with s and t of their surface at (a, b) instead."""
    c = F.col
    placed = rows.withColumns({"_u": (c(a) - c("mid_a")) / c("span"), "_v": (c(b) - c("mid_b")) / c("span")})
    near = F.transform("nodes", lambda p: F.struct(((c("_u") - p["u"]) * (c("_u") - p["u"]) + (c("_v") - p["v"]) * (c("_v") - p["v"])).alias("r2"), p["s"].alias("s"), p["t"].alias("t")))
    terms = F.transform(near, lambda p: F.struct(F.when(p["r2"] > 0, p["r2"] * F.ln(p["r2"]) / 2).otherwise(0.0).alias("k"), p["s"].alias("s"), p["t"].alias("t")))
    bent = F.aggregate(terms, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t")), lambda m, p: F.struct((m["s"] + p["k"] * p["s"]).alias("s"), (m["t"] + p["k"] * p["t"]).alias("t")))
    flat = lambda k: F.get("plane", F.lit(k)) + F.get("plane", F.lit(k + 1)) * c("_u") + F.get("plane", F.lit(k + 2)) * c("_v")
    both = placed.withColumn("_bent", bent)
    return both.withColumns({"s": c("_bent.s") + flat(0), "t": c("_bent.t") + flat(3)}).drop("_u", "_v", "_bent", "n", "mid_a", "mid_b", "span", "nodes", "plane")


def warp(pixels: DataFrame, points: DataFrame, cutlines: DataFrame, keys: list[str], bands: list[str], resolution: float, plane=geo.mercator, method: str = "nearest") -> DataFrame:
    """keys, row, col, bands, alpha: scanned sheets on one grid of `resolution` metres of a plane (lon, lat -> x, y) whose row 0 begins at y = 0
    and whose column 0 at x = 0; rows grow to the south, so sheets can be laid side by side.

    pixels: keys, row, col, bands. points: control points keys, x, y (column and row in the scan, whole numbers at the edges of pixels),
    lon, lat on WGS84. cutlines: keys, ring on WGS84, one a sheet; only grid pixels whose middle is inside it come out. A
    thin-plate surface from the plane to the scan says where each lies there; alpha is 0 where the scan has nothing. The grid is made
    row by row over all tasks; sheets without a surface or a cutline give no pixels."""
    c = F.col
    px, py = plane(c("lon"), c("lat"))
    fits = thin_plate_fit(points.select(*keys, px.alias("a"), py.alias("b"), c("x").cast("double").alias("s"), c("y").cast("double").alias("t")), keys)

    def moved(p):
        x, y = plane(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    borders = cutlines.where("ring is not null").select(*keys, F.transform("ring", moved).alias("ring"))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    cell = lambda v: F.floor(v / resolution)
    boxed = fits.join(borders, keys).withColumns({"_r0": cell(-F.array_max(ys)), "_r1": cell(-F.array_min(ys)), "_c0": cell(F.array_min(xs)), "_c1": cell(F.array_max(xs))})
    rows = boxed.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).repartition(*keys, "row")
    grid = rows.withColumn("col", F.explode(F.sequence("_c0", "_c1"))).withColumns({"gx": (c("col") + 0.5) * resolution, "gy": -(c("row") + 0.5) * resolution})
    inside = grid.where(F.pmod(geo.winding(c("ring"), c("gx"), c("gy")), F.lit(2)) == 1).drop("ring", "_r0", "_r1", "_c0", "_c1")
    places = on_surface(inside, "gx", "gy").select(*keys, "row", "col", (c("t") - 0.5).alias("at_row"), (c("s") - 0.5).alias("at_col"))
    found = resample.resampled(pixels.withColumn("_there", F.lit(1.0)), places, [*bands, "_there"], method, tuple(keys))
    return found.select(*keys, "row", "col", *bands, F.when(c("_there").isNotNull(), 255).otherwise(0).alias("alpha"))
