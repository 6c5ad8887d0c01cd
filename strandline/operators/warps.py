"""Fits of control points (keys, x, y, lon, lat): from pixels to the ground, for all sheets at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGETS = ("lon", "lat")
TERMS = {1: ((0, 0), (1, 0), (0, 1)), 2: ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))}  # powers of x and y


def affine_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, lon_x, lon_y, lon_0, lat_x, lat_y, lat_0: lon = lon_x * x + lon_y * y + lon_0 by least squares, lat alike. Points with
    missing values don't count; sheets of fewer than three points, or of points in a line, have NULL coefficients."""
    c = F.col
    whole = points.where(" and ".join(f"{v} is not null" for v in ("x", "y", *TARGETS)))
    sums = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m_{v}") for v in ("x", "y", *TARGETS)], F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), *[F.covar_pop(a, t).alias(f"{a}_{t}") for a in "xy" for t in TARGETS])
    det = c("xx") * c("yy") - c("xy") * c("xy")
    fine = det > 1e-12 * c("xx") * c("yy")
    out = {}
    for t in TARGETS:
        out[f"{t}_x"] = F.when(fine, (c(f"x_{t}") * c("yy") - c(f"y_{t}") * c("xy")) / det)
        out[f"{t}_y"] = F.when(fine, (c(f"y_{t}") * c("xx") - c(f"x_{t}") * c("xy")) / det)
    known = sums.withColumns(out)
    return known.select(*keys, "n", *[v for t in TARGETS for v in (f"{t}_x", f"{t}_y", (c(f"m_{t}") - c(f"{t}_x") * c("m_x") - c(f"{t}_y") * c("m_y")).alias(f"{t}_0"))])


def affine_residuals(points: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """points with d_lon, d_lat: how far each is from where its sheet's fit puts it."""
    c = F.col
    return points.join(fits, keys).withColumns({f"d_{t}": c(t) - (c(f"{t}_x") * c("x") + c(f"{t}_y") * c("y") + c(f"{t}_0")) for t in TARGETS}).select(*points.columns, "d_lon", "d_lat")


def moment(p: int, q: int) -> Column:
    """x^p y^q of points moved and scaled to about -1..1."""
    one = F.lit(1.0)
    for v, k in (("u", p), ("v", q)):
        for _ in range(k):
            one = one * F.col(v)
    return one


def normal_equations(points: DataFrame, keys: list[str], order: int) -> tuple[DataFrame, DataFrame]:
    """The sums of each sheet's normal equations, one row a sheet, and the points with the scaled places u and v they are of."""
    c = F.col
    whole = points.where(" and ".join(f"{v} is not null" for v in ("x", "y", *TARGETS)))
    middle = whole.groupBy(*keys).agg(*[f(v).alias(f"{n}_{v}") for v in "xy" for n, f in (("lo", F.min), ("hi", F.max))], *[F.avg(t).alias(f"m_{t}") for t in TARGETS])
    unit = lambda v: F.coalesce(F.try_divide(2 * c(v) - c(f"lo_{v}") - c(f"hi_{v}"), c(f"hi_{v}") - c(f"lo_{v}")), F.lit(0.0))
    placed = whole.join(middle, keys).withColumns({"u": unit("x"), "v": unit("y")})
    powers = sorted({(a + p, b + q) for a, b in TERMS[order] for p, q in TERMS[order]})
    sums = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.first(f"{n}_{v}").alias(f"{n}_{v}") for v in "xy" for n in ("lo", "hi")], *[F.first(f"m_{t}").alias(f"m_{t}") for t in TARGETS],
        F.array(*[F.sum(moment(p, q)) for p, q in powers]).alias("left"), *[F.array(*[F.sum(moment(p, q) * (c(t) - c(f"m_{t}"))) for p, q in TERMS[order]]).alias(f"right_{t}") for t in TARGETS],
    )
    return sums, placed


def polynomial_fit(points: DataFrame, keys: list[str], order: int = 2) -> DataFrame:
    """points with d_lon, d_lat (what the sheet's least-squares polynomial of order 1 or 2 misses a point by) and loo_lon, loo_lat (by what
    one fitted without that point would). Sums are Spark aggregates; the small systems of many sheets are solved together,
    batch by batch. Sheets whose points don't settle the polynomial have NULLs."""
    terms = TERMS[order]
    powers = sorted({(a + p, b + q) for a, b in terms for p, q in terms})
    at = np.array([[powers.index((a + p, b + q)) for p, q in terms] for a, b in terms])
    sums, placed = normal_equations(points, keys, order)
    solved = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys).schema) + ", inverse array<double>, c_lon array<double>, c_lat array<double>"

    def solve(batches):
        for pdf in batches:
            pdf = pdf[pdf["n"] >= len(terms)]
            if len(pdf):
                left = np.stack(pdf["left"].to_list())[:, at]
                pdf = pdf[np.linalg.cond(left) < 1e12]
            if not len(pdf):
                continue
            inverse = np.linalg.inv(np.stack(pdf["left"].to_list())[:, at])
            out = pdf[keys].copy()
            out["inverse"] = list(inverse.reshape(len(pdf), -1))
            for t in TARGETS:
                out[f"c_{t}"] = list((inverse @ np.stack(pdf[f"right_{t}"].to_list())[:, :, None])[:, :, 0])
            yield out

    fits = sums.mapInPandas(solve, solved)
    c, row = F.col, F.array(*[moment(p, q) for p, q in terms])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    joined = placed.join(fits, keys, "left").withColumn("row", row)
    # the leverage of a point: its row times the inverse times its row
    lever = F.aggregate(F.sequence(F.lit(0), F.lit(len(terms) - 1)), F.lit(0.0), lambda s, i: s + c("row")[i] * dot(F.slice("inverse", i * len(terms) + 1, len(terms)), c("row")))
    joined = joined.withColumns({"lever": F.when(c("inverse").isNotNull(), lever)} | {f"d_{t}": F.when(c("inverse").isNotNull(), c(t) - c(f"m_{t}") - dot(c(f"c_{t}"), c("row"))) for t in TARGETS})
    left_out = {f"loo_{t}": F.when(1 - c("lever") > 1e-9, c(f"d_{t}") / (1 - c("lever"))) for t in TARGETS}
    return joined.withColumns(left_out).select(*points.columns, "d_lon", "d_lat", "loo_lon", "loo_lat")


def fit_report(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, rms, worst (of d_lon, d_lat together) and, if there are left-out errors, loo_rms."""
    c = F.col
    size = lambda k: F.hypot(c(f"{k}_lon"), c(f"{k}_lat"))
    mean = lambda k: F.sqrt(F.avg(size(k) * size(k)))
    loo = [mean("loo").alias("loo_rms")] if "loo_lon" in residuals.columns else []
    return residuals.groupBy(*keys).agg(F.count("d_lon").alias("n"), mean("d").alias("rms"), F.max(size("d")).alias("worst"), *loo)


def thin_plate_terms(points: DataFrame, targets: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """keys, id, at, term: r^2 ln r between each target (keys, id, x, y) and each control point (keys, at, x, y) of its sheet; a sheet's
    pairs meet by its keys. With a sheet's weights by `at` they add up to its thin-plate surface."""
    c = F.col
    pairs = targets.select(*keys, id_col, c("x").alias("tx"), c("y").alias("ty")).join(points.select(*keys, "at", "x", "y"), keys)
    r2 = F.pow(c("tx") - c("x"), 2) + F.pow(c("ty") - c("y"), 2)
    return pairs.select(*keys, id_col, "at", F.when(r2 > 0, r2 * F.ln(r2) / 2).otherwise(0.0).alias("term"))
