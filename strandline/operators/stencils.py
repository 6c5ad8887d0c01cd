"""Work on rasters whose pixels need their neighbours, tile by tile: diffusion, distances, watersheds.

A raster is rows (row, col, values); pixels that aren't there are outside. A task holds one tile and a halo of pixels around
it. Where a result depends on more than the halo, tiles take turns: each settles by itself with what its neighbours last had,
and is taken up again when a pixel of its halo has changed, until none has. What they settle on is defined without tiles, so
their size changes nothing. Each turn is a written table; the one before it is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import patches, regions
from strandline.storage import free, stored

TILE = 256
FAR = np.iinfo(np.int64).max // 4
AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def tiles(tile: int, halo: int) -> Column:
    """The tiles that need a pixel: its own and those it is in the halo of. Struct of tr, tc."""
    span = lambda v: F.sequence(F.floor((F.col(v) - halo) / tile), F.floor((F.col(v) + halo) / tile))
    return F.flatten(F.transform(span("row"), lambda r: F.transform(span("col"), lambda c: F.struct(r.alias("tr"), c.alias("tc")))))


def grid(pdf: pd.DataFrame, column: str, fill, kind=np.float64) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A column as an array with an empty edge, and where the rows are in it."""
    row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    at = (row - row.min() + 1, col - col.min() + 1)
    out = np.full((row.max() - row.min() + 3, col.max() - col.min() + 3), fill, kind)
    out[at] = pdf[column].to_numpy()
    return out, at


def by_tile(dealt: DataFrame, tile: int, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """work(pixels of a tile and its halo, which of them are the tile's) for each tile; what it returns for the halo is left out."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        inner = ((pdf["row"] // tile == key[0]) & (pdf["col"] // tile == key[1])).to_numpy()
        return work(pdf, inner)[inner]

    return dealt.groupBy("tr", "tc").applyInPandas(one, schema)


def with_tiles(df: DataFrame, tile: int, halo: int) -> DataFrame:
    return df.withColumn("t", F.explode(tiles(tile, halo))).select(*df.columns, "t.tr", "t.tc")


def settled(df: DataFrame, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], tile: int) -> DataFrame:
    """work until nothing changes; it gets a tile and one pixel around it, and returns the same columns as the tile settles."""
    columns, c = df.columns, F.col
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", moved boolean"

    def marked(pdf: pd.DataFrame, inner: np.ndarray) -> pd.DataFrame:
        out = work(pdf[columns].copy(), inner)
        return out.assign(moved=(out[columns].to_numpy() != pdf[columns].to_numpy()).any(1))

    state = stored(by_tile(with_tiles(df, tile, 1), tile, marked, schema))
    own = F.struct(F.floor(c("row") / tile).alias("tr"), F.floor(c("col") / tile).alias("tc"))
    while True:
        # the tiles with a changed pixel in their halo, not the tile it is part of
        active = stored(state.where("moved").select(own.alias("own"), F.explode(tiles(tile, 1)).alias("t")).where("own <> t").select("t.tr", "t.tc").distinct())
        if active.isEmpty():
            free(active)
            return state.drop("moved")
        again = by_tile(with_tiles(state.drop("moved"), tile, 1).join(active, ["tr", "tc"], "left_semi"), tile, marked, schema)
        rest = state.withColumns({"tr": F.floor(c("row") / tile), "tc": F.floor(c("col") / tile)}).join(active, ["tr", "tc"], "left_anti")
        new = stored(again.unionByName(rest.select(*columns, F.lit(False).alias("moved"))))
        free(state, active)
        state = new


def diffused(pixels: DataFrame, value: str, steps: int = 20, kappa: float = 100.0, gamma: float = 0.25, spacing: tuple[float, float] = (1.0, 1.0), wide: bool = False, tile: int = TILE, halo: int = 8) -> DataFrame:
    """row, col, value after `steps` steps of anisotropic diffusion (Perona and Malik): a pixel takes up gamma times the flow from
    its four neighbours, which is their difference times a conduction that falls where it is large against kappa; wide: the form
    that favours wide regions, else the one that favours edges of high contrast. Nothing flows over the raster's edge, nor from
    or to pixels that are missing or NULL. Tiles exchange halos every `halo` steps, each enough for the steps between."""

    def some(n: int):
        def work(pdf: pd.DataFrame, inner: np.ndarray) -> pd.DataFrame:
            v, at = grid(pdf, value, np.nan)
            for _ in range(n):
                flow = np.zeros_like(v)
                for axis, apart in zip((0, 1), spacing, strict=True):
                    d = np.nan_to_num(np.diff(v, axis=axis))
                    conducts = 1 / (1 + (d / kappa) ** 2) if wide else np.exp(-((d / kappa) ** 2))
                    d = conducts / apart * d
                    ends = [(0, 0), (0, 0)]
                    ends[axis] = (0, 1)
                    flow += np.pad(d, ends)
                    ends[axis] = (1, 0)
                    flow -= np.pad(d, ends)
                v = v + gamma * flow
            return pdf[["row", "col"]].assign(**{value: v[at]})

        return work

    state = stored(pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias(value)))
    done = 0
    while done < steps:
        n = min(halo, steps - done)
        new = stored(by_tile(with_tiles(state, tile, n), tile, some(n), f"row long, col long, {value} double"))
        free(state)
        state, done = new, done + n
    # pandas has no NULL for doubles
    return state.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def distances(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, d: how far each pixel of a mask is from the next one that isn't in it, in moves of a king; all outside isn't."""

    def work(pdf: pd.DataFrame, inner: np.ndarray) -> pd.DataFrame:
        d, at = grid(pdf, "d", 0, np.int64)
        while True:
            low = np.minimum.reduce([np.roll(d, step, (0, 1)) for step in AROUND])
            new = d.copy()
            new[at] = np.where(inner, np.minimum(d[at], low[at] + 1), d[at])
            if (new == d).all():
                return pdf.assign(d=d[at])
            d = new

    pixels = mask.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    return settled(pixels.withColumn("d", F.lit(FAR).cast("long")), work, tile)


def flooded(heights: DataFrame, markers: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, label of pixels (row, col, d: at least 1) that markers (row, col, label) flood, from the highest d down: a label
    goes on to neighbours, diagonal ones too. A pixel is reached at the least d of the way to it, at the height where that is
    largest; by fewest moves since the way came down to it; by the smallest label. A pixel that no way reaches has NULL."""
    top = 1 << 30

    def work(pdf: pd.DataFrame, inner: np.ndarray) -> pd.DataFrame:
        height = pdf["d"].to_numpy()
        free_ = inner & (pdf["m"].to_numpy() < top)
        m, at = grid(pdf, "m", 0, np.int64)
        s, label = grid(pdf, "s", 0, np.int64)[0], grid(pdf, "label", -1, np.int64)[0]
        while True:
            best = (np.zeros(len(height), np.int64), np.zeros(len(height), np.int64), np.full(len(height), -1))
            for step in AROUND:
                mn, sn, ln = (np.roll(x, step, (0, 1))[at] for x in (m, s, label))
                low = np.minimum(mn, height)
                moves = np.where(low == mn, sn + 1, 1)
                better = (low > best[0]) | (low == best[0]) & (low > 0) & ((moves < best[1]) | (moves == best[1]) & (ln < best[2]))
                best = tuple(np.where(better, x, y) for x, y in zip((low, moves, ln), best, strict=True))
            new = [np.where(free_, x, y[at]) for x, y in zip(best, (m, s, label), strict=True)]
            if all((x == y[at]).all() for x, y in zip(new, (m, s, label), strict=True)):
                return pdf.assign(m=m[at], s=s[at], label=label[at])
            for x, y in zip(new, (m, s, label), strict=True):
                y[at] = x

    known = heights.join(markers.select("row", "col", F.col("label").alias("own")), ["row", "col"], "left")
    is_marker = F.col("own").isNotNull()
    start = known.select("row", "col", "d", F.when(is_marker, top).otherwise(0).cast("long").alias("m"), F.lit(0).cast("long").alias("s"), F.coalesce("own", F.lit(-1)).cast("long").alias("label"))
    return settled(start, work, tile).select("row", "col", F.when(F.col("m") > 0, F.col("label")).alias("label"))


def watershed(mask: DataFrame, share: float = 0.15, opening: int = 0, tile: int = TILE) -> DataFrame:
    """row, col, label, line: a mask's bodies, parted where they are narrow. Pixels farther from the edge than `share` of the
    largest distance are the bodies' cores; connected cores are one body, named by its least pixel, and flood the rest. line:
    a pixel with one of a smaller label beside it or across a corner. Parts without a core have no label. opening: how often
    the mask is eroded, then dilated, by a square of three first."""
    mask = patches.morph_open(mask, 3, opening) if opening else mask
    heights = stored(distances(mask, tile))
    cores = heights.join(F.broadcast(heights.agg(F.max("d").alias("top"))), F.col("d") > share * F.col("top"), "left_semi")
    found = stored(flooded(heights, regions.label_regions(cores.select("row", "col"), 8, tile), tile))
    free(heights)
    beside = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in AROUND])).alias("to")
    least = found.where("label is not null").select(F.col("label").alias("other"), beside).select("other", "to.*").groupBy("row", "col").agg(F.min("other").alias("other"))
    return found.join(least, ["row", "col"], "left").select("row", "col", "label", F.coalesce(F.col("other") < F.col("label"), F.lit(False)).alias("line"))
