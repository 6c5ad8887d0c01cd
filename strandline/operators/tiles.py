"""Whole tiles of a raster at a time, as arrays: parts of a tile's pixels, their sides, and the rings of parts that lie inside their tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 31  # pixel number = row * WIDTH + col; corners are numbered alike
CHUNK = 1 << 18  # pixels that are worked on at a time, and the rest of their last tile
ROWS = 1 << 16  # rows of a batch that goes back

#: By turn (0 east, 1 south, 2 west, 3 north; the region on the right): the pixels beyond a side, ahead on its left and straight ahead,
#: where it starts, and the other pixels around its start, in a circle.
BEYOND, LEFT, AHEAD = ("n", "e", "s", "w"), ("ne", "se", "sw", "nw"), ("e", "s", "w", "n")
START = np.array(((0, 0), (0, 1), (1, 1), (1, 0)), dtype=np.int64)
AROUND = (("w", "nw", "n"), ("n", "ne", "e"), ("e", "se", "s"), ("s", "sw", "w"))

Arrays = dict[str, np.ndarray]  # of columns; those that are no longs are Arrow's


def taken(v: np.ndarray | pa.Array, at: np.ndarray) -> np.ndarray | pa.Array:
    return v.take(pa.array(at)) if isinstance(v, pa.Array) else v[at]


def by_tiles(pixels: DataFrame, tile: int, work: Callable[[Arrays], Arrays], schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """What `work` makes of the pixels of whole tiles, or of those with the same keys in a tile; tiles are those of row and col, or of
    columns tr and tc. Many tiles are given at once, numbered in column `group`; a task holds CHUNK rows and those of one tile."""
    names = pixels.columns
    own = "tr" in names
    by = [*map(F.col, keys), *([F.col("tr"), F.col("tc")] if own else [F.floor(F.col(n) / tile) for n in ("row", "col")])]
    out = [f.split()[0] for f in schema.split(", ")]

    def groups(rows: Arrays) -> np.ndarray:
        of = [v.dictionary_encode(null_encoding="encode").indices.to_numpy() if isinstance(v, pa.Array) else v for v in (rows[k] for k in keys)]
        of += [rows["tr"], rows["tc"]] if own else [rows["row"] // tile, rows["col"] // tile]
        new = np.zeros(len(rows["row"]), bool)
        for v in of:
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    def columns(table: pa.Table) -> Arrays:
        table = table.combine_chunks()
        arrays = {n: table.column(n).combine_chunks() for n in names}
        arrays = {n: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for n, v in arrays.items()}
        rows = {n: v.to_numpy() if v.type == pa.int64() and not v.null_count else v for n, v in arrays.items()}
        return rows | {"group": groups(rows)}

    def made(rows: Arrays) -> Iterator[pa.RecordBatch]:
        done = work(rows)
        yield from pa.table({n: done[n] for n in out}).to_batches(ROWS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            rows = columns(table)
            cut = int(np.searchsorted(rows["group"], rows["group"][-1]))
            if cut:
                yield from made({k: v[:cut] for k, v in rows.items()})
            held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield from made(columns(pa.Table.from_batches(held)))

    return pixels.repartition(*by).sortWithinPartitions(*by).mapInArrow(whole, schema)


def ordered(rows: Arrays, tile: int, frame: int = 0) -> Arrays:
    """Each pixel once, in the order of groups, rows and columns, with its place in that order, k, and in its tile, r and c; a frame of
    so many pixels around a tile belongs to it too."""
    tr, tc = (rows["tr"], rows["tc"]) if "tr" in rows else (rows["row"] // tile, rows["col"] // tile)
    wide, r, c = tile + 2 * frame, rows["row"] - tr * tile + frame, rows["col"] - tc * tile + frame
    k, first = np.unique((rows["group"] * wide + r) * wide + c, return_index=True)
    return {n: taken(v, first) for n, v in rows.items()} | {"k": k, "r": r[first], "c": c[first]}


def neighbours(p: Arrays, wide: int, names: tuple[str, ...]) -> Arrays:
    """For each of some directions the neighbours' positions, -1 without one in the tile."""
    k, r, c, n = p["k"], p["r"], p["c"], len(p["k"])
    out: Arrays = {}

    def put(forth: str, back: str, step: int, fits: np.ndarray) -> None:
        if forth not in names and back not in names:
            return
        at = np.minimum(np.searchsorted(k, k + step), n - 1)
        hit = fits & (k[at] == k + step)
        out[forth], out[back] = np.where(hit, at, -1), np.full(n, -1)
        out[back][at[hit]] = np.flatnonzero(hit)

    low, right, left = r < wide - 1, c < wide - 1, c > 0
    put("e", "w", 1, right)
    put("s", "n", wide, low)
    put("se", "nw", wide + 1, low & right)
    put("sw", "ne", wide - 1, low & left)
    return out


def parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each of n positions reaches by links a, b: roots hang on to smaller ones, until all links are inside."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def tile_parts(p: Arrays, near: Arrays, tile: int, diagonal: bool, value: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's part of its tile, as the position of the part's first pixel, and whether the part reaches the tile's edge.
    Neighbours of different values are apart."""
    links = []
    for d in ("e", "s", "se", "sw") if diagonal else ("e", "s"):
        a = np.flatnonzero(near[d] >= 0)
        b = near[d][a]
        if value is not None:
            same = value[a] == value[b]
            a, b = a[same], b[same]
        links.append((a, b))
    root = parts(len(p["k"]), *(np.concatenate(v) for v in zip(*links, strict=True)))
    at_edge = (p["r"] == 0) | (p["r"] == tile - 1) | (p["c"] == 0) | (p["c"] == tile - 1)
    reaches = np.zeros(len(root), bool)
    reaches[root[at_edge]] = True
    return root, reaches[root]


def chains(node: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node of each node's closed chain, and how many steps from that one it comes: `cycles` for chains that one task holds."""
    least, far, jump, span = node.copy(), np.zeros(len(node), np.int64), nxt.copy(), 1
    done, on = np.zeros(len(node), bool), np.arange(len(node))
    while len(on):
        to = jump[on]
        less, known = least[to] < least[on], (least[to] == least[on]) | done[to]
        low, away, further = np.minimum(least[on], least[to]), np.where(less, far[to] + span, far[on]), jump[to]
        least[on], far[on], jump[on], done[on] = low, away, further, known
        on = on[~known]
        span *= 2
    _, ring, length = np.unique(least, return_inverse=True, return_counts=True)
    length = length[ring]
    return least, (length - far) % length


def free_sides(near: Arrays, root: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels (positions, of some) and turns of the sides that have another part, or none, beyond them."""
    found = []
    for turn, beyond in enumerate(BEYOND):
        to = near[beyond][of]
        found.append((of[(to < 0) | (root[to] != root[of])], turn))
    return np.concatenate([p for p, _ in found]), np.repeat(np.arange(4), [len(p) for p, _ in found])


def rings_inside(p: Arrays, near: Arrays, root: np.ndarray, inside: np.ndarray) -> Arrays:
    """The rings of parts that don't reach their tile's edge, as `ring_points` has them; `first` is the position of the part's first pixel."""
    pixel, turn = free_sides(near, root, np.flatnonzero(inside))
    side = np.full((4, len(root)), -1)
    side[turn, pixel] = np.arange(len(pixel))
    part = root[pixel]
    at = lambda names: np.stack([near[n] for n in names])[turn, pixel]
    of = lambda to: np.where(to >= 0, root[to], -1)
    left, ahead = at(LEFT), at(AHEAD)
    nxt = np.where(of(left) == part, side[(turn + 3) % 4, left], np.where(of(ahead) == part, side[turn, ahead], side[(turn + 1) % 4, pixel]))
    around = [part, *(of(at([AROUND[t][k] for t in range(4)])) for k in range(3))]
    borders = sum((a != b).astype(np.int8) for a, b in zip(around, around[1:] + around[:1], strict=True))
    head = borders > 2
    head[nxt[turn != turn[nxt]]] = True
    ahead = nxt
    while True:
        between = np.flatnonzero(~head[ahead])
        if not len(between):
            break
        ahead[between] = ahead[ahead[between]]
    number = np.cumsum(head) - 1
    pixel, turn, nxt = pixel[head], turn[head], number[ahead[head]]
    row, col = p["row"][pixel] + START[turn, 0], p["col"][pixel] + START[turn, 1]
    ring, at = chains((row * WIDTH + col) * 4 + turn, nxt)
    rows = {"first": root[pixel], "ring": ring, "at": at, "row": row, "col": col, "row2": row[nxt], "col2": col[nxt]}
    order = np.lexsort((at, ring))
    return {n: v[order] for n, v in rows.items()}
