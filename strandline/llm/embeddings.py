"""Embedding near-dedup: an exact metric range join.

Vectors with equal components form a class. On the unit sphere, cosine >= t means a distance of at most
e = sqrt(2 - 2 t). A bounded sample of classes are the pivots; each class lives in the cell of its nearest
pivot. A class x with home q can be linked with a member of cell p only if

* d(x, p) <= radius(p) + e   (triangle inequality, radius: the farthest member), and
* (d(x, p)^2 - d(x, q)^2) / (2 d(p, q)) <= e   (its distance to the border between the two),

and is copied to p then. Of two cells only one gets the other's copies. Cells over BLOCK members are split into
blocks, each joined with all later blocks and all copies, so a task holds one block and streams the rest. Blocks
are compared in single precision; what is near the threshold or above is decided in double precision. Copies carry
vectors in the precision of the input.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors without an id link as
others do; their class goes by a hash of the vector, and their component is the smallest id in it, or null if none has one;
they stay. Vectors of different lengths never link. Repeated rows are vectors of their own. An empty table gives an empty result; other columns
are not read. How much the pivots save depends on the data: where most vectors are about as far from each other,
each is near most borders, and the join compares a constant share of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import arrow_schema, free, read, shuffle_partitions, stored
from strandline.operators.graph import components

THRESHOLD = 0.95
BLOCK = 8_192  # members of a cell that a task holds; larger blocks need fewer copies
BLOCK_VALUES = 16_000_000  # numbers in them
MAX_PIVOTS = 4_096
MAX_PIVOT_VALUES = 4_000_000  # numbers in all pivots; they are broadcast
PAIRS = 200_000  # pairs decided at once


def unit(raw: list[bytes], dtype: str) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def usable(vector: str) -> F.Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


class Pivots:
    """The pivots by vector length; cells are numbered through. Lengths without a pivot share one cell each."""

    def __init__(self, vectors: list[list[float]]):
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        groups: dict[int, list[tuple[int, list[float]]]] = {}
        for k, v in enumerate(vectors):
            groups.setdefault(len(v), []).append((k, v))
        for dim, rows in groups.items():
            m = np.array([v for _, v in rows], np.float64)
            m /= np.abs(m).max(1, keepdims=True)
            self.by_dim[dim] = (np.array([k for k, _ in rows]), m / np.sqrt((m * m).sum(1, keepdims=True)))

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cells (numbers), cosines to each, index of the nearest in them."""
        dim = x.shape[1]
        if dim not in self.by_dim:
            return np.array([-dim]), np.ones((len(x), 1)), np.zeros(len(x), int)
        cells, m = self.by_dim[dim]
        cos = x @ m.T
        return cells, cos, cos.argmax(1)


def by_length(batch: pa.RecordBatch, dtype: str):
    """The batch's rows in groups of equal vector length: row numbers and unit vectors."""
    raw = batch.column("raw").to_pylist()
    groups: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        groups.setdefault(len(r), []).append(i)
    for rows in groups.values():
        yield np.array(rows), unit([raw[i] for i in rows], dtype)


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cos))


def cell_sizes(classes: DataFrame, pivots, dtype: str) -> dict[int, tuple[int, float]]:
    """cell -> (members, radius); a row for each pivot, and for each vector length without one, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_length(batch, dtype):
                cells, cos, home = pivots.value.near(x)
                yield pa.RecordBatch.from_arrays([pa.array(cells[home]), pa.array(distance(cos[np.arange(len(x)), home]))], names=["cell", "d"])

    seen = classes.mapInArrow(run, "cell long, d double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
    return {r.cell: (r.n, r.radius) for r in seen.collect()}


def deal(classes: DataFrame, pivots, sizes: dict, reach: float, dtype: str, block: int) -> DataFrame:
    """block, copy (0: member, 1: copy), rep, n, raw: each class at home and wherever a partner may be."""
    first, at = {}, 0
    for cell in sorted(sizes):
        first[cell] = (at, -(-sizes[cell][0] // block))
        at += first[cell][1]
    sent = classes.sparkSession.sparkContext.broadcast((first, sizes))
    schema = arrow_schema("block long, copy int, rep long, n long, raw binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sizes = sent.value
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            for rows, x in by_length(batch, dtype):
                cells, cos, home = pivots.value.near(x)
                starts = np.array([first.get(c, (0, 0))[0] for c in cells.tolist()])
                blocks = np.array([first.get(c, (0, 0))[1] for c in cells.tolist()])
                radius = np.array([sizes.get(c, (0, -9.0))[1] for c in cells.tolist()])
                own = (rep[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(1, blocks[home])
                at, copy, row = [starts[home] + own], [np.zeros(len(x), int)], [rows]
                for k in range(int(blocks.max())):  # earlier blocks of the same cell
                    some = own > k
                    at.append(starts[home[some]] + k)
                    copy.append(np.ones(some.sum(), int))
                    row.append(rows[some])
                if len(cells) > 1:
                    m = pivots.value.by_dim[x.shape[1]][1]
                    between = distance(m @ m.T)[home]
                    near = (distance(cos) <= radius + reach + 1e-9) & (cos[np.arange(len(x)), home][:, None] - cos <= (reach + 1e-9) * between)
                    turn = (home[:, None] < np.arange(len(cells))) ^ ((home[:, None] + np.arange(len(cells))) % 2 == 1)
                    near &= turn & (home[:, None] != np.arange(len(cells)))
                    i, p = np.nonzero(near)
                    for k in range(int(blocks.max())):
                        some = blocks[p] > k
                        at.append(starts[p[some]] + k)
                        copy.append(np.ones(some.sum(), int))
                        row.append(rows[i[some]])
                take = pa.array(np.concatenate(row))
                out = [pa.array(np.concatenate(at)), pa.array(np.concatenate(copy).astype(np.int32)), *(batch.column(c).take(take) for c in ("rep", "n", "raw"))]
                table = pa.Table.from_arrays([a.cast(t.type) for a, t in zip(out, schema, strict=True)], schema=schema)
                yield from table.to_batches(max_chunksize=5_000)

    return classes.mapInArrow(run, "block long, copy int, rep long, n long, raw binary")


def slack(length: int) -> float:
    """What a product of two unit vectors in single precision errs by at most: rounding of both sides and of each step of the sum."""
    return (length + 8) * 2.0**-23


class Block:
    """A block's members; meets chunks of rows and notes links."""

    def __init__(self, rep, n, x, threshold: float):
        self.rep, self.n, self.x, self.x32 = rep, n, x, x.astype(np.float32)
        self.links, self.label, self.threshold = np.zeros(len(rep), np.int64), rep.copy(), threshold
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(self, rep, n, x, start: int | None = None) -> np.ndarray:
        """Link members with the rows, which are the members from `start` on if that is given; the rows' numbers of links."""
        found = np.zeros(len(rep), np.int64)
        s = x.astype(np.float32) @ self.x32.T >= np.float32(self.threshold - slack(x.shape[1]))
        if start is not None:
            s &= np.arange(len(self.rep)) < (start + np.arange(len(rep)))[:, None]  # each pair of members once
        i, j = np.nonzero(s)
        parts = [k + np.flatnonzero((x[i[k : k + PAIRS]] * self.x[j[k : k + PAIRS]]).sum(1) >= self.threshold) for k in range(0, len(i), PAIRS)]
        if not parts or not (sure := np.concatenate(parts)).size:
            return found
        i, j = i[sure], j[sure]
        found += np.bincount(i, self.n[j], len(rep)).astype(np.int64)
        self.links += np.bincount(j, n[i], len(self.rep)).astype(np.int64)
        old, label = self.label.copy(), np.concatenate((self.label, rep if start is None else self.label[start : start + len(rep)]))
        i = i + len(self.rep) if start is None else i + start
        if start is not None:
            label = label[: len(self.rep)]
        before = label.copy()
        while True:
            low = np.minimum(label[i], label[j])
            if (low == label[i]).all() and (low == label[j]).all():
                break
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        nodes = np.concatenate((self.rep, rep)) if start is None else self.rep
        moved = label != before
        self.edges += [(nodes[moved], label[moved])]
        moved = label[: len(old)] != old  # what a label stood for before is linked with what it stands for now
        self.edges += [(old[moved], label[: len(old)][moved])]
        self.label = label[: len(self.rep)]
        return found


def link_blocks(dealt: DataFrame, threshold: float, dtype: str, parts: int) -> DataFrame:
    """a, b, links: rows with links count a's partners, rows with b say that a and b are in one component."""
    schema = arrow_schema("a long, b long, links long")

    def rows(a, b=None, links=None):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()) if links is None else pa.array(links, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, block = None, [], None

        def closed():
            """The gathered members as a block, compared with each other."""
            rep, n = np.concatenate([m[0] for m in members]), np.concatenate([m[1] for m in members])
            made = Block(rep, n, np.vstack([m[2] for m in members]), threshold)
            for k in range(0, len(rep), 1024):
                made.links[k : k + 1024] += made.meet(rep[k : k + 1024], n[k : k + 1024], made.x[k : k + 1024], k)
            return made

        def done(block):
            if block is not None:
                for a, b in block.edges:
                    if len(a):
                        yield rows(a, b)
                if (some := block.links > 0).any():
                    yield rows(block.rep[some], links=block.links[some])

        for batch in batches:
            ids, copy = batch.column("block").to_numpy(), batch.column("copy").to_numpy()
            rep, n, raw = batch.column("rep").to_numpy(), batch.column("n").to_numpy(), batch.column("raw").to_pylist()
            edges = np.flatnonzero((np.diff(ids) != 0) | (np.diff(copy) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                if lo == hi:
                    continue
                if ids[lo] != at:
                    if members:
                        block = closed()
                    yield from done(block)
                    at, members, block = ids[lo], [], None
                part = (rep[lo:hi], n[lo:hi], unit(raw[lo:hi], dtype))
                if copy[lo] == 0:
                    members.append(part)
                    continue
                if block is None:
                    block, members = closed(), []
                for k in range(0, hi - lo, 1024):
                    some = tuple(v[k : k + 1024] for v in part)
                    links = block.meet(*some)
                    if (hit := links > 0).any():
                        yield rows(some[0][hit], links=links[hit])
        if members:
            block = closed()
        yield from done(block)

    return dealt.repartition(parts, "block").sortWithinPartitions("block", "copy").mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    v = F.col(vector_col) if kind == "float" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("v", F.when(usable("v"), F.col("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("rep", F.coalesce("least", F.xxhash64("v"))))
    total = classes.count()
    longest = classes.agg(F.max(F.size("v"))).first()[0] or 1
    block = max(1, min(BLOCK, BLOCK_VALUES // longest))
    k = max(1, min(MAX_PIVOTS, MAX_PIVOT_VALUES // longest, math.ceil(total / block)))
    sample = [r.v for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(k).collect()]
    pivots = spark.sparkContext.broadcast(Pivots(sample))
    packed = classes.select("v", "rep", "n").mapInArrow(pack_raw(dtype), "rep long, n long, raw binary")
    sizes = cell_sizes(packed, pivots, dtype)
    dealt = deal(packed, pivots, sizes, math.sqrt(2 - 2 * threshold), dtype, block)
    found = stored(link_blocks(dealt, threshold, dtype, max(shuffle_partitions(spark), len(sizes))))
    member = components(found.where("b is not null").select("a", "b"))
    counts = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    joined = stored(classes.join(counts, "rep", "left").join(member, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")))
    ids = stored(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    of = stored(joined.join(ids, "component").select(F.col("v").alias("w"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    free(classes, found, joined, ids)
    own = F.coalesce("component_id", "vec_id")
    return rows.join(of, F.col("v") == F.col("w"), "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def pack_raw(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, ends = v.flatten().to_numpy().astype(dtype), v.offsets.to_numpy() - v.offsets[0].as_py()
            raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(raw, pa.binary())], names=["rep", "n", "raw"])

    return run


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


SQL1 = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.k AS ka, b.k AS kb, a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.95),
c(k, reach) AS (SELECT ka, kb FROM l UNION SELECT c.k, l.kb FROM c JOIN l ON l.ka = c.reach),
m AS (SELECT c.k, min(e.vec_id) AS low FROM c JOIN e ON e.k = c.reach GROUP BY c.k),
n AS (SELECT ka AS k, count(*) AS n_links FROM l GROUP BY ka)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, m.low) AS component_id, coalesce(e.vec_id = least(e.vec_id, m.low), true) AS kept
FROM e LEFT JOIN n ON e.k = n.k LEFT JOIN m ON e.k = m.k
"""
