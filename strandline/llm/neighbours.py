"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are dealt into blocks of at most BLOCK; a task holds one block's forest, and every query visits the blocks of its
vector length. A forest has TREES trees. A tree gives each different vector a string of BITS sign bits, of random planes
drawn in an order of its own from a pool of PLANES, and is the sorted array of these strings. Inner products become angles
by one more component that fills vectors up to the block's longest.

1. Descend: in every tree, the query's longest common prefix with a string stands beside its place in the sorted array.
2. Ascend: from the longest of these, all trees shorten the prefix together, one bit at a time. The strings with that
   prefix are a range of the array. It goes on until TREES times the median range holds CANDIDATES strings, or the prefix
   is empty; the median, so that a crowd of near copies that shares a prefix in a few trees doesn't end it early.
3. All vectors in these ranges are candidates, none are cut off. They are ranked by single precision products; what may
   be among the first, by its rounding bound, is scored in double precision.

Each block's first rows are ranked again. Equal vectors are one string, so copies take no other's place; of a vector, only
the smallest ids can be among the first. Nothing is fitted: planes depend on vector length and SEED only.

Measured recall is in the README; it is least where all vectors are about equally far apart. Vectors that are null, empty,
zero or hold null or non-finite components take no part. Vectors of different lengths never meet. Rows without an id are
candidates, last in ties, never queries; rows that repeat an id are rows of their own, and each is the other's candidate. An
empty table gives an empty result; other columns are not read. Products that overflow a double count as its largest.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.blocks import each, first_of, home, ids, matrix, meetings, sized, whole
from strandline.llm.common import arrow_schema, read, stored
from strandline.llm.embeddings import usable

NEAREST, EVERY = 20, 20
TREES, BITS, PLANES, SEED = 128, 32, 512, 7
CANDIDATES = 3_500
BLOCK, BLOCK_VALUES = 8_192, 8_000_000  # rows, numbers that a task holds


@cache
def planes(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The pool's planes for vectors with one more component, and each tree's order of them."""
    rnd = np.random.default_rng((SEED, length))
    return rnd.standard_normal((PLANES, length + 1), np.float32), np.array([rnd.permutation(PLANES)[:BITS] for _ in range(TREES)])


def strings(x: np.ndarray) -> np.ndarray:
    """Hash strings of rows (unit vectors with the additional component), a row for each tree."""
    pool, order = planes(x.shape[1] - 1)
    bits = x.astype(np.float32) @ pool.T > 0
    return np.stack([np.ascontiguousarray(np.packbits(bits[:, o], axis=1)).view(">u4").ravel().astype(np.uint32) for o in order])


def prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


class Forest:
    def __init__(self, table: pa.Table, dtype: str):
        raw = table["v"].to_pylist()
        place: dict[bytes, int] = {}
        group = np.array([place.setdefault(r, len(place)) for r in raw])
        self.x = matrix(pa.chunked_array([pa.array(list(place), pa.binary())]), dtype).astype(np.float64)
        self.scale = np.abs(self.x).max()
        x = self.x / self.scale
        size = np.sqrt((x * x).sum(1))
        self.longest = size.max()
        x /= self.longest
        self.x32 = x.astype(np.float32)
        self.keys = strings(np.concatenate((x, np.sqrt(np.maximum(0, 1 - (size / self.longest) ** 2))[:, None]), 1))
        self.order = np.argsort(self.keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(self.keys, self.order.astype(np.int64), 1)
        uid, vec = table["uid"].to_numpy(), ids(table["vec_id"].combine_chunks())
        at = np.lexsort((uid, vec, group))
        self.uid, self.vec, self.starts = uid[at], vec[at], np.searchsorted(group[at], np.arange(len(place) + 1))

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and after last place in each tree of what the queries (hash strings, a row for each tree) reach."""
        n = self.keys.shape[1]
        at = np.stack([np.searchsorted(k, x) for k, x in zip(self.keys, q, strict=True)])
        beside = [np.take_along_axis(self.keys, np.clip(at + d, 0, n - 1), 1) for d in (-1, 0)]
        deepest = np.maximum(*(prefix(b, q) for b in beside)).max(0)
        lo, hi, left = np.zeros_like(at), np.full_like(at, n), np.arange(q.shape[1])
        for length in range(int(deepest.max()), 0, -1):  # the empty prefix reaches all
            some = left[deepest[left] >= length]
            if not len(some):
                continue
            rest = np.uint32((1 << (BITS - length)) - 1)
            a = np.stack([np.searchsorted(k, x & ~rest) for k, x in zip(self.keys, q[:, some], strict=True)])
            b = np.stack([np.searchsorted(k, x | rest, "right") for k, x in zip(self.keys, q[:, some], strict=True)])
            wide = np.median(b - a, axis=0) * TREES >= CANDIDATES
            lo[:, some[wide]], hi[:, some[wide]] = a[:, wide], b[:, wide]
            left = np.setdiff1d(left, some[wide], assume_unique=True)
            if not len(left):
                break
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The different vectors in one query's ranges."""
        mark = np.zeros(len(self.x), bool)
        for order, a, b in zip(self.order, lo.tolist(), hi.tolist(), strict=True):
            mark[order[a:b]] = True
        return np.flatnonzero(mark)

    def nearest(self, q: np.ndarray, uid: int, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """vec, uid and score of the k first rows among the vectors found, but the query's own."""
        size = np.abs(q).max()
        unit = q / size
        unit /= np.sqrt((unit * unit).sum())
        s = self.x32[found] @ unit.astype(np.float32)
        if len(found) > k + 1:  # the query's own vector may have no other row
            least = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
            found = found[s >= least - (len(q) + 8) * 2.0**-21]
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.nan_to_num((self.x[found] * q).sum(1))
        found, s = (v[np.argsort(-s, kind="stable")] for v in (found, s))
        if len(found) > k + 1:
            keep = s >= s[k]
            found, s = found[keep], s[keep]
        # of a vector, the k + 1 smallest ids, as one may be the query's
        count = np.minimum(self.starts[found + 1] - self.starts[found], k + 1)
        at = np.repeat(self.starts[found] - np.cumsum(count) + count, count) + np.arange(count.sum())
        s, at = np.repeat(s, count)[self.uid[at] != uid], at[self.uid[at] != uid]
        keep = first_of(np.zeros(len(at), int), s, self.vec[at], k)
        return self.vec[at[keep]], self.uid[at[keep]], s[keep]


def visit(k: int, dtype: str):
    def meet(held: Forest, batch: pa.RecordBatch):
        q, uid = matrix(batch.column("v"), dtype).astype(np.float64), batch.column("uid").to_numpy()
        unit = q / np.abs(q).max(1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        lo, hi = held.ranges(strings(np.concatenate((unit, np.zeros((len(q), 1))), 1)))
        out = [held.nearest(q[i], uid[i], held.candidates(lo[:, i], hi[:, i]), k) for i in range(len(q))]
        of = pa.array(np.repeat(np.arange(len(q)), [len(o[0]) for o in out]))
        vec, other, score = (np.concatenate([o[c] for o in out]) for c in range(3))
        return batch.column("uid").take(of), batch.column("vec_id").take(of), whole(vec), other, score

    return meet


def packed(rows: DataFrame, dtype: str) -> DataFrame:
    """uid, vec_id, length, v with vectors as bytes."""
    arrow = arrow_schema("uid long, vec_id long, length long, v binary")

    def run(batches):
        for batch in batches:
            v = [np.array(x, dtype) for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), pa.array([len(x) for x in v], pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], schema=arrow)

    return rows.select("uid", "vec_id", "v").mapInArrow(run, "uid long, vec_id long, length long, v binary")


def nearest_neighbours(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by `every`, the k rows with the largest inner product."""
    kind, c = vectors.schema[vector_col].dataType.elementType.simpleString(), F.col
    dtype = "<f4" if kind == "float" else "<f8"
    v = c(vector_col) if kind == "float" else c(vector_col).cast("array<double>")
    rows = vectors.select(c(id_col).cast("long").alias("vec_id"), v.alias("v")).where(usable("v")).withColumn("uid", F.monotonically_increasing_id())
    rows = stored(packed(rows, dtype))
    dealt = rows.join(stored(sized(rows, ["length"], block, BLOCK_VALUES)), "length")
    members, queries = dealt.select(*rows.columns, home()), dealt.where(c("vec_id") % every == 0).select(*rows.columns, each())
    found = meetings(members, queries, ["length", "block"], lambda table: Forest(table, dtype), visit(k, dtype), "uid long, query_id long, vec_id long, other long, score double")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")).alias("rank")
    return found.select("*", rank).where(c("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))
