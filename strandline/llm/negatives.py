"""Hard-negative mining by angular triangle filtering.

Vectors become whole numbers, floor(scale * x). A pair's score is the inner product of these. A bounded sample gives at
most REFERENCES reference directions; every row stores its norm and its angles to them. By the triangle inequality on the
sphere, the angle between two rows lies between |a - b| and min(a + b, 2 pi - a - b) for their angles a and b to any
reference; the cosines of these, times the norms, bound the score. Bounds are widened by SLACK for rounding, so no row is
lost to them.

1. Positives. Rows are dealt into blocks by label, sorted by nearest reference and angle, and cut into windows of WINDOW
   rows. An anchor visits its label's blocks; only windows whose upper bound reaches what some window surely holds are
   scored, in whole numbers. The blocks' first rows are ranked again.
2. Negatives. Rows are dealt into blocks by nearest reference. An anchor visits the blocks of those references whose
   bounds overlap the span from low % of its least positive score to its largest; there, only windows that overlap it
   are scored. A positive without a different-label row in its span gives no rows; so does one with a negative score.

Rows with a null label, a null vector, or any null or non-finite component take no part. Only vectors of equal length
meet. Rows without an id are never anchors and come last in ties; rows that repeat an id are rows of their own. Zero
vectors score 0. Numbers beyond 63 bits count as the largest or least that fit. An empty table gives an empty result;
other columns are not read. Where all angles are about equal, windows overlap nearly always, and the work is that of
all anchors against all rows, block by block; it stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.blocks import each, first_of, home, ids, matrix, meetings, sized, whole
from strandline.llm.common import arrow_schema, read, stored

SCALE, EVERY, POSITIVES, NEGATIVES, LOW = 256, 100, 5, 5, 80
REFERENCES = 16
SAMPLE, SAMPLE_VALUES = 2_048, 2_000_000  # rows, numbers that references are fitted on
BLOCK, BLOCK_VALUES = 8_192, 8_000_000  # rows, numbers that a task holds
WINDOW = 128
SLACK = 1e-6  # of an angle: arccos near 1 errs by the root of a double's last digit
NONE = np.iinfo(np.int64).min
ROW = "uid long, vec_id long, label long, length long, v binary, norm double, near long, angles array<double>"
OUT = "uid long, turn int, anchor_id long, positive_id long, positive_score long, other long, score long"


def references(sample: list[list[int]]) -> dict[int, np.ndarray]:
    """Unit vectors by vector length: the farthest-first choice of the sample's directions, each then moved to the mean of those nearest to it."""
    by: dict[int, list[list[int]]] = {}
    for v in sample:
        if any(v):
            by.setdefault(len(v), []).append(v)
    out = {}
    for length, rows in by.items():
        x = np.array(rows, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        at, best = [0], x @ x[0]
        while len(at) < min(REFERENCES, len(x)):
            at.append(int(best.argmin()))
            best = np.maximum(best, x @ x[at[-1]])
        mean = np.zeros((len(at), length))
        np.add.at(mean, (x @ x[at].T).argmax(1), x)
        size = np.linalg.norm(mean, axis=1, keepdims=True)
        out[length] = np.where(size > 1e-9, mean / np.maximum(size, 1e-9), x[at])
    return out


def measured(rows: DataFrame, sent) -> DataFrame:
    """ROW from uid, vec_id, label, v (whole numbers)."""
    arrow = arrow_schema(ROW)

    def run(batches):
        for batch in batches:
            vs, out = batch.column("v").to_pylist(), [[], [], [], []]
            for v in vs:
                x = np.array(v, np.int64)
                f = x.astype(np.float64)
                norm = float(np.sqrt((f * f).sum()))
                refs = sent.value.get(len(v))
                cos = np.zeros(0) if refs is None else refs @ f / (norm or 1)
                for col, value in zip(out, (x.astype("<i8").tobytes(), norm, int(cos.argmax()) if len(cos) else 0, np.arccos(np.clip(cos, -1, 1)).tolist()), strict=True):
                    col.append(value)
            cols = [batch.column("uid"), batch.column("vec_id"), batch.column("label"), [len(v) for v in vs], *out]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return rows.select("uid", "vec_id", "label", "v").mapInArrow(run, ROW)


def score_bounds(gap, far, norm, least, most):
    """Least and largest score of a norm with norms from least to most at angles from gap to far."""
    near, away = np.cos(np.maximum(0.0, gap - SLACK)), np.cos(np.minimum(np.pi, far + SLACK))
    slack = 1e-9 * norm * most + 1
    return norm * away * np.where(away >= 0, least, most) - slack, norm * near * np.where(near >= 0, most, least) + slack


def cell_bounds(refs: int = REFERENCES) -> tuple[Column, Column]:
    """The same over all rows of a cell, as columns: angles, norm of the anchor; lo, hi, least, most of the cell."""
    a, lo, hi = (lambda name: lambda k: F.get(name, F.lit(k)))("angles"), (lambda k: F.get("lo", F.lit(k))), (lambda k: F.get("hi", F.lit(k)))
    gap = F.greatest(F.lit(0.0), F.lit(0.0), *[F.greatest(a(k) - hi(k), lo(k) - a(k)) for k in range(refs)])
    far = F.least(F.lit(np.pi), F.lit(np.pi), *[F.least(a(k) + hi(k), 2 * np.pi - a(k) - lo(k)) for k in range(refs)])
    near, away = F.cos(F.greatest(F.lit(0.0), gap - SLACK)), F.cos(F.least(F.lit(np.pi), far + SLACK))
    c, slack = F.col, 1e-9 * F.col("norm") * F.col("most") + 1
    return c("norm") * away * F.when(away >= 0, c("least")).otherwise(c("most")) - slack, c("norm") * near * F.when(near >= 0, c("most")).otherwise(c("least")) + slack


def products(a: np.ndarray, b: np.ndarray, size: float) -> np.ndarray:
    """Exact inner products; size bounds the product of two norms. Every partial sum is at most that, so doubles are exact up to 2^53."""
    if size < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    top = np.iinfo(np.int64).max
    return np.clip(a.astype(object) @ b.T.astype(object), -top, top).astype(np.int64)


class Windows:
    """A block's rows in the order of their angles, with the bounds of each window."""

    def __init__(self, table: pa.Table):
        near, angles = table["near"].to_numpy(), np.array(table["angles"].to_pylist(), np.float64)
        own = angles[np.arange(len(near)), near] if angles.shape[1] else np.zeros(len(near))
        order = np.lexsort((own, near))
        self.v, self.angles, self.norm = matrix(table["v"], "<i8")[order], angles[order], table["norm"].to_numpy()[order]
        self.uid, self.id, self.label = table["uid"].to_numpy()[order], ids(table["vec_id"].combine_chunks())[order], table["label"].to_numpy()[order]
        self.starts = np.arange(0, len(order), WINDOW)
        self.sizes = np.diff(np.append(self.starts, len(order)))
        self.lo, self.hi = np.minimum.reduceat(self.angles, self.starts), np.maximum.reduceat(self.angles, self.starts)
        self.least, self.most = np.minimum.reduceat(self.norm, self.starts), np.maximum.reduceat(self.norm, self.starts)

    def bounds(self, angles: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each visitor with each window."""
        gap, far = np.zeros((len(norm), len(self.starts))), np.full((len(norm), len(self.starts)), np.pi)
        for k in range(angles.shape[1]):
            a = angles[:, k, None]
            gap = np.maximum(gap, np.maximum(a - self.hi[:, k], self.lo[:, k] - a))
            far = np.minimum(far, np.minimum(a + self.hi[:, k], 2 * np.pi - a - self.lo[:, k]))
        return score_bounds(gap, far, norm[:, None], self.least, self.most)

    def scores(self, v: np.ndarray, norm: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        """Scores in the windows that overlap, NONE elsewhere."""
        out = np.full((len(v), len(self.v)), NONE)
        for w in np.flatnonzero(overlap.any(0)):
            at = slice(self.starts[w], self.starts[w] + self.sizes[w])
            some = np.flatnonzero(overlap[:, w])
            out[some, at] = products(v[some], self.v[at], norm[some].max() * self.most[w])
        return out


def visitors_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return matrix(batch.column("v"), "<i8"), np.array(batch.column("angles").to_pylist(), np.float64), batch.column("norm").to_numpy()


def best_positives(k: int):
    def meet(held: Windows, batch: pa.RecordBatch):
        v, angles, norm = visitors_of(batch)
        low, high = held.bounds(angles, norm)
        sure = np.where(held.sizes > k, low, -np.inf).max(1)  # a window of k rows beside the anchor itself
        s = held.scores(v, norm, high >= sure[:, None])
        s[batch.column("uid").to_numpy()[:, None] == held.uid] = NONE
        kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        i, j = np.nonzero((s >= kth[:, None]) & (s > NONE))
        keep = first_of(i, s[i, j], held.id[j], k)
        i, j = i[keep], j[keep]
        return batch.column("uid").take(pa.array(i)), whole(held.id[j]), s[i, j], held.uid[j]

    return meet


def best_negatives(k: int, low: int):
    def meet(held: Windows, batch: pa.RecordBatch):
        v, angles, norm = visitors_of(batch)
        wanted = batch.column("positives").to_pylist()
        at = [(i, p["turn"], p["positive_id"], p["score"]) for i, own in enumerate(wanted) for p in own]
        least = [-(-low * p[3] // 100) for p in at]  # low * positive <= 100 * negative
        row, top, floor = np.array([p[0] for p in at]), np.array([p[3] for p in at], np.int64), np.array(least, np.int64)
        bottom, roof = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), NONE)
        np.minimum.at(bottom, row, floor)
        np.maximum.at(roof, row, top)
        lowest, highest = held.bounds(angles, norm)
        s = held.scores(v, norm, (highest >= bottom[:, None]) & (lowest <= roof[:, None]))
        s[batch.column("label").to_numpy()[:, None] == held.label] = NONE
        i, j = np.nonzero((s >= bottom[:, None]) & (s <= roof[:, None]) & (s > NONE))
        found = []
        for n, (r, high, deep) in enumerate(zip(row, top, floor, strict=True)):
            mine = j[np.searchsorted(i, r) : np.searchsorted(i, r, "right")]
            own = s[r, mine]
            mine, own = mine[(own >= deep) & (own <= high)], own[(own >= deep) & (own <= high)]
            keep = first_of(np.zeros(len(mine), int), own, held.id[mine], k)
            found.append((np.full(len(keep), n), mine[keep], own[keep]))
        if not found or not (n := np.concatenate([f[0] for f in found])).size:
            return None
        j, score = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        take = pa.array(row[n])
        return batch.column("uid").take(take), [at[x][1] for x in n], batch.column("vec_id").take(take), [at[x][2] for x in n], top[n], whole(held.id[j]), score

    return meet


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, block: int = BLOCK) -> DataFrame:
    """For each anchor (id divisible by `every`) and each of its first `positives` rows of the same label: the first
    `negatives` rows of other labels that score from low % of the positive's score up to it. anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score."""
    spark, c = vectors.sparkSession, F.col
    v = c(vector_col).cast("array<double>")
    rows = vectors.select(c(id_col).cast("long").alias("vec_id"), c(label_col).cast("long").alias("label"), v.alias("x"))
    rows = rows.where(c("label").isNotNull() & c("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = stored(rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"), F.monotonically_increasing_id().alias("uid")))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = [r.v for r in rows.orderBy(F.xxhash64("uid"), "uid").limit(max(1, min(SAMPLE, SAMPLE_VALUES // max(1, longest)))).collect()]
    known = stored(measured(rows, spark.sparkContext.broadcast(references(sample))))
    anchors = known.where(c("vec_id") % every == 0)

    labels = stored(sized(known, ["length", "label"], block, BLOCK_VALUES))
    keys = ["length", "label", "block"]
    first = meetings(known.join(labels, ["length", "label"]).select(*known.columns, home()), anchors.join(labels, ["length", "label"]).select(*known.columns, each()), keys, Windows, best_positives(positives), "uid long, positive_id long, score long, other long")
    turn = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "other")).alias("turn")
    chosen = stored(first.select("*", turn).where(c("turn") <= positives))

    span = chosen.where("score >= 0").groupBy("uid").agg(F.collect_list(F.struct("turn", "positive_id", "score")).alias("positives"), (F.min("score") * (low / 100)).alias("bottom"), F.max("score").alias("roof"))
    ends = lambda f, name: F.array(*[f(F.get("angles", F.lit(k))) for k in range(REFERENCES)]).alias(name)
    cells = sized(known, ["length", "near"], block, BLOCK_VALUES).drop("n").join(known.groupBy("length", "near").agg(ends(F.min, "lo"), ends(F.max, "hi"), F.min("norm").alias("least"), F.max("norm").alias("most")), ["length", "near"])
    cells = stored(cells.withColumnRenamed("near", "cell"))
    lowest, highest = cell_bounds()
    asked = anchors.join(span, "uid").join(cells, "length").where((highest >= c("bottom")) & (lowest <= c("roof")))
    members = known.withColumn("cell", c("near")).join(cells.select("length", "cell", "blocks"), ["length", "cell"])
    members = members.select(*known.columns, "cell", home(), F.lit(None).cast("array<struct<turn: int, positive_id: bigint, score: bigint>>").alias("positives"))
    found = meetings(members, asked.select(*known.columns, "cell", each(), "positives"), ["length", "cell", "block"], Windows, best_negatives(negatives, low), OUT)
    rank = F.row_number().over(Window.partitionBy("uid", "turn").orderBy(F.desc("score"), F.asc_nulls_last("other"))).alias("rank")
    return found.select("*", rank).where(c("rank") <= negatives).select("anchor_id", "positive_id", "rank", c("other").alias("negative_id"), "positive_score", c("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL12 = """
WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS x FROM embeddings),
v AS (SELECT k, vec_id, label, list_transform(x, lambda y: floor(256 * y)) AS v FROM e WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
s AS (SELECT a.k AS ka, a.vec_id AS anchor_id, b.k AS kb, b.vec_id AS other, a.label = b.label AS same, CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) END::BIGINT AS score FROM v a JOIN v b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT ka, anchor_id, kb AS kp, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ka ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ka, kp ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.ka = s.ka AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY row_number() OVER (PARTITION BY p.ka, kp ORDER BY score DESC, other) <= 5
"""
