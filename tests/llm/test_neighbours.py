import math
import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import neighbours
from strandline.llm.common import read
from strandline.llm.queries import queries

VECTORS = "vec_id long, embedding array<double>, uid string, rank int, score string, length int"


def brute(rows, k=neighbours.NEAREST, every=neighbours.EVERY):
    use = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (query, q) in enumerate(use):
        if query is None or query % every:
            continue
        near = sorted((-float((q * w).sum()), math.inf if i is None else i, i) for m, (i, w) in enumerate(use) if m != n and len(w) == len(q))
        out += [(query, r, i, -s) for r, (s, _, i) in enumerate(near[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, **options):
    got = neighbours.nearest_neighbours(spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in rows], VECTORS), **options).collect()
    return sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in got], key=repr)


def recall(got, want):
    at = {(q, i) for q, _, i, _ in got}
    return sum((q, i) in at for q, _, i, _ in want) / len(want)


def test_neighbours_equal_brute_force_over_the_given_table(spark, data_dir):
    rows = [(r.vec_id, r.embedding) for r in read(spark, data_dir, "embeddings").collect()]
    got = queries()["op11_neighbours"](spark, data_dir).collect()
    want = brute(rows)
    assert recall([tuple(r) for r in got], want) >= 0.99
    scores = {(q, i): s for q, _, i, s in want}
    assert all(math.isclose(r.score, scores[r.query_id, r.vec_id], abs_tol=1e-12) for r in got if (r.query_id, r.vec_id) in scores)


@pytest.mark.parametrize("kind", ["unstructured", "norms", "clusters"])
def test_recall_over_several_blocks(spark, kind):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(16_000, 48))
    if kind == "norms":
        x *= rnd.lognormal(0, 0.5, size=(len(x), 1))
    if kind == "clusters":  # a third of all rows are near copies of one vector
        x[::3] = x[0] + 0.02 * rnd.normal(size=x[::3].shape)
    rows = list(enumerate(x.tolist()))
    got = found(spark, rows, every=400)
    s = x[::400] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 400)] = -np.inf
    want = {(400 * i, j) for i, j in zip(*np.nonzero(s >= np.sort(s, 1)[:, -20, None]), strict=True)}
    assert len(got) == 20 * len(s)
    assert len(want & {(q, i) for q, _, i, _ in got}) / len(want) >= 0.9


def test_neighbours_of_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.randrange(-9, 9) + 1.0 for _ in range(3)]) for i in range(60)] + [(60, None), (80, [1.0, None, 2.0]), (100, [math.nan, 0.0, 1.0]), (120, [0.0, 0.0, 0.0]), (140, []), (160, [math.inf, 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (20, rows[20][1]), (20, [3.0, 3.0, 3.0]), (180, [5.0]), (200, [6.0, 1.0]), (201, [2.0, 2.0])]
    assert found(spark, rows, k=7) == brute(rows, 7)
    assert found(spark, rows, k=100, block=16) == brute(rows, 100)


def test_copies_keep_their_smallest_ids(spark):
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [math.cos(i), math.sin(i)]) for i in range(900)]
    assert found(spark, rows, block=100) == brute(rows)


def test_large_numbers_and_nothing(spark):
    assert found(spark, []) == []
    got = found(spark, [(0, [1e200, 1e200]), (1, [1e200, 1e190]), (2, [-1e200, 0.0])])
    assert [(r, i) for _, r, i, _ in got] == [(1, 1), (2, 2)] and got[0][3] == np.finfo(float).max


def test_ranges_are_the_longest_prefixes_that_hold_enough():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(3_000, 12))
    table = pa.table({"uid": np.arange(3000), "vec_id": np.arange(3000), "v": pa.array([v.astype("<f8").tobytes() for v in x], pa.binary())})
    held = neighbours.Forest(table, "<f8")
    unit = x[:5] / np.linalg.norm(x[:5], axis=1, keepdims=True)
    q = neighbours.strings(np.concatenate((unit, np.zeros((5, 1))), 1))
    lo, hi = held.ranges(q)
    own = np.zeros_like(held.keys)
    np.put_along_axis(own, held.order.astype(np.int64), held.keys, 1)  # strings by vector
    for i in range(5):
        same = neighbours.prefix(own, q[:, i, None])
        sizes = [np.median((same >= n).sum(1)) * neighbours.TREES for n in range(neighbours.BITS + 1)]
        length = max(n for n in range(neighbours.BITS + 1) if sizes[n] >= neighbours.CANDIDATES)
        assert held.candidates(lo[:, i], hi[:, i]).tolist() == np.flatnonzero((same >= length).any(0)).tolist()
