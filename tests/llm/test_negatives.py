import math
import random

import numpy as np
import pytest

from strandline.llm import negatives
from strandline.llm.queries import oracle_sql, queries
from tests.checking import assert_same

VECTORS = "vec_id long, embedding array<double>, label int, uid string, v int, norm string"


def brute(rows, every=negatives.EVERY):
    """Every anchor against every row, in whole Python numbers."""
    last = lambda i: math.inf if i is None else i
    use = [(i, [math.floor(negatives.SCALE * x) for x in v], label) for i, v, label in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (anchor, v, label) in enumerate(use):
        if anchor is None or anchor % every:
            continue
        seen = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), last(i), i, other) for m, (i, w, other) in enumerate(use) if m != n and len(w) == len(v)), key=lambda s: s[:2])
        for score, _, positive, _ in [s for s in seen if s[3] == label][:5]:
            fit = [s for s in seen if s[3] != label and 80 * -score <= 100 * -s[0] <= 100 * -score]
            out += [(anchor, positive, k, s[2], -score, -s[0]) for k, s in enumerate(fit[:5], 1)]
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], VECTORS)
    got = negatives.hard_negatives(df, **options).collect()
    return sorted([(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got], key=repr)


def some(rnd, n, dim, labels, spread=1.0):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rnd.randrange(labels)
        base = centres[rnd.randrange(labels)]
        out.append((i, [b + spread * rnd.gauss(0, 1) for b in base], label))
    return out


def test_negatives_equal_their_sql(spark, data_dir):
    assert_same(queries()["op12_hard_negatives"], oracle_sql()["op12_hard_negatives"], spark, data_dir)


@pytest.mark.parametrize(("spread", "block"), [(1.0, 8192), (0.05, 64), (0.3, 200)])
def test_negatives_equal_brute_force(spark, spread, block):
    rows = some(random.Random(int(spread * 100)), 900, 8, 4, spread)
    assert found(spark, rows, block=block, every=20) == brute(rows, 20)


def test_negatives_of_odd_rows(spark):
    rnd = random.Random(3)
    rows = some(rnd, 200, 3, 3) + [(200, None, 1), (300, [1.0, None, 2.0], 1), (400, [1.0, math.nan, 0.0], 1), (500, [math.inf, 0.0, 0.0], 1), (600, [1.0, 2.0, 3.0], None), (700, [], 1), (701, [], 1), (702, [], 2)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 2), (800, [0.0, 0.0, 0.0], 1), (801, [0.0, 0.0, 0.0], 2), (802, [-0.0, 0.0, 0.0], 1)]
    rows += [(100, rows[100][1], 1), (100, rows[100][1], 2), (900, [1.0, 2.0], 1), (901, [2.0, 1.0], 1), (902, [1.5, 1.5], 2), (1000, [1e6, -1e6, 3e5], 1), (1001, [9e5, -9e5, 2e5], 1), (1002, [8.7e5, -9e5, 2e5], 2)]
    assert found(spark, rows, every=20) == brute(rows, 20)


def test_negatives_of_a_vector_that_is_a_third_of_all_rows(spark):
    rnd = random.Random(4)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(3)], rnd.randrange(2)) for i in range(600)]
    assert found(spark, rows, block=50) == brute(rows)


def test_negatives_of_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []


def test_bounds_hold_every_score():
    rnd = np.random.default_rng(1)
    v = (rnd.normal(size=(400, 6)) * 200).astype(np.int64)
    v[:200] = v[0] + rnd.integers(-5, 5, (200, 6))
    refs = negatives.references(v.tolist())[6]
    norm = np.linalg.norm(v, axis=1)
    angles = np.arccos(np.clip(v @ refs.T / norm[:, None], -1, 1))
    low, high = negatives.score_bounds(np.abs(angles[:, None] - angles).max(2), np.minimum(angles[:, None] + angles, 2 * np.pi - angles[:, None] - angles).min(2), norm[:, None], norm, norm)
    s = v @ v.T
    assert (low <= s).all() and (s <= high).all() and (high - low < 0.5 * norm[:, None] * norm).mean() > 0.2


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2**40, 1]]), np.array([[2**20, 3], [2**30, 0]])
    assert negatives.products(a, b, 2.0**70).tolist() == [[2**60 + 3, np.iinfo(np.int64).max]]
