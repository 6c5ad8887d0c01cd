"""Counting the words of a bucket's texts by products of their levels, and the steps of small components."""

import numpy as np

from strandline.llm import near_text
from strandline.operators.graph import components


def test_levels_never_count_fewer_words_than_texts_share():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, top, n).astype("<u4") for top, n in ((40, 90), (40, 100), (4, 3000), (4, 2900), (5000, 120), (5000, 130))]
    levels, rest = near_text.levels_of(np.stack([near_text.bags(t) for t in texts]))
    most = levels @ levels.T + np.minimum.outer(rest, rest)
    for i, x in enumerate(texts):
        for j in set(range(len(texts))) - {i}:
            shared = len(np.intersect1d(near_text.occurrences(x.tobytes()), near_text.occurrences(texts[j].tobytes())))
            assert most[i, j] >= shared  # also where a class has over 255 words
    assert most[4, 5] < 0.8 * 130  # and it rules out texts that are far apart


def test_keys_had_before_are_those_that_two_texts_share():
    keys = np.empty(3, object)
    keys[:] = [np.array([1, 5, 9]), np.array([5, 7, 9]), np.array([1, 8, 9])]
    had = near_text.had_before(keys, 9)
    assert (had @ had.T > 0).tolist() == [[True, True, True], [True, True, False], [True, False, True]]
    assert near_text.had_before(keys, 1).shape == (3, 0)


def test_small_components_are_written_by_few_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(k, k + 1) for k in range(200) if k % 10 != 9], "a long, b long")
        found = components(links)
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {(r.node, r.component) for r in found.collect()} == {(k, k // 10 * 10) for k in range(200)}
        assert components(links.where("a < 0")).collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
