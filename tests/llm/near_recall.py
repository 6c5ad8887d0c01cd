"""Recall of near-duplicate detection on pairs that are near by its definition; `python -m tests.llm.near_recall` prints it.

A case is (words of a text, words replaced at random, words of a passage that all texts start with and no edit touches), and
how many texts share a passage, if not all."""

import random

from strandline.llm import near_text

CASES = [(10, 2, 0), (20, 4, 0), (25, 5, 0), (30, 6, 0), (50, 10, 0), (100, 20, 0), (120, 18, 60, 16), (120, 18, 60, 18), (100, 19, 0), (1000, 190, 0), (100, 15, 0), (120, 18, 60), (380, 40, 300), (50, 5, 0)]


def recall(spark, case: tuple[int, ...], pairs: int) -> tuple[int, int]:
    """Pairs that ended in one group, and all pairs."""
    words, edits, shared, sharing = (*case, 2 * pairs)[:4]
    rnd = random.Random(words * 1000 + edits)
    own = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(pairs):
        if 2 * k % sharing == 0:
            passage = own(shared)
        x = own(words - shared)
        y = list(x)
        for at in rnd.sample(range(len(x)), edits):
            y[at] = own(1)[0]
        rows += [(2 * k, " ".join(passage + x)), (2 * k + 1, " ".join(passage + y))]
    groups = {r.doc_id: r.group_id for r in near_text.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(g // 2 == d // 2 for d, g in groups.items()), "unlike texts stay apart"
    return sum(groups[2 * k + 1] == 2 * k for k in range(pairs)), pairs


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    for one in CASES:
        print(one, *recall(session, one, 500))
