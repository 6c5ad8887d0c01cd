import random
from itertools import permutations

import pytest

from strandline.llm import audit
from strandline.llm.queries import oracle_sql, queries
from tests.checking import assert_same

DOCS = "doc_id long, text string, lang string, mask int, part string, first long, n int"
LABELS = "doc_id long, quality int, toxic int, good boolean"


def brute(docs, labels):
    """Every order applied filter by filter to every document."""
    said = {}
    for doc, quality, toxic in labels:
        good, bad = said.get(doc, (False, False))
        said[doc] = (good or quality == 1, bad or toxic == 1)
    said.pop(None, None)
    failing = []
    for doc, text, lang in docs:
        t = text or ""
        words = t.encode().split()
        own = set()
        own |= {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * sum("A" <= x <= "Z" for x in t) > 3 * len(t) else set()
        own |= {"D"} if set(t) & set("#$%&*|") else set()
        own |= {"E"} if doc is not None and any(d is not None and d < doc and (u or "") == t for d, u, _ in docs) else set()
        failing.append((lang or "", own, *said.get(doc, (False, False))))
    out = {}
    for part in {p for p, *_ in failing}:
        own = [x[1:] for x in failing if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                fails = sum(f in x[0] for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def found(spark, docs, labels):
    got = audit.audit(spark.createDataFrame([(*d, 7, "x", 1, 2) for d in docs], DOCS), spark.createDataFrame([(*x, True) for x in labels], LABELS)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}


def test_audit_equals_its_sql(spark, data_dir):
    assert_same(queries()["op13_filter_audit"], oracle_sql()["op13_filter_audit"], spark, data_dir)


def test_audit_equals_brute_force_on_odd_rows(spark):
    rnd = random.Random(5)
    prose = lambda n, k: " ".join(f"w{rnd.randrange(k)}" for _ in range(n))
    texts = [None, "", " \t\n\x0b ", "A", "AB cd", "x | y", prose(250, 10**6), prose(250, 20), prose(199, 10**6), prose(200, 10**6) + " $", "É" * 100 + "ABC", "É" * 97 + "ABC", "a\x85b c　d", prose(20_000, 10**6), "word " * 30_000]
    docs = [(i, rnd.choice(texts), rnd.choice(["en", "fr", None, ""])) for i in range(120)] + [(3, texts[6], "en"), (3, texts[6], "de"), (None, texts[6], "en"), (None, "", None)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 124, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_audit_of_copies_that_are_a_third_of_all_rows(spark):
    docs = [(i, "the same" if i % 3 == 0 else f"text {i}", "en") for i in range(900)]
    got = found(spark, docs, [(i, 1, 0) for i in range(0, 900, 2)])
    assert got["en", "EABCD", 1] == [601, 299, 0, 0, 149, 0, 299 * 60]  # all are short, so half of the orders remove them as copies


@pytest.mark.parametrize("docs", [[], [(None, None, None)]])
def test_audit_of_nothing(spark, docs):
    assert found(spark, docs, []) == brute(docs, [])


def test_intervals_hold_each_order_once_for_each_mask():
    orders = list(permutations(range(5)))
    for mask in range(1, 32):
        held = [step for rank in range(120) for m, step, first, after in INTERVALS if m == mask and first <= rank < after]
        want = [next(k for k, f in enumerate(o, 1) if mask >> f & 1) for o in orders]
        assert held == want


INTERVALS = list(audit.intervals())


def test_ranks_are_lexicographic():
    assert [audit.rank(o) for o in permutations(range(5))] == list(range(120))
