"""Filter interaction audit: what five filters remove, in every order they could be applied in.

A document fails a set of filters, its mask. Under an order it is removed at the first step whose filter is in that set, so
a mask is removed at a step by a filter in exactly the orders that start with some filters outside the mask and then that
one. In lexicographic order (Lehmer ranks) the orders with a common start are an interval. So

1. documents are counted by part and mask, the only step that grows with the input;
2. each mask's count is added where one of its intervals starts and taken away where it ends;
3. prefix sums over the ranks of the orders give what each step of each order removes, and the rest follows from it.

Filters, over whole texts (null: empty; words: runs of anything but space and 0x09-0x0D, unchanged):

A fewer than 200 words;  B distinct words under half of the words;  C capitals A-Z over 3 % of the code points;
D one of # $ % & * |;  E the same text as a document with a smaller id, in any part, removed or not.

Identical texts have one 256-bit digest. A document without an id is never a later copy nor an earlier one, and has no
labels. Rows that repeat an id are documents of their own and not copies of each other. A document is good (toxic) if any
of its label rows says so. Without documents there are no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import read, stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("removed", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone."""
    words = F.array_remove(F.split(text, SPACES), "")
    size, capitals = F.length(text), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {"A": F.size(words) < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * capitals > 3 * size, "D": text.rlike("[#$%&*|]")}


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each document; bit k of mask: it fails FILTERS[k]."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    seen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.col("text")).values())), F.lit(0))
    facts = stored(seen.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")))
    copies = stored(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    says = lambda c: F.max(F.coalesce(labels[c] == 1, F.lit(False))).alias({"quality": "good", "toxic": "toxic"}[c])
    said = stored(labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(says("quality"), says("toxic")))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    mask = F.col("own") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return facts.join(copies, "digest", "left").join(said, "doc_id", "left").select("part", mask.alias("mask"), flag("good"), flag("toxic"))


def rank(start: tuple[int, ...], n: int = len(FILTERS)) -> int:
    """Lexicographic rank of the first order of n filters that begins with start, by its Lehmer code."""
    return sum(sum(later < x for later in range(n) if later not in start[:k]) * factorial(n - 1 - k) for k, x in enumerate(start))


def intervals(n: int = len(FILTERS)) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step from 1, first rank, rank after the last) of the orders in which a mask is removed at a step by one filter."""
    for mask in range(1, 1 << n):
        outside, inside = [k for k in range(n) if not mask >> k & 1], [k for k in range(n) if mask >> k & 1]
        for step in range(1, len(outside) + 2):
            for before in permutations(outside, step - 1):
                for by in inside:
                    first = rank((*before, by), n)
                    yield mask, step, first, first + factorial(n - step)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (lang), order of the five filters and step: filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley."""
    spark, c = docs.sparkSession, F.col
    by_mask = stored(masks(docs, labels).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost")))
    removals = F.broadcast(spark.createDataFrame(list(intervals()), "mask int, step int, first int, after int"))
    orders = ["".join(x) for x in permutations(FILTERS)]
    names = F.broadcast(spark.createDataFrame(list(enumerate(orders)), "rank int, filter_order string"))
    ends = F.explode(F.array(*[F.struct(c(at).alias("rank"), *[(sign * c(x)).alias(x) for x in COUNTS]) for at, sign in (("first", 1), ("after", -1))])).alias("end")
    changes = by_mask.join(removals, "mask").select("part", "step", ends).select("part", "step", "end.*").groupBy("part", "rank", "step").agg(*[F.sum(x).alias(x) for x in COUNTS])
    fails = [F.sum(F.when(c("mask").bitwiseAND(1 << k) != 0, c("removed")).otherwise(0)) for k in range(len(FILTERS))]
    alone = [F.sum(F.when(c("mask") == 1 << k, c("removed")).otherwise(0)) for k in range(len(FILTERS))]
    parts = by_mask.groupBy("part").agg(F.sum("removed").alias("n"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    ranks = F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank")
    grid = parts.select("*", ranks).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = grid.join(changes, ["part", "rank", "step"], "left").join(names, "rank")
    steps = steps.withColumns({x: F.sum(F.coalesce(x, F.lit(0))).over(so_far) for x in COUNTS} | {"filter": F.substring("filter_order", c("step"), F.lit(1))})
    at = F.instr(F.lit(FILTERS), c("filter")) - 1
    until = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(
        "part", "filter_order", "step", (c("n") - F.sum("removed").over(until)).alias("kept"), "removed", (F.get("fails", at) - c("removed")).alias("redundant"), F.get("alone", at).alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: Masks from the texts, then every order by itself, without intervals.
SQL13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t FROM documents),
first AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w JOIN first USING (t)),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM o, range(1, 6) AS r(step)),
t AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (coalesce(before, 0) | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit <> 0 AND mask & coalesce(before, 0) = 0) AS removed,
  sum(n) FILTER (WHERE mask & bit <> 0 AND mask & coalesce(before, 0) <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
  sum(good) FILTER (WHERE mask & bit <> 0 AND mask & coalesce(before, 0) = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & coalesce(before, 0) = 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM t
"""
