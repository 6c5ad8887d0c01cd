"""Connected components by minimum labels with pointer jumping; nothing is gathered on the driver or in one group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.storage import free, gathered, stored


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for all nodes of links (a, b), longs.

    First a node with several smaller neighbours keeps its link to the least of them, and the others are linked to that
    one instead; nodes that share neighbours so share links, and few more links than nodes are left. Then every step takes
    the least label among neighbours and then the label of that label, so the number of steps grows with the logarithm of
    the longest path. Tables are written between steps: hubs and large components then meet plain shuffles, whose hot
    partitions Spark splits. All these joins merge: packed numbers take few bytes in files, so Spark would take large tables for small ones
    and send them through the driver. Few links are put into few tasks. Nulls and self-links are ignored; links may repeat; no links give no rows."""
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.distinct())
    count = links.count()
    if not count:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    few = lambda df: gathered(df, count)
    least = stored(few(links.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))))
    turned = few(links.join(least.where("n > 1").select("a", "least").hint("merge"), "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")))
    fewer = least.select("a", F.col("least").alias("b")).unionByName(turned)
    both = stored(few(fewer.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*").distinct()))
    free(links, least)
    labels = stored(few(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))))
    while True:
        near = few(both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b")).groupBy("a").agg(F.min("label").alias("near"))
        least = stored(few(labels.join(near.hint("merge"), F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))))
        done = least.where("label < old").isEmpty()
        if not done:
            free(labels)
            jump = least.select(F.col("node").alias("over"), F.col("label").alias("to"))
            labels = stored(few(least.join(jump.hint("merge"), F.col("label") == F.col("over")).select("node", F.least("label", "to").alias("label"))))
        free(least)
        if done:
            free(both)
            return labels.withColumnRenamed("label", "component")
