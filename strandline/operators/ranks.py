"""Exact ranks of groups of any size: rows are put in order by ranges, so no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import stored


def medians(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, median: the exact median of a number in each group, the mean of the two middle ones if their count is even. NULL and
    NaN don't count, and groups of nothing else have no row; NULL is a key like any other.

    Equal values are counted where they are read, and the rest is dealt into ranges. A running count within each range,
    and what the ranges before hold, say which rows stand in the middle."""
    names = [f"_k{k}" for k in range(len(keys))]
    given = rows.select(*[F.col(c).alias(k) for c, k in zip(keys, names, strict=True)], F.col(value).cast("double").alias("_v"))
    counted = given.where("_v is not null and not isnan(_v)").groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = stored(counted.repartitionByRange(*names, "_v").select("*", F.spark_partition_id().alias("_part")))
    ranges = ranged.groupBy(*names, "_part").agg(F.sum("_n").alias("_m"))
    group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_m").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*[F.col(k).alias(f"{k}r") for k in names], F.col("_part").alias("_range"), before.alias("_before"), F.sum("_m").over(group).alias("_total"))
    within = Window.partitionBy("_part", *names).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("_part") == F.col("_range")
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}r"))
    placed = ranged.withColumn("_upto", F.sum("_n").over(within)).join(ranges, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    holds = lambda rank: ((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)).cast("int")
    weight = holds(F.floor((F.col("_total") + 1) / 2)) + holds(F.floor(F.col("_total") / 2) + 1)
    middle = placed.withColumn("_w", weight).where("_w > 0")
    return middle.groupBy(*names).agg(F.sum(F.col("_v") / 2 * F.col("_w")).alias("median")).select(*[F.col(k).alias(c) for c, k in zip(keys, names, strict=True)], "median")
