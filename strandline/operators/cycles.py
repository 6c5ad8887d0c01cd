"""Order along closed chains of rows, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.storage import free, stored


def cycles(links: DataFrame) -> DataFrame:
    """node, cycle (the chain's least node), at (steps from that node to this one), length, of links (node, next), longs. Every
    node has one next and is the next of one.

    A row knows the least node among the 2^k from it on, how far that is, and the node 2^k steps on. A step doubles k by one
    join. A row that finds the same least node again in the second half has seen its whole chain, and so its length. All rows of
    a chain find that within one step of each other, and leave: short chains cost few steps, the longest as many as its length
    has bits."""
    c, none = F.col, F.lit(None).cast("long")
    state, tables, span = links.select("node", c("next").alias("jump"), c("node").alias("least"), F.lit(0).cast("long").alias("far"), none.alias("length")), [], 1
    state = stored(state)
    first = state
    while True:
        on = state.select(c("node").alias("to"), c("jump").alias("jump2"), c("least").alias("least2"), c("far").alias("far2"), c("length").alias("length2"))
        joined = state.where("length is null").join(on.hint("merge"), c("jump") == c("to"))
        known, again, less = c("length2").isNotNull(), c("least2") == c("least"), c("least2") < c("least")
        far = F.when(known, F.pmod(c("far2") + span, c("length2"))).when(less, c("far2") + span).otherwise(c("far"))
        length = F.when(known, c("length2")).when(again, c("far2") + span - c("far"))
        state = stored(joined.select("node", c("jump2").alias("jump"), F.least("least", "least2").alias("least"), far.alias("far"), length.alias("length")))
        tables.append(state)
        span *= 2
        if state.where("length is null").isEmpty():
            break
    done = tables[0].where("length is not null")
    for table in tables[1:]:
        done = done.unionByName(table.where("length is not null"))
    out = stored(done.select("node", c("least").alias("cycle"), F.pmod(c("length") - c("far"), c("length")).alias("at"), "length"))
    free(first, *tables)
    return out
