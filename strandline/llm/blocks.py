"""Blocks of rows that a task holds while it streams the rows that are to meet them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import arrow_schema, shuffle_partitions

CHUNK = 256  # rows that meet a block at once
NO_ID = np.iinfo(np.int64).max  # stands for a null id where ids are compared: last


def numbers(length: str, rows: int, values: int) -> Column:
    """Rows of a block so that it holds at most `values` numbers."""
    return F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(values) / F.greatest(F.col(length), F.lit(1)))))


def sized(rows: DataFrame, keys: list[str], most: int, values: int) -> DataFrame:
    """keys, n, blocks: how many blocks the rows of a key are dealt into; keys hold `length`, the vectors' length."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / numbers("length", most, values)))


def home(uid: str = "uid") -> Column:
    """The block of a row among `blocks`."""
    return F.pmod(F.xxhash64(uid), F.col("blocks")).alias("block")


def each() -> Column:
    """All blocks."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")


def meetings(members: DataFrame, visitors: DataFrame, keys: list[str], build: Callable, meet: Callable, schema: str) -> DataFrame:
    """Both hold keys (longs, not null) and equal other columns. build(table) makes what a task holds of one block's members;
    meet(held, batch) takes at most CHUNK visitors of that block and gives the columns of schema, or None."""
    arrow, of = arrow_schema(schema), [*keys, "copy"]
    rows = members.withColumn("copy", F.lit(0)).unionByName(visitors.withColumn("copy", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered, held = None, [], None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in of]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if (key := tuple(c[lo] for c in cols[:-1])) != at:
                    at, gathered, held = key, [], None
                if not cols[-1][lo]:
                    gathered.append(batch.slice(lo, hi - lo))
                elif gathered or held is not None:
                    if held is None:
                        held, gathered = build(pa.Table.from_batches(gathered)), []
                    for k in range(lo, hi, CHUNK):
                        if (out := meet(held, batch.slice(k, min(CHUNK, hi - k)))) is not None:
                            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(out, arrow, strict=True)], schema=arrow)

    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, *keys).sortWithinPartitions(*of).mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """Vectors of equal length, packed as bytes, as rows."""
    raw = column.to_pylist()
    whole = b"".join(raw)
    return np.frombuffer(whole, dtype).reshape(len(raw), -1) if whole else np.zeros((len(raw), 0), dtype)


def ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as numbers that sort nulls last."""
    return column.fill_null(NO_ID).to_numpy()


def whole(column: np.ndarray) -> pa.Array:
    """Back from `ids`."""
    return pa.array(column, pa.int64(), mask=column == NO_ID)


def first_of(group: np.ndarray, value: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` first rows of each group, by value from the largest, then by tie from the smallest."""
    order = np.lexsort((tie, -value, group))
    g = group[order]
    new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    return order[np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) < most]
