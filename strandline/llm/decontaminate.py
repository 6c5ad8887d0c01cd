"""Benchmark decontamination: a broadcast set of normalised test n-grams against all document windows.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A window
is `width` consecutive words of an item; an item of fewer words, but not none, is one window.

Windows are cut, made distinct and counted in Spark. The set is broadcast only in blocks of about `max_windows`
windows of WINDOW_BYTES bytes; a larger benchmark is worked through block by block and the hits of all blocks, found on
the uncut text, are merged for each document.

Nulls and texts without words have no hits; items without words are never found; items without an id are found and
cut like any other but not named or counted; repeated items are one; repeated rows count each on its own; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import arrow_schema, id_text, per_document, read, stored

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WIDTH = 10
MAX_WINDOWS = 500_000
WINDOW_BYTES = 200
MAX_SPAN_SHARE = 0.5


def words(text: str | None) -> list[bytes]:
    """bytes.lower() touches A-Z only, and UTF-8 bytes beyond ASCII are in the word class as their characters are."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def items_of(rows: Iterable[tuple[list[bytes], list[int]]]) -> dict:
    """{'words': word -> number, 'windows': tuple of numbers -> item ids, 'widths': sorted widths} of (window, item ids)"""
    numbers: dict[bytes, int] = {}
    windows: dict[tuple, set] = defaultdict(set)
    for window, items in rows:
        windows[tuple(numbers.setdefault(x, len(numbers)) for x in window)].update(items)
    return {"words": numbers, "windows": {k: sorted(v) for k, v in windows.items()}, "widths": sorted({len(k) for k in windows})}


def cut_windows(text: str | None, width: int) -> list[list[bytes]]:
    w = words(text)
    k = min(width, len(w))
    return [w[i : i + k] for i in range(len(w) - k + 1)] if w else []


def windows_of(items: list[tuple[int | None, str | None]], width: int) -> dict:
    """The set of some items' windows; an item without an id is found but not named."""
    return items_of((w, [] if item is None else [item]) for item, text in items for w in cut_windows(text, width))


def hits(doc: list[bytes], bench: dict) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged [start, end) word ranges inside any occurrence, and the items found. A window can only
    lie where all its words are benchmark words, so only such runs are looked at."""
    get, windows = bench["words"].get, bench["windows"]
    ids = [get(w, -1) for w in doc]
    found: list[tuple[int, int]] = []
    items: set[int] = set()
    widths = bench["widths"]
    if not widths:
        return found, items
    least, n, i = widths[0], len(ids), 0
    while i < n:
        if ids[i] < 0:
            i += 1
            continue
        j = i
        while j < n and ids[j] >= 0:
            j += 1
        if j - i >= least:
            for a in range(i, j - least + 1):
                for k in widths:
                    if a + k > j:
                        break
                    if (got := windows.get(tuple(ids[a : a + k]))) is not None:
                        items.update(got)
                        if found and a <= found[-1][1]:
                            found[-1] = (found[-1][0], max(found[-1][1], a + k))
                        else:
                            found.append((a, a + k))
        i = j
    return found, items


def benchmark_windows(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """part, window (words joined by a space), item: all different windows of all items, cut in the tasks."""
    schema = arrow_schema("item long, window binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = sorted({b" ".join(w) for w in cut_windows(text, width)})
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.int64()), pa.array(part, pa.binary())], schema=schema)

    rows = benchmark.select(benchmark[id_col].cast("long").alias("item"), benchmark[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "item long, window binary").distinct()


def blocks_of(benchmark: DataFrame, width: int, max_windows: int, id_col: str, text_col: str) -> Iterator[tuple[int, dict]]:
    """The number of blocks and the sets to broadcast, one after the other. Windows are cut and counted in Spark and dealt by a hash, so a block has
    about max_windows (window, item) rows and max_windows * WINDOW_BYTES bytes at most; one block at a time comes to the driver."""
    found = stored(benchmark_windows(benchmark, width, id_col, text_col))
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    blocks = max(1, -(-n // max_windows), -(-size // (max_windows * WINDOW_BYTES)))
    part = F.pmod(F.xxhash64("window", "item"), F.lit(blocks))
    for k in range(blocks):
        rows = found.where(part == k).toLocalIterator()
        yield blocks, items_of((bytes(r.window).split(b" "), [] if r["item"] is None else [r["item"]]) for r in rows)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: doc_id, n_words, ranges (merged word ranges), items (sorted item ids).
    With several blocks, rows are told apart by a number of their own, so repeated ones stay rows of their own."""
    schema = "doc_id long, n_words long, ranges array<struct<start:long,end:long>>, items array<long>"
    base, parts, several = id_text(docs, id_col, text_col), [], False
    for blocks, bench in blocks_of(benchmark, width, max_windows, item_col, "text"):
        if blocks > 1 and not several:
            several = True
            base = stored(base.withColumn("_row", F.monotonically_increasing_id())).select("_row", "text", "doc_id")
        sent = docs.sparkSession.sparkContext.broadcast(bench)

        def make(sent=sent):
            bench = sent.value

            def work(ids, texts, *rest):
                ns, ranges, items = [], [], []
                for t in texts:
                    w = words(t)
                    r, found = hits(w, bench)
                    ns.append(len(w))
                    ranges.append([{"start": a, "end": b} for a, b in r])
                    items.append(sorted(found))
                return (ids, ns, ranges, items, *rest)

            return work

        if not several:
            return per_document(base, make, schema)
        found = per_document(base, make, schema + ", _doc long")
        parts.append(stored(found.where("size(ranges) > 0") if parts else found))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("ranges"))),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, r: F.when((F.size(acc) > 0) & (r["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], r["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(r))),
    )
    return every.groupBy(F.col("doc_id").alias("_row")).agg(F.first("_doc").alias("doc_id"), F.first("n_words").alias("n_words"), merged.alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("_row")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut(text: str, ranges: list[tuple[int, int]]) -> str | None:
    """The text without the words in the merged ranges and what stands between them; null if they are most of its words."""
    if not ranges:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORD.finditer(raw.lower())]
    if sum(b - a for a, b in ranges) > MAX_SPAN_SHARE * len(spans):
        return None
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def without_ranges(text: str, bench: dict) -> str | None:
    """The text without the words hit, as `cut` does it."""
    return cut(text, hits(words(text), bench)[0])


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without benchmark passages: their words are cut out of a text, and a document of which they
    are over half goes. All columns stay; documents without hits stay as they are. With several blocks, the ranges of all
    are found on the whole text first; then the text is cut and judged once."""
    schema, blocks = docs.schema, blocks_of(benchmark, width, max_windows, "item_id", "text")
    count, bench = next(blocks)
    if count == 1:
        sent = docs.sparkSession.sparkContext.broadcast(bench)

        def ranges_of(batch, texts):
            return [hits(words(t), sent.value)[0] for t in texts]

    else:
        docs = stored(docs.withColumn("_strandline_row", F.monotonically_increasing_id()))
        found = find_benchmark(docs, benchmark, width, max_windows, "_strandline_row").where("size(ranges) > 0")
        found = stored(found.select(F.col("doc_id").alias("_strandline_hit"), "ranges"))
        docs = docs.join(found, F.col("_strandline_row") == F.col("_strandline_hit"), "left").select(*schema.names, F.col("ranges").alias("_strandline_ranges"))

        def ranges_of(batch, texts):
            return [[(r["start"], r["end"]) for r in x or []] for x in batch.column(batch.num_columns - 1).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = batch.column(i).to_pylist()
            new = [cut(t, r) if t else t for t, r in zip(texts, ranges_of(batch, texts), strict=True)]
            gone = [t is not None and x is None for t, x in zip(texts, new, strict=True)]
            out = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type)).select(schema.names)
            yield out.filter(pa.array([not g for g in gone], pa.bool_()))

    docs = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return docs


SQL10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS t(i) WHERE len(w) >= k),
h AS (SELECT dw.rid, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
nh AS (SELECT rid, count(DISTINCT p) AS n_hit FROM h, unnest(generate_series(i, i + k - 1)) AS t(p) GROUP BY rid),
ni AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM h GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(nh.n_hit, 0)::BIGINT AS n_hit, coalesce(ni.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ni.names, '')) AS items_sha256, coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON d.rid = nh.rid LEFT JOIN ni ON d.rid = ni.rid
"""
