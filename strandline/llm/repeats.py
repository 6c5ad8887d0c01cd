"""Substring dedup with repeated-phrase automata.

1. Confirm recurring phrases: in each window of WINDOW words the PHRASE-word phrase with the least hash is its
   anchor, so equal windows have equal anchors. An anchor that is met in two documents of different words recurs; its
   words and the smallest document that has it are kept. Documents with the words of a smaller one are whole copies of it:
   all their words go, and nothing else depends on them.
2. Compile sharded automata: documents are dealt into blocks of some BLOCK bytes by a hash of their id. Each
   block's Aho-Corasick automaton is compiled from the words of the recurring phrases confirmed in its documents, and all
   its documents stream through it.
3. Locate: the automaton's hits say where phrases stand; the windows that have one as anchor are hashed; for each
   hash the smallest document is kept, and a window of a larger one is covered. Windows are judged on the input.
4. Words of covered windows are cut out.

Window hashes have 64 bits, the names of whole texts 128: at 10^13 candidate windows some chance matches must be expected.
Null texts have no words; texts of fewer than WINDOW words have no windows and stay; rows that repeat an id and text get
equal results; a null id is no smaller than any other and loses nothing; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import arrow_schema, id_text, per_document, read, shuffle_partitions, stored

WINDOW = 50
PHRASE = 8
BLOCK = 4_000_000
WHOLE = -1  # as a window's start: the whole text
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() splits at space and 0x09-0x0D only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; runs double in length by combining two shorter ones."""
    n = len(h) - k + 1
    out, done, part, width, k_left = np.zeros(n, np.uint64), 0, h, 1, k
    while k_left:
        if k_left & 1:
            out = mixed(out + part[done : done + n] * MIX + np.uint64(width))
            done += width
        k_left >>= 1
        if k_left:
            part = mixed(part[:-width] * MIX + (part[width:] ^ (part[width:] >> np.uint64(17))) + np.uint64(width))
            width *= 2
    return out


def window_least(g: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` consecutive values."""
    width, m = 1, g
    while 2 * width <= size:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = size - width
    return np.minimum(m[: len(g) - size + 1], m[rest:]) if rest else m


def anchors_of(h: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes by position and, for each window, the least of its phrases' hashes."""
    g = gram_hashes(h, phrase)
    return g, window_least(g, window - phrase + 1)


def anchor_rows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """kind 0: an anchor's hash as `name`, its words, the document and the hash of the document's words as `other`; kind 1:
    a document of a window or more, the hash of its words as `name` and `other`. docs: doc_id, rk, text."""
    kinds = "kind int, name long, words binary, doc_id long, rk long, other long"
    schema = arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, name, words, at, other = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                w = words_of(text)
                if len(w) < window:
                    continue
                k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(w)), "<i8").tolist()
                g, least = anchors_of(hashes(w), window, phrase)
                found, first = np.unique(g, return_index=True)
                own = np.unique(least)
                starts = first[np.searchsorted(found, own)].tolist()
                kind += [1] + [0] * len(starts)
                name += [k1, *own.view(np.int64).tolist()]
                words += [None, *(b" ".join(w[p : p + phrase]) for p in starts)]
                at += [i] * (len(starts) + 1)
                other += [k2] + [k1] * len(starts)
            if at:
                rows = pa.array(at)
                columns = [pa.array(kind, pa.int32()), pa.array(name, pa.int64()), pa.array(words, pa.binary()), batch.column("doc_id").take(rows), batch.column("rk").take(rows), pa.array(other, pa.int64())]
                yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=100_000)

    return docs.mapInArrow(run, kinds)


def confirmed(docs: DataFrame, window: int, phrase: int) -> tuple[DataFrame, DataFrame]:
    """(anchor, words, low, doc_id, rk): recurring phrases in each document that has them, with the smallest document of all;
    (doc_id, rk): whole copies of smaller documents."""
    met = stored(anchor_rows(docs, window, phrase))
    anchors = met.where("kind = 0 and doc_id is not null")
    # met in documents with different words: copies are found as such
    low = stored(anchors.groupBy("name").agg(F.min("doc_id").alias("low"), F.min("other").alias("a"), F.max("other").alias("b")).where("a < b").select(F.col("name").alias("anchor"), "low"))
    phrases = anchors.select(F.col("name").alias("anchor"), "words", "doc_id", "rk").join(low, "anchor")
    whole = met.where("kind = 1").select("name", "other", "doc_id", "rk")
    first = stored(whole.groupBy("name", "other").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name", "other", "low"))
    return phrases, stored(whole.join(first, ["name", "other"]).where("low < doc_id").select("doc_id", "rk"))


def occurrences(text: bytes, automaton: ahocorasick.Automaton) -> np.ndarray:
    """The numbers of the words at which the automaton's phrases start. text: words with a space around each; bytes count
    as characters, so places are places of bytes."""
    ends = np.fromiter((end for end, _ in automaton.iter(text.decode("latin-1"))), np.int64)
    return np.searchsorted(np.flatnonzero(np.frombuffer(text, np.uint8) == 32), ends) if ends.size else ends


def locate(docs: DataFrame, phrases: DataFrame, copies: DataFrame, parts: int, window: int, phrase: int) -> DataFrame:
    """(wh, doc_id, rk, start, late): the hash of each window whose anchor an automaton finds, where it starts, and whether a
    smaller document has the anchor. docs: block, doc_id, rk, text; phrases: block, anchor, words, low; copies: block,
    doc_id, rk, documents to be left out."""
    schema = "wh long, doc_id long, rk long, start int, late boolean"
    arrow = arrow_schema(schema)

    def block_rows(docs: list, words: list[bytes], anchors: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(anchors)
        anchors, low = anchors[order], low[order]
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(f" {w.decode('latin-1')} ", 0)
        automaton.make_automaton()
        for doc, rk, text in docs:
            w = text.split() if text else []
            if len(w) < window:
                continue
            ends = occurrences(b" " + b" ".join(w) + b" ", automaton)
            if not ends.size:
                continue
            h = hashes(w)
            g, least = anchors_of(h, window, phrase)
            found = np.full(len(g), np.iinfo(np.uint64).max, np.uint64)
            found[ends - phrase] = g[ends - phrase]
            starts = np.flatnonzero(window_least(found, window - phrase + 1) == least)
            if not starts.size:
                continue
            wh = gram_hashes(h, window)[starts].view(np.int64)
            first = low[np.minimum(np.searchsorted(anchors, least[starts]), len(low) - 1)]
            n = len(starts)
            late = np.zeros(n, bool) if doc is None else first < doc
            yield pa.RecordBatch.from_arrays([pa.array(wh), pa.array([doc] * n, pa.int64()), pa.array(np.full(n, rk)), pa.array(starts.astype(np.int32)), pa.array(late)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, words, anchors, low, left_out = None, [], [], [], [], set()

        def closed():
            if docs and words:
                yield from block_rows(docs, words, np.concatenate(anchors).view(np.uint64), np.concatenate(low))

        for batch in batches:
            ids, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = (np.flatnonzero((np.diff(ids) != 0) | (np.diff(kinds) != 0)) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(ids)], strict=True):
                if lo == hi:
                    continue
                if ids[lo] != at:
                    yield from closed()
                    at, docs, words, anchors, low, left_out = ids[lo], [], [], [], [], set()
                part = batch.slice(lo, hi - lo)
                doc, rk = part.column("doc_id"), part.column("rk")
                if kinds[lo] == 0:
                    anchors.append(rk.to_numpy().copy())
                    low.append(doc.to_numpy().copy())
                    words += part.column("text").to_pylist()
                elif kinds[lo] == 1:
                    left_out.update(zip(doc.to_pylist(), rk.to_pylist(), strict=True))
                elif words:
                    rows = zip(doc.to_pylist(), rk.to_pylist(), part.column("text").to_pylist(), strict=True)
                    docs += [x for x in rows if x[:2] not in left_out]
        yield from closed()

    rows = phrases.select("block", F.lit(0).alias("kind"), F.col("low").alias("doc_id"), F.col("anchor").alias("rk"), F.col("words").alias("text"))
    rows = rows.unionByName(copies.select("block", F.lit(1).alias("kind"), "doc_id", "rk", F.lit(None).cast("binary").alias("text")))
    rows = rows.unionByName(docs.select("block", F.lit(2).alias("kind"), "doc_id", "rk", F.col("text").cast("binary").alias("text")))
    return rows.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def covered_words(n: int, starts: list[int] | None, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `starts`."""
    edge = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.asarray(starts) + window, -1)
    return np.cumsum(edge)[:n] > 0


def find_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, text, starts: where covered windows start (null: none; WHOLE: all words go)."""
    base = id_text(docs).withColumn("rk", F.xxhash64("doc_id", "text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = max(1, -(-(size or 0) // block))
    of = F.pmod(F.xxhash64("rk", F.lit(block)), F.lit(blocks)).alias("block")
    phrases, copies = confirmed(base, window, phrase)
    phrases = phrases.select(of, "anchor", "words", "low").distinct()
    parts = min(blocks, max(shuffle_partitions(docs.sparkSession), blocks // 4))
    found = stored(locate(base.select(of, "doc_id", "rk", "text"), phrases, copies.select(of, "doc_id", "rk"), parts, window, phrase))
    first = stored(found.groupBy("wh").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("wh", "low"))
    late = found.where("late").join(first, "wh").where(F.col("low") < F.col("doc_id")).select("doc_id", "rk", "start")
    late = late.unionByName(copies.withColumn("start", F.lit(WHOLE)))
    starts = late.groupBy(F.col("doc_id").alias("id"), F.col("rk").alias("row")).agg(F.collect_set("start").alias("starts"))
    return base.join(starts, (F.col("rk") == F.col("row")) & (F.col("doc_id") == F.col("id")), "left").select("doc_id", "text", "starts")


def cut(text: str | None, starts, window: int) -> tuple[int, int, bytes]:
    """Words, words removed, the kept words joined by one space."""
    w = words_of(text)
    if starts is None or not len(starts):
        return len(w), 0, b" ".join(w)
    if WHOLE in starts:
        return len(w), len(w), b""
    gone = covered_words(len(w), starts, window)
    return len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""

    def make():
        def work(ids, texts, starts):
            done = [cut(t, s, window) for t, s in zip(texts, starts, strict=True)]
            return ids, [d[0] for d in done], [d[1] for d in done], [d[2].decode("utf-8", "surrogatepass") for d in done]

        return work

    return per_document(find_repeats(docs, window), make, "doc_id long, n_words long, n_removed long, kept string")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """What op2 returns, from all windows in one dictionary; for tests."""
    low: dict[tuple, int] = {}
    for doc, text in docs:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            low[key] = min(low.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if low[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


SQL2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM d, unnest(generate_series(1, len(w) - 49)) AS t(i) WHERE len(w) >= 50),
f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(generate_series(i, i + 49)) AS p FROM g JOIN f USING (g) WHERE low < doc_id)),
r AS (SELECT rid, list(p) AS ps FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""
