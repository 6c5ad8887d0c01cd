"""Near-duplicate documents by Order MinHash.

Words are runs of anything but space and 0x09-0x0D, unchanged. Documents with equal words form a class; its
smallest doc_id stands for it. Two texts are near when the edit distance over their words, by alignment in a band as
wide as that, is at most a fifth of the longer one's words. Components of near classes are the groups; the smallest
doc_id of a group stays.

1. Sketches. Under each of ORDERS random orders of all occurrence-labelled K-word runs of a text, its LEAST least runs
   are taken and kept in the order of the text. Each two of them, in that order, are a key: two texts are candidates when
   the same two runs are among the least of both and stand in the same order. Such keys need runs of K words that no edit
   touches, of which short texts may have none. Texts of up to SHORT words have all their runs as keys as well, instead of
   sketches up to a fifth less than SHORT: of n words with at most d edits, some (n - d) / (d + 1) in a row stay, so a near
   text shares a run of that many words. That many, RUN at most, are the runs, so every near pair of short texts meets.
2. Buckets. The classes that share a key are aligned with the bucket's smallest one, its centre. Where all are near it,
   the bucket is done. Else a bucket of at most SMALL classes aligns all pairs but those both near the centre; it is exact.
3. The classes of larger buckets of unlike texts (a passage that many documents quote) are joined exactly. Those that are in one group
   already are not compared. In buckets of up to LARGE, classes of fitting lengths meet within a task, each two in the smallest key they
   share. Those of still larger buckets meet by their rarest words: of two near texts, the longer of n words, all but a fifth of n words are
   in both, so they share one of each one's n / 5 + 1 rarest words, a word's second occurrence being another word. Rare is by any one
   order; here by counts of the frequent words (FREQUENT at most are sent to the tasks), the rest by hash. Pairs whose words, counted, rule
   out nearness are not aligned; of two groups first the likeliest pair is, and all only where that one is not near.

So texts that share a bucket are in one group if they are near, whatever its size; a near pair is missed only where no key is shared. Recall, measured by tests/llm/near_recall.py on 500 pairs of texts each with words replaced at random:
0.986 where 19 of 100 words differ, 0.994 for 190 of 1000, 1.0 for 15 of 100 and 5 of 50; beside a passage that all texts
share, 1.0 for 18 of 120 words with 60 shared. Texts of few runs answer less well: five words replaced in 25 may leave no run of five.

Null texts and texts without words are near nothing and stay; texts of fewer than K words have one run, the whole
text; repeated rows belong to one class; texts that share an id count as one node of the groups, aligned by one of them;
a row without an id is in the class of its words, with a null class and group if no row of the class has an id, and
stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import arrow_schema, free, id_text, read, stored
from strandline.operators.graph import components
from strandline.llm.repeats import gram_hashes, hashes, mixed, words_of

K = 5
ORDERS = 8
LEAST = 5
SIMILARITY = 0.8
SMALL = 16
SHORT, RUN = 100, 4
FREQUENT = 65_536
LARGE, BLOCK, BAG = 8_192, 8_192, 256
TILE, LEVELS, COMMON, PART = 512, 8, 256, 1 << 14
MIX = np.uint64(0x9E3779B97F4A7C15)
SEEDS = mixed(np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def labelled(g: np.ndarray) -> np.ndarray:
    """Each run's hash joined with how often it came before in the text."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    count = np.empty(len(s), np.uint64)
    count[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return mixed(g + count * MIX)


def runs_of(h: np.ndarray, k: int = K) -> np.ndarray:
    """The labelled k-word runs of a text with the word hashes h."""
    return labelled(gram_hashes(h, min(k, len(h))))


def sketches(g: np.ndarray, seeds: np.ndarray, least: int) -> np.ndarray:
    """A row for each seed: the ranks of the text's least runs, in the order of the text."""
    best, at = np.zeros((len(seeds), 0), np.uint64), np.zeros((len(seeds), 0), np.int64)
    step = 8_192  # long texts in parts: least of the parts' least
    for k in range(0, len(g), step):
        x = mixed(g[k : k + step] ^ seeds[:, None])
        i = np.argpartition(x, least - 1, axis=1)[:, :least] if x.shape[1] > least else np.broadcast_to(np.arange(x.shape[1]), x.shape)
        best = np.concatenate((best, np.take_along_axis(x, i, 1)), 1)
        at = np.concatenate((at, i + k), 1)
        if best.shape[1] > least:
            keep = np.argsort(best, axis=1, kind="stable")[:, :least]
            best, at = np.take_along_axis(best, keep, 1), np.take_along_axis(at, keep, 1)
    return np.take_along_axis(best, np.argsort(at, axis=1, kind="stable"), 1)


def run_lengths(n: int, similarity: float) -> set[int]:
    """Lengths of the runs, one of which a text of n words shares with any near one."""
    longer = ((m, int((1 - similarity) * m + 1e-9)) for m in range(n, int(n / max(similarity, 0.1) + 1e-9) + 1))
    return {min(RUN, -(-(m - d) // (d + 1))) for m, d in longer if 0 < d < m}


def keys_of(h: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The keys of a text with the word hashes h: each two of a sketch's runs, in the order of the text; all runs of short texts."""
    out = []
    if len(h) <= SHORT:
        out += [mixed(np.unique(gram_hashes(h, k))) for k in run_lengths(len(h), similarity) if k <= len(h)]
    if len(h) > SHORT * similarity:
        ranks = sketches(runs_of(h), SEEDS, LEAST)
        a, b = np.array(list(combinations(range(ranks.shape[1]), 2))).T
        out.append(mixed(mixed(ranks[:, a] * MIX + np.arange(ORDERS, dtype=np.uint64)[:, None]) + ranks[:, b]).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def classes_of(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, rep, keys): a row for each different text; (doc_id, k1, k2, words): all documents, null keys without
    words; words are 32-bit word hashes, left out where the text came before in its batch."""
    schema = "doc_id long, k1 long, k2 long, keys array<long>, words binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys, words, known = [], [], [], set()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words_of(text)
                name = tuple(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(w)), "<i8").tolist()) if w else (None, None)
                names.append(name)
                new = bool(w) and (doc, name) not in known
                known.add((doc, name))
                h = hashes(w) if new else None
                keys.append(keys_of(h, similarity).view(np.int64) if new else None)
                words.append((h >> np.uint64(32)).astype("<u4").tobytes() if new else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([k[0] for k in names], pa.int64()), pa.array([k[1] for k in names], pa.int64()), pa.array(keys, arrow.field("keys").type), pa.array(words, pa.binary())], schema=arrow)

    seen = stored(docs.mapInArrow(run, schema))
    classes = seen.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("keys").alias("keys"))
    return stored(classes), seen.select("doc_id", "k1", "k2", "words")


def buckets(rows: DataFrame) -> DataFrame:
    """rep, key, centre, n: the rows whose key two or more share; centre is the smallest rep of the bucket,
    n its number of rows."""
    sizes = rows.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("n"))
    shared = stored(sizes.where("centre < top").select("key", "centre", "n"))
    out = stored(rows.join(shared, "key"))
    free(shared)
    return out


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of word lists, or one more than its limit if it is over. Ends that are equal
    are cut off first, and a lower bound settles most pairs that are far apart."""
    out = np.zeros(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        most = int(limit[k])
        n = min(len(x), len(y))
        if abs(len(x) - len(y)) > most:
            out[k] = most + 1
            continue
        same = x[:n] == y[:n]
        head = n if same.all() else int(same.argmin())
        x, y = x[head:], y[head:]
        n = min(len(x), len(y))
        same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
        tail = n if same.all() else int(same.argmin())
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if not len(x) or not len(y):
            out[k] = max(len(x), len(y))
        elif bag_distance(x, y) > most:
            out[k] = most + 1
        else:
            long, short = (x, y) if len(x) >= len(y) else (y, x)
            out[k] = min(in_widening_bands(long.tolist(), short.tolist(), most), most + 1)
    return out


def bag_distance(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the edit distance: words of one that the other lacks, counted."""
    both, where = np.unique(np.concatenate((x, y)), return_inverse=True)
    d = np.bincount(where[: len(x)], minlength=len(both)) - np.bincount(where[len(x) :], minlength=len(both))
    return int(max(d[d > 0].sum(), -d[d < 0].sum()))


def in_widening_bands(rows: list[int], cols: list[int], most: int) -> int:
    """The edit distance, exact where it is at most `most`: narrow bands first, so close texts cost little however long."""
    band = max(64, 2 * (len(rows) - len(cols)))
    while band < most:
        if (d := banded(rows, cols, band)) <= band:
            return d
        band *= 4
    return banded(rows, cols, most)


def banded(rows: list[int], cols: list[int], band: int) -> int:
    """The edit distance, exact where it is at most `band`; rows is the longer list.

    A column of the alignment matrix is held as the signs of its vertical steps, a bit for each row, in two
    integers, so a whole column is worked out in a few operations; only the rows within `band` of the diagonal
    are kept, and those that leave or enter count as one more than their neighbours."""
    where: dict[int, int] = {}
    for i, w in enumerate(rows):
        where[w] = where.get(w, 0) | 1 << i
    gone, size = 0, min(len(rows), band + 1)  # rows dropped at the top, rows kept
    up, down, value = (1 << size) - 1, 0, 0  # steps +1, steps -1, value on the diagonal
    for j, w in enumerate(cols, 1):
        if j - gone > band + 1:
            up, down, gone, size = up >> 1, down >> 1, gone + 1, size - 1
        if gone + size < len(rows):
            up, size = up | 1 << size, size + 1
        mask = (1 << size) - 1
        equal = (where.get(w, 0) >> gone) & mask
        across = (((equal & up) + up) ^ up) | equal
        flat = equal | down
        right, left = down | (mask & ~(across | up)), up & across
        at = j - 1 - gone  # bit of row j; the bit below is that of row j - 1
        value += 1 if at == 0 else (right >> at - 1 & 1) - (left >> at - 1 & 1)
        right, left = (right << 1 | 1) & mask, left << 1 & mask
        up, down = left | (mask & ~(flat | right)), right & flat
        value += (up >> at & 1) - (down >> at & 1)
    rest = len(cols) - gone  # rows below the last diagonal cell
    below = (up >> rest).bit_count() - (down >> rest).bit_count()
    return value + below + (len(rows) - gone - size)


def aligned(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """rep, centre, near: the pairs (rep, centre) judged."""
    schema = "rep long, centre long, near boolean"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(c).to_pylist()] for c in ("rep_words", "centre_words"))
            limit = np.array([int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)], np.int64)
            near = edit_distances(a, b, limit) <= limit if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("centre"), pa.array(near)], schema=arrow)

    of = lambda name: words.select(F.col("doc_id").alias(name), F.col("words").alias(f"{name}_words"))
    return pairs.join(of("rep"), "rep").join(of("centre"), "centre").select("rep", "centre", "rep_words", "centre_words").mapInArrow(run, schema)


def occurrences(words: bytes) -> np.ndarray:
    """A text's words as hashes, the second occurrence of one being another."""
    return labelled(mixed(np.frombuffer(words, "<u4").astype(np.uint64)))


def frequent_words(texts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, bool]:
    """The most frequent of the texts' `occurrences`, at most so many and in order, their counts, and whether all that come twice are there. Whole powers of two of counts
    are taken, from the top, so that only those that are taken reach the driver."""
    schema = "token long, n long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [occurrences(w) for w in batch.column("words").to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], schema=arrow)

    level = F.floor(F.log2("n"))
    counts = stored(texts.select("words").mapInArrow(run, schema).groupBy("token").agg(F.sum("n").alias("n")).where("n > 1"))
    least, taken, whole = None, 0, True
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        taken += r["n"]
        if taken > most:
            whole = False
            break
        least = r["level"]
    found = counts.where(level >= least if least is not None else F.lit(False)).toArrow()
    free(counts)
    token, n = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order], whole


def bags(words: np.ndarray) -> np.ndarray:
    """How many of a text's words fall into each of BAG classes of words."""
    return np.bincount((mixed(words.astype(np.uint64)) >> np.uint64(56)).astype(np.int64), minlength=BAG).astype(np.int32)


def levels_of(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bags (a row for each text) as levels, 1 where a class has at least so many words: the product of two texts' levels is how many words they have in
    common at most, up to LEVELS of a class. And the words beyond these."""
    at_least = [bag[:, (bag >= k).sum(0) > 1] >= k for k in range(1, LEVELS + 1)]
    return np.concatenate(at_least, 1).astype(np.float32), np.maximum(bag - LEVELS, 0).sum(1).astype(np.float32)


def had_before(keys: np.ndarray, key: int) -> np.ndarray:
    """A row for each text: which of the commonest COMMON keys smaller than this one it has."""
    smaller = [k[k < key] for k in keys]
    found, column, n = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    taken = np.argsort(-n, kind="stable")[: min(COMMON, int((n > 1).sum()))]
    to = np.full(len(found), -1)
    to[taken] = np.arange(len(taken))
    row, column = np.repeat(np.arange(len(keys)), [len(k) for k in smaller]), to[column]
    out = np.zeros((len(keys), len(taken)), np.float32)
    out[row[column >= 0], column[column >= 0]] = 1
    return out


def rarest_words(texts: DataFrame, known: np.ndarray, counts: np.ndarray, whole: bool, similarity: float) -> DataFrame:
    """key, part, rep, star, at, block, alone, words: of each text (rep, star, words) the rarest `occurrences`, one more than edits may
    touch, as keys; at is a token's place among all of the text's. A token of more than BLOCK texts has its texts dealt into blocks, and a part for each
    two of these, alone if it is one with itself. whole: known are all tokens that come more than once, so others are left out."""
    schema = "key long, part long, rep long, star long, at int, block int, alone boolean, words binary"
    arrow = arrow_schema(schema)
    sent = texts.sparkSession.sparkContext.broadcast((np.append(known, np.uint64(2**64 - 1)), np.append(counts, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in batches:
            for rep, star, w in zip(*(batch.column(c).to_pylist() for c in ("rep", "star", "words")), strict=True):
                g = occurrences(w)
                i = np.searchsorted(known, g)
                n = np.where(known[i] == g, counts[i], 1)
                order = np.lexsort((g, n))[: int((1 - similarity) * len(g) + 1e-9) + 1]
                at = np.flatnonzero(n[order] > 1) if whole else np.arange(len(order))
                g, blocks = g[order[at]], -(-n[order[at]] // BLOCK)
                own = (mixed(np.full(len(g), rep, np.int64).view(np.uint64) ^ g) % blocks.astype(np.uint64)).astype(np.int64)
                k = np.repeat(np.arange(len(g)), blocks)  # a copy for each block that the text's own one meets
                other = np.arange(len(k)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                part = np.minimum(own[k], other) * blocks[k] + np.maximum(own[k], other)
                same = lambda v, kind: pa.array(np.full(len(k), v), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(g[k].view(np.int64)), pa.array(part, pa.int64()), same(rep, pa.int64()), same(star, pa.int64()), pa.array(at[k], pa.int32()), pa.array(own[k], pa.int32()), pa.array(own[k] == other), pa.array([w] * len(k), pa.binary())], schema=arrow)

    return texts.select("rep", "star", "words").mapInArrow(run, schema)


def met(rows: DataFrame, similarity: float, best: bool) -> DataFrame:
    """rep, centre, a, b, bound: the texts (rep, star, words) of different stars a, b that share a key and part, unless their lengths, places or
    words, counted, rule out nearness, or one of the keys they have (keys, if known) is in both and smaller: there they are met. bound is the least distance that these leave. best: of two stars with a key in common one pair is enough."""
    schema = "rep long, centre long, a long, b long, bound int"
    arrow = arrow_schema(schema)
    names = ("key", "part", "rep", "star", "at", "block")

    def near(rows: dict, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        smaller: dict[int, frozenset] = {}

        def earlier(x: int) -> frozenset:
            if x not in smaller:
                smaller[x] = frozenset(rows["keys"][x][rows["keys"][x] < rows["key"][x]].tolist())
            return smaller[x]

        def common(x: int, y: int) -> int:
            for k in (x, y):
                if k not in known:
                    known[k] = np.sort(occurrences(rows["words"][k].tobytes()))
            both = np.sort(np.concatenate((known[x], known[y])), kind="stable")  # two sorted runs, merged
            return int((both[1:] == both[:-1]).sum())

        key, n = np.cumsum(new) << 32, rows["n"]
        ends = np.searchsorted(key + n, key + np.minimum(n / max(similarity, 0.01) + 2, 1 << 31).astype(np.int64), "right")  # rows of a key, by length, up to one that is too long
        least = n - ((1 - similarity) * n + 1e-9).astype(np.int64)  # words that are in both texts at least, if they are near and this is the longer one
        starts = np.flatnonzero(new)
        for first, after in zip(starts.tolist(), np.append(starts[1:], len(new)).tolist(), strict=True):
            if (rows["star"][first:after] == rows["star"][first]).all():
                continue
            bag = np.stack([bags(w) for w in rows["words"][first:after]])
            levels, rest = levels_of(bag)
            had = had_before(rows["keys"][first:after], rows["key"][first])
            for lo in range(first, after, TILE):
                hi = min(lo + TILE, after)
                for lo2 in range(lo, int(ends[hi - 1]), TILE):
                    hi2 = min(lo2 + TILE, int(ends[hi - 1]))
                    a, b = slice(lo, hi), slice(lo2, hi2)
                    most = levels[lo - first : hi - first] @ levels[lo2 - first : hi2 - first].T
                    if rest.any():
                        most += np.minimum.outer(rest[lo - first : hi - first], rest[lo2 - first : hi2 - first])
                    fits = (most >= least[b]) & (rows["star"][a, None] != rows["star"][b]) & (np.arange(lo2, hi2) < ends[a, None])
                    if lo2 == lo:
                        fits &= np.arange(lo2, hi2) > np.arange(lo, hi)[:, None]
                    if not rows["alone"][first]:
                        fits &= rows["block"][a, None] != rows["block"][b]
                    if had.size:
                        fits &= had[lo - first : hi - first] @ had[lo2 - first : hi2 - first].T == 0
                    i, j = np.nonzero(fits)
                    i, j = i + lo, j + lo2
                    if rest.any():  # in parts, since a part holds both bags of each pair
                        fits = [np.minimum(bag[x - first], bag[y - first]).sum(1) >= least[y] for x, y in ((i[k : k + PART], j[k : k + PART]) for k in range(0, len(i), PART))]
                        fits = np.concatenate([np.zeros(0, bool), *fits])
                        i, j = i[fits], j[fits]
                    yield from judged(rows, i, j, least, common, earlier)

    def judged(rows: dict, i: np.ndarray, j: np.ndarray, least: np.ndarray, common, earlier) -> Iterator[pa.RecordBatch]:
        n, m = rows["n"][i], rows["n"][j]
        fits = (n >= least[j]) & (n - rows["at"][i] >= least[j]) & (m - rows["at"][j] >= least[j])
        i, j = i[fits], j[fits]
        fits = np.array([earlier(x).isdisjoint(earlier(y)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = i[fits], j[fits]
        both = np.array([common(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        fits = both >= least[j]
        i, j, bound = i[fits], j[fits], (rows["n"][j] - both)[fits]
        if not len(i):
            return
        a, b = np.minimum(rows["star"][i], rows["star"][j]), np.maximum(rows["star"][i], rows["star"][j])
        if best:
            order = np.lexsort((bound, b, a))
            first = order[np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))]
            i, j, a, b, bound = i[first], j[first], a[first], b[first], bound[first]
        x, y = rows["rep"][i], rows["rep"][j]
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip((np.maximum(x, y), np.minimum(x, y), a, b, bound), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            rows = held
            if batch is not None and batch.num_rows:
                words = np.empty(batch.num_rows, object)
                words[:] = [np.frombuffer(w, "<u4") for w in batch.column("words").to_pylist()]
                rows = {c: batch.column(c).to_numpy().astype(np.int64) for c in names} | {"words": words, "n": np.array([len(w) for w in words], np.int64)}
                keys = batch.column("keys")
                rows["keys"] = np.empty(batch.num_rows, object)
                rows["keys"][:] = np.split(keys.flatten().to_numpy(), np.cumsum(keys.value_lengths().to_numpy())[:-1])
                rows["alone"] = batch.column("alone").to_numpy(zero_copy_only=False)
                rows = rows if held is None else {c: np.concatenate((held[c], rows[c])) for c in rows}
            if rows is None or not len(rows["key"]):
                continue
            new = np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["part"][1:] != rows["part"][:-1]))
            cut = len(new) if batch is None else int(np.flatnonzero(new)[-1])  # the last key may go on in the next batch
            held = {c: v[cut:] for c, v in rows.items()}
            if cut:
                yield from near({c: v[:cut] for c, v in rows.items()}, new[:cut])

    return rows.repartition("key", "part").sortWithinPartitions("key", "part", F.length("words")).mapInArrow(run, schema)


def crowd_candidates(crowd: DataFrame, words: DataFrame, similarity: float, best: bool, rows: DataFrame | None = None) -> DataFrame:
    """rep, centre, a, b: pairs of texts (rep, star) of different stars (a, b) that may be near; no near one is missing, or no two stars
    with one, if best: then of each two stars the pair of the least bound. With bucket rows (key, rep, n) only pairs that share one: those
    of buckets of up to LARGE meet there, those of larger ones by their rarest words."""
    texts = stored(crowd.join(words, F.col("rep") == F.col("doc_id")).select("rep", "star", "words"))
    pairs, wide = None, texts
    if rows is not None:
        none = [F.lit(0).cast(t).alias(v) for v, t in (("part", "long"), ("at", "int"), ("block", "int"))]
        fitting = rows.where(F.col("n") <= LARGE)
        own = stored(texts.join(fitting.groupBy("rep").agg(F.collect_list("key").alias("keys")), "rep"))
        pairs = met(own.select(F.explode("keys").alias("key"), "keys", "rep", "star", "words", *none, F.lit(True).alias("alone")), similarity, best)
        wide = texts.join(rows.where(F.col("n") > LARGE).select("rep").distinct(), "rep", "left_semi")
    if rows is None or not wide.isEmpty():
        rare = rarest_words(wide, *frequent_words(wide), similarity).withColumn("keys", F.array().cast("array<bigint>"))
        by_words = met(rare, similarity, best)
        pairs = by_words if pairs is None else pairs.unionByName(by_words)
    least = pairs.groupBy("a", "b").agg(F.min(F.struct("bound", "rep", "centre")).alias("p")).select("p.rep", "p.centre", "a", "b")
    found = stored(least if best else pairs.select("rep", "centre", "a", "b").distinct())
    free(texts)
    return found


def crowd_pairs(crowd: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """rep, centre: the pairs of texts (rep, star) with different stars that may be near; no near one is missing."""
    return crowd_candidates(crowd, words, similarity, False).select("rep", "centre")


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with star: the component of each one's rep by the links (rep, centre)."""
    found = components(links.select(F.col("rep").alias("a"), F.col("centre").alias("b")))
    return nodes.join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("star"))


def crowd_links(rows: DataFrame, known: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """rep, centre: near pairs that, with the known near ones (rep, centre), put the texts of the bucket rows (key, rep, n) into the groups that
    all near pairs which share a bucket would. Two groups need one link, so first their likeliest pair is aligned, and all their pairs
    only where that one is not near and no other link has joined them."""
    c = F.col
    crowd = stored(grouped(rows.select("rep").distinct(), known))
    likely = crowd_candidates(crowd, words, similarity, True, rows)
    first = stored(aligned(likely.select("rep", "centre"), words, similarity))
    joined = components(likely.join(first.where("near"), ["rep", "centre"]).select("a", "b"))
    later = stored(crowd.join(joined.hint("merge"), c("star") == c("node"), "left").select("rep", F.coalesce("component", "star").alias("star")))
    size = crowd.groupBy("star").agg(F.count(F.lit(1)).alias("texts"))
    failed = likely.join(first.where("not near"), ["rep", "centre"]).select("a", "b")
    more = failed.join(size.select(c("star").alias("a"), c("texts").alias("a_texts")), "a").join(size.select(c("star").alias("b"), c("texts").alias("b_texts")), "b")
    # stars of one text each had no other pair
    again = stored(more.where("a_texts + b_texts > 2").select(F.explode(F.array("a", "b")).alias("star")).distinct())
    left = stored(crowd.join(again, "star", "left_semi").select("rep").join(later, "rep"))
    near = first.where("near").select("rep", "centre")
    if not left.isEmpty():
        rest = crowd_candidates(left, words, similarity, False, rows)
        second = stored(aligned(rest.select("rep", "centre").join(first.select("rep", "centre"), ["rep", "centre"], "left_anti"), words, similarity))
        near = near.unionByName(second.where("near").select("rep", "centre"))
        free(rest)
    free(crowd, likely, later, again, left)
    return near


def near_links(rows: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between near classes, from the bucket rows; no two groups of them have a near pair that shares a bucket."""
    judged = stored(aligned(rows.where("rep <> centre").select("rep", "centre").distinct(), words, similarity))
    state = stored(rows.join(judged, ["rep", "centre"], "left").select("key", "rep", "n", F.coalesce("near", F.lit(True)).alias("near")))
    unlike = stored(state.groupBy("key").agg(F.bool_and("near").alias("all_near")).where("not all_near").select("key"))
    unlike_rows = state.join(unlike, "key")
    few = stored(unlike_rows.where(F.col("n") <= SMALL).select("key", "rep", "near"))
    other = few.select("key", F.col("rep").alias("other"), F.col("near").alias("other_near"))
    small = few.join(other, "key").where("other < rep and not (near and other_near)").select("rep", F.col("other").alias("centre")).distinct()
    later = stored(aligned(small.join(judged.select("rep", "centre"), ["rep", "centre"], "left_anti"), words, similarity))
    many = stored(unlike_rows.where(F.col("n") > SMALL).select("key", "rep", "n"))
    free(rows, state, unlike, few)
    links = stored(judged.unionByName(later).where("near").select("rep", "centre"))
    if not many.isEmpty():
        links = links.unionByName(crowd_links(many, links, words, similarity))
    return links.select(F.col("rep").alias("a"), F.col("centre").alias("b"))


def near_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id with the same words), group_id (smallest doc_id of
    its near-duplicate group), kept (it is that document)."""
    classes, seen = classes_of(id_text(docs), similarity)
    rows = buckets(classes.where("rep is not null").select("rep", F.explode("keys").alias("key")))
    ids = rows.select(F.col("rep").alias("id")).distinct()
    # a class's words come from any of its documents with the smallest id and words
    needed = seen.where("words is not null").select("doc_id", "words").join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left_semi")
    words = stored(needed.groupBy("doc_id").agg(F.max("words").alias("words")))
    group = components(near_links(rows, words, similarity))
    named = stored(classes.join(group, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id")))
    free(classes, words)
    own = F.coalesce("group_id", "doc_id")
    return seen.select("doc_id", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), own.alias("group_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op9_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(read(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that are not the first of their group; all columns stay. Rows that
    repeat an id that stays all stay."""
    gone = stored(near_documents(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
