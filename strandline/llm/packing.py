"""Order-preserving packing of tokenised documents by dynamic programming.

Each task packs its own rows in their order. Cuts may fall at document ends (free), at sentence ends (a small
penalty) or, in sentences longer than `HARD_GAP` tokens (or a window), elsewhere (a large penalty). With p the position of a
cut and f its least cost, f[i] = penalty[i] + capacity - p[i] + min(f[j] + p[j]) over the cuts j at most
`capacity` tokens before; the minimum comes from a monotone queue. The programme runs over blocks of some
BLOCK tokens: a block's last four windows are taken up again by the next block, so a task holds one block whatever its
input. The chain over blocks may therefore cost more than one over the whole input; tests/llm holds it to within one
window in a hundred. What is left at a task's end is split into lengths that are powers of two, which need no padding.

A null text is empty; an empty document is its end id alone; repeated rows are packed each on its own;
an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from strandline.llm.common import arrow_schema, id_text, read

#: The ranks file of the byte_bpe_50k vocabulary; ids equal those of byte_bpe_50k.json (see tests/llm).
RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
END_ID = 1
CAPACITY = 2048
SENTENCE_COST, HARD_COST = 8, 256
HARD_GAP = 512
BLOCK = 262_144
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Where no two white-space characters meet, the pattern needs no look-ahead, and matching is twice as fast.
LOOK_AHEAD, SINGLE = r"\s+(?!\S)|\s+", r"\s"
MEETING = re.compile(r"\s\s")
#: Texts of all kinds of pieces: words, contractions, digits, signs, white space, marks, special strings, bytes of any length.
PROBES = ("Plain words, one after another.", "don't we'll I'm IT'S", "  two  spaces \n\n\t tabs ", "1234567 3.14 a1b2", f"x{SPECIAL}y <s></s>", "é漢字かな한국어 русский العربية", "e\u0301 \U0001f600\U0001f468\u200d\U0001f469 \u00a0\u2003\x00\x7f", "".join(map(chr, range(1, 512))), "a" * 300 + "?!" * 50)


class Ids:
    """Texts to ids, as the tokenizers library gives them."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        whole = public_tokenizers.PATTERN
        self.whole, self.single = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("whole", whole), ("single", whole.replace(LOOK_AHEAD, SINGLE))))
        self.sentence_end = np.zeros(max(max(ranks.values()), SPECIAL_ID) + 1, bool)
        for piece, i in ranks.items():
            self.sentence_end[i] = piece[-1:] in (b".", b"!", b"?", b"\n")

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text, then the end id."""
        out = array("I")
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(SPECIAL_ID)
            encoding = self.whole if MEETING.search(part) else self.single
            out.extend(array("I", encoding.encode_ordinary(part)))
        out.append(END_ID)
        return np.frombuffer(out, "<u4")


@lru_cache
def compared(path: str, vocabulary: str) -> None:
    """Raises unless the ranks file and the tokenizers file give the same ids for odd texts; once in each driver."""
    known, ids = Tokenizer.from_file(vocabulary), Ids(path)
    for text in PROBES:
        want = known.encode(text, add_special_tokens=False).ids
        if ids.encode(text)[:-1].tolist() != want:
            raise ValueError(f"{path} and {vocabulary} differ on {text!r}")


def cut_points(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, gap: int = HARD_GAP) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, rising, and their penalties. The last is the last document end."""
    cost = {}
    marks = np.flatnonzero(sentence_end[ids]) + 1
    at = np.union1d(marks, ends)
    gaps = np.diff(np.concatenate(([0], at)))
    if (wide := np.flatnonzero(gaps > gap)).size:
        extra = [np.arange(at[k] - gaps[k] + gap, at[k], gap) for k in wide]
        cost = np.concatenate(extra)
        at = np.union1d(at, cost)
    penalty = np.full(at.size, SENTENCE_COST, np.int64)
    if len(cost):
        penalty[np.searchsorted(at, cost)] = HARD_COST
    penalty[np.searchsorted(at, ends)] = 0
    return at, penalty


def best_cuts(at: list[int], penalty: list[int], capacity: int) -> list[int]:
    """The cheapest chain of cuts from 0 to the last point, without 0."""
    points = [0, *at]
    back = [0] * len(points)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f + p, index), values rising
    pop, push, shift = queue.pop, queue.append, queue.popleft
    for i in range(1, len(points)):
        p = points[i]
        while points[queue[0][1]] < p - capacity:
            shift()
        least, back[i] = queue[0]
        g = penalty[i - 1] + capacity + least  # f + p of this point
        while queue and queue[-1][0] >= g:
            pop()
        push((g, i))
    cuts, i = [], len(points) - 1
    while i:
        cuts.append(points[i])
        i = back[i]
    return cuts[::-1]


def halves(start: int, end: int) -> list[int]:
    """Cuts that split [start, end) into falling powers of two."""
    cuts = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        cuts.append(start)
    return cuts


class Packer:
    """Packs a stream of documents; holds what isn't final yet."""

    def __init__(self, sentence_end: np.ndarray, capacity: int, first_id: int):
        self.sentence_end, self.capacity, self.next_id = sentence_end, capacity, first_id
        self.held: list[tuple[int, np.ndarray, int]] = []  # (doc_id, ids, ids already packed)
        self.size = 0

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        self.held.append((doc, ids, 0))
        self.size += ids.size
        return self.flush(False) if self.size >= BLOCK else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        parts = [ids[base:] for _, ids, base in self.held]
        ids, ends = np.concatenate(parts), np.cumsum([p.size for p in parts])
        at, penalty = cut_points(ids, ends, self.sentence_end, min(HARD_GAP, self.capacity))
        cuts = best_cuts(at.tolist(), penalty.tolist(), self.capacity)
        if last:
            start = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + halves(start, cuts[-1])
        else:
            cuts = cuts[: max(1, len(cuts) - 4)]
        out, held, k, start, size, begin = [], [], 0, 0, 0, 0
        for (doc, whole, base), part, end in zip(self.held, parts, ends.tolist(), strict=True):
            begin, at_doc = end - part.size, end - part.size
            while k < len(cuts) and at_doc < end:
                stop = min(end, cuts[k])
                piece = ids[at_doc:stop]
                out.append((doc, at_doc - begin + base, stop - at_doc, zlib.crc32(piece.tobytes()), whole.size, self.next_id + k, at_doc - start))
                at_doc = stop
                if stop == cuts[k]:
                    start, k = stop, k + 1
            if at_doc < end:
                held.append((doc, whole, at_doc - begin + base))
                size += end - at_doc
        self.held, self.size, self.next_id = held, size, self.next_id + len(cuts)
        return out


def pack(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ranks: the ranks file of the
    tokenizers file `vocabulary`."""
    path, schema = ranks or public_tokenizers.path(RANKS), arrow_schema(SCHEMA)
    compared(path, vocabulary or public_tokenizers.path(VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = Ids(path)
        packer = Packer(ids.sentence_end, capacity, TaskContext.get().partitionId() << 40)

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out := packer.add(doc, ids.encode(text or "")):
                    yield rows(out)
        if out := packer.flush(True):
            yield rows(out)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
