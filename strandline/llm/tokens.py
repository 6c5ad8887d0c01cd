"""Exact token counts by a two-tier lookup on the map side.

The tokenizer (a SentencePiece BPE model with byte fallback and no normalisation) never merges across the
start of a run of spaces or across a line feed, so a text's count is the sum over its pre-tokens. A compact
table of the most frequent pre-tokens' lengths is broadcast; the rest is encoded once in each worker and
kept in a bounded cache. Pre-tokens are never shuffled: to choose the table, each task sends its own few
heaviest pre-tokens only. The table's content changes speed, never counts.

Null and empty texts have 0 bytes and 0 tokens; repeated rows count each on its own; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import id_text, per_document, read

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
TABLE_SIZE = 16_384  # entries of the broadcast table
TASK_TOP = 2_000  # heaviest pre-tokens that a task reports
TASK_KEEP = 100_000  # distinct pre-tokens that a task counts at once; beyond, light ones are dropped
CACHE_SIZE = 900_000  # entries of a worker's cache
LONG = 64  # longer pre-tokens (blobs) are neither kept nor reported, so tables have bounded bytes

SPACE = "▁"
PRE_TOKEN = re.compile(r" *[^ \n]+|\n| +")


def pre_tokens(text: str | None) -> list[str]:
    """The text's pre-tokens with the space that the model puts before a text; the space mark itself is a space to the model."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


class Lengths(dict):
    """Pre-token -> number of tokens: the frequent ones given, others encoded when first met."""

    def __init__(self, path: str, frequent: dict[str, int], size: int = CACHE_SIZE):
        super().__init__(frequent)
        self.frequent, self.size = frequent, size + len(frequent)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lead = len(self.model.encode("\n"))
        splits = [p for i in range(self.model.get_piece_size()) if re.search(rf"\n|[^{SPACE}]{SPACE}", p := self.model.id_to_piece(i))]
        if splits:
            raise ValueError(f"{path} has pieces across pre-tokens, such as {splits[0]!r}")

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.size:
            self.clear()
            self.update(self.frequent)
        n = len(self.model.encode("\n" + piece, num_threads=1)) - self.lead
        if len(piece) <= LONG:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


def heaviest(docs: DataFrame, size: int) -> list[str]:
    """The most frequent pre-tokens over all documents, from each task's heaviest."""

    def make_run(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen.update(p for p in pre_tokens(text) if len(p) <= LONG)
            if len(seen) > TASK_KEEP:
                seen = Counter(dict(seen.most_common(TASK_KEEP // 4)))
        top = seen.most_common(TASK_TOP)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    tops = docs.mapInArrow(make_run, "piece string, n long")
    return [r.piece for r in tops.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()]


def count_tokens(docs: DataFrame, model: str | None = None, table_size: int = TABLE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens."""
    path = model or public_tokenizers.path(MODEL)
    base = id_text(docs, id_col, text_col)
    lengths = Lengths(path, {})
    sent = docs.sparkSession.sparkContext.broadcast({p: lengths[p] for p in heaviest(base, table_size)})

    def make():
        lengths = Lengths(path, sent.value)

        def work(ids, texts):
            return ids, [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], [lengths.count(t) for t in texts]

        return work

    return per_document(base, make, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
