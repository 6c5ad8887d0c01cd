"""Document quality from a linear-chain conditional random field over lines.

Each non-blank line has features of its own and of its neighbours; the field labels it good or bad, and the
length-weighted mean of the forward-backward marginals, put on the scale of the document labels, is the score.
Only documents are labelled, so the lines' labels are learnt: all lines of good documents are good, and in
bad documents a line model re-estimates, round by round, which lines are.

Fitting uses at most MAX_TRAIN labelled documents (lowest hash first) and MAX_CHUNKS * CHUNK lines of each, and only
these lines' features come to the driver; scoring covers all lines of all documents. Labels, lang, source and doc_id are never features.

Null, empty and blank texts have no lines and get the share of good documents among the fitted ones. Repeated
rows are scored each on its own. Without labelled documents of both kinds every score is that share (1 if
there are none). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import id_text, per_document, read

MAX_TRAIN = 4_000
THRESHOLD = 0.3
HELD_OUT = 5
CHUNK = 128  # lines of a training sequence; longer documents are cut into several
MAX_CHUNKS = 4  # sequences that a training document gives, evenly spaced in it
ROUNDS = 3

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = b"0123456789"
SYMBOL = b"|!#$%&*<>=_~^@\\/{}[]+"
N_BASE = 14


def lines_of(text: str | None) -> list[bytes]:
    return [x for line in text.encode("utf-8", "surrogatepass").split(b"\n") if (x := line.strip())] if text else []


def line_features(lines: list[bytes]) -> np.ndarray:
    """(lines, N_BASE) features of single lines; `seen` tells of lines that came before in the document."""
    out, seen = [], set()
    for line in lines:
        n, words = len(line), line.split()
        k = len(words)
        low = n - len(line.translate(None, LOWER))
        up = n - len(line.translate(None, UPPER))
        sym = n - len(line.translate(None, SYMBOL))
        out.append(
            (
                math.log1p(n) / 6,
                up / (up + low + 1),
                (n - len(line.translate(None, DIGIT))) / n,
                sym / n,
                min(1.0, 10 * line.count(b"|") / n),
                math.log1p(k) / 5,
                min(2.0, n / k / 10),
                len(set(words)) / k,
                sum(map(bytes.__eq__, words, words[1:])) / k,
                1.0 if line[-1] in b".!?" else 0.0,
                sum(w[-1] in SYMBOL for w in words) / k,
                1.0 if line in seen else 0.0,
                1.0 if k == 1 else 0.0,
                1.0 if up > 4 * low and up > 3 else 0.0,
            )
        )
        seen.add(line)
    return np.array(out, np.float32).reshape(-1, N_BASE)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Features of the line, of the one before and of the one after, whether these exist, and a bias."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    edge = np.zeros((n, 3), x.dtype)
    edge[0, 0] = edge[-1, 1] = 1
    edge[:, 2] = 1
    return np.hstack((x, before, after, edge))


@dataclass
class Field:
    """emission: weights of `good`; transition[a, b]; scale and shift: from the doc's log-odds to the label's."""

    emission: np.ndarray
    transition: np.ndarray
    scale: float
    shift: float
    share: float

    def marginals(self, x: np.ndarray) -> list[float]:
        """P(good) of each line by scaled forward-backward over two states (0 bad, 1 good)."""
        e = np.exp(np.clip(with_neighbours(x) @ self.emission, -30, 30)).tolist()
        (t00, t01), (t10, t11) = np.exp(self.transition).tolist()
        a, b, forward = 1.0, e[0], []
        s = a + b
        a, b = a / s, b / s
        forward.append((a, b))
        for g in e[1:]:
            a, b = a * t00 + b * t10, (a * t01 + b * t11) * g
            s = a + b
            a, b = a / s, b / s
            forward.append((a, b))
        p, q, out = 1.0, 1.0, []
        for (a, b), g in zip(reversed(forward), reversed(e), strict=True):
            bad, good = a * p, b * q
            out.append(good / (bad + good))
            p, q = t00 * p + t01 * g * q, t10 * p + t11 * g * q
            s = p + q
            p, q = p / s, q / s
        return out[::-1]

    def quality(self, lines: list[bytes]) -> float | None:
        """The length-weighted mean marginal."""
        if not lines:
            return None
        p = self.marginals(line_features(lines))
        n = [len(x) for x in lines]
        return sum(map(float.__mul__, map(float, n), p)) / sum(n)

    def score(self, text: str | None) -> float:
        q = self.quality(lines_of(text))
        return self.share if q is None else sigmoid(self.scale * log_odds(q) + self.shift)


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def log_odds(q: float) -> float:
    q = min(max(q, 0.002), 0.998)
    return math.log(q / (1 - q))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, decay: float = 1e-3, steps: int = 12) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    weight = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + decay * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + decay * w)
    return w


def line_labels(x: np.ndarray, doc: np.ndarray, bad_doc: np.ndarray) -> np.ndarray:
    """1 for good lines. Lines of bad documents are re-estimated; each keeps its worst line as bad."""
    y = 1.0 - bad_doc[doc]
    in_bad = y == 0
    for _ in range(ROUNDS):
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        good = x @ logistic(x, y, weight)
        worst = np.full(len(bad_doc), np.inf)
        np.minimum.at(worst, doc, good)
        y = np.where(in_bad & ((good < 0) | (good <= worst[doc])), 0.0, 1.0)
    return y


def fit_chain(sequences: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray, steps: int = 60, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the field by gradient ascent (Adam), all sequences at once, padded by length."""
    sequences = sorted(sequences, key=lambda s: len(s[1]))
    batches = []
    for i in range(0, len(sequences), 256):
        part = sequences[i : i + 256]
        t = len(part[-1][1])
        x, y, m = np.zeros((len(part), t, part[0][0].shape[1])), np.zeros((len(part), t), int), np.zeros((len(part), t))
        for k, (sx, sy) in enumerate(part):
            x[k, : len(sy)], y[k, : len(sy)], m[k, : len(sy)] = sx, sy, 1
        batches.append((x, y, m))
    theta = np.concatenate((start, np.zeros(4)))
    mean, square, total = np.zeros_like(theta), np.zeros_like(theta), sum(m.sum() for *_, m in batches)
    for step in range(1, steps + 1):
        grad = -decay * theta
        tr = np.exp(theta[-4:].reshape(2, 2))
        for x, y, m in batches:
            z = np.clip(x @ theta[:-4], -30, 30)
            e = np.stack((np.ones_like(z), np.exp(z)), -1) * m[..., None] + (1 - m[..., None])
            n, t = z.shape
            alpha, beta = np.empty((n, t, 2)), np.ones((n, t, 2))
            alpha[:, 0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
            for i in range(1, t):
                a = np.where(m[:, i, None] > 0, (alpha[:, i - 1] @ tr) * e[:, i], alpha[:, i - 1])
                alpha[:, i] = a / a.sum(-1, keepdims=True)
            for i in range(t - 2, -1, -1):
                b = np.where(m[:, i + 1, None] > 0, (beta[:, i + 1] * e[:, i + 1]) @ tr.T, beta[:, i + 1])
                beta[:, i] = b / b.sum(-1, keepdims=True)
            p = alpha * beta
            p /= p.sum(-1, keepdims=True)
            grad[:-4] += np.einsum("nt,ntf->f", (y - p[..., 1]) * m, x) / total
            if t > 1:
                pair = alpha[:, :-1, :, None] * tr * (e * beta)[:, 1:, None, :]
                pair /= pair.sum((-1, -2), keepdims=True)
                both = m[:, 1:]
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:, :-1][both > 0], y[:, 1:][both > 0]), 1)
                grad[-4:] += (seen - np.einsum("nt,ntab->ab", both, pair)).ravel() / total
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit(rows: list[tuple[int, list[int], np.ndarray]]) -> Field:
    """rows: (label, line lengths, line features) of each labelled document."""
    share = sum(r[0] for r in rows) / len(rows) if rows else 1.0
    rows = [r for r in rows if r[1]]
    width = 3 * N_BASE + 3
    if len({r[0] for r in rows}) < 2:
        return Field(np.zeros(width), np.zeros((2, 2)), 0.0, log_odds(share), share)
    x = np.vstack([with_neighbours(r[2]) for r in rows]).astype(float)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    y = line_labels(x, doc, np.array([1.0 - r[0] for r in rows]))
    parts = np.cumsum([len(r[1]) for r in rows])[:-1]
    sequences = [(a[i : i + CHUNK], b[i : i + CHUNK]) for a, b in zip(np.split(x, parts), np.split(y.astype(int), parts), strict=True) for i in range(0, len(b), CHUNK)]
    emission, transition = fit_chain(sequences, logistic(x, y, np.ones(len(y))))
    field = Field(emission, transition, 1.0, 0.0, share)
    q = [sum(n * p for n, p in zip(r[1], field.marginals(r[2]), strict=True)) / sum(r[1]) for r in rows]
    z = np.array([[log_odds(v), 1.0] for v in q])
    scale, shift = logistic(z, np.array([float(r[0]) for r in rows]), np.ones(len(rows)))
    field.scale, field.shift = max(0.0, float(scale)), float(shift)
    return field


def training_lines(n: int, chunk: int = CHUNK, most: int = MAX_CHUNKS) -> np.ndarray:
    """Which of a document's n lines are fitted: all, or `most` chunks evenly spaced from the first to the last."""
    if n <= chunk * most:
        return np.arange(n)
    starts = np.linspace(0, n - chunk, most).astype(int)
    return (starts[:, None] + np.arange(chunk)).ravel()


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most max_train labelled documents that are not held out."""
    key = F.col("doc_id")
    chosen = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where(key.isNotNull() & F.col("quality").isin(0, 1) & ~held_out(key)).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    few = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("quality", "text", "doc_id")

    def make():
        def work(quality, texts, ids):
            lines = [lines_of(t) for t in texts]
            some = [training_lines(len(v)) for v in lines]
            return quality, [[len(v[i]) for i in k] for v, k in zip(lines, some, strict=True)], [line_features(v)[k].tobytes() for v, k in zip(lines, some, strict=True)], ids

        return work

    rows = per_document(few, make, "quality int, lengths array<int>, features binary, doc_id long").collect()
    rows.sort(key=lambda r: (r.doc_id, len(r.lengths), bytes(r.features)))
    return fit([(r.quality, r.lengths, np.frombuffer(bytes(r.features), np.float32).reshape(-1, N_BASE)) for r in rows])


def held_out(key) -> F.Column:
    return F.crc32(key.cast("string")) % HELD_OUT == 0


def score_quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""

    def make():
        return lambda ids, texts: (ids, [field.score(t) for t in texts])

    return per_document(id_text(docs, id_col, text_col), make, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of docs that score at least the threshold; all columns stay."""
    field, schema = train(docs, labels), docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([field.score(t) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, schema)
